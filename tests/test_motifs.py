import itertools
import random

from pyspark.sql import functions as F

from tessella.operators import coding, motifs

EDGE = "src long, dst long, relation string, weight double"


def test_canonical_form_is_isomorphism():
    r = random.Random(4)

    def graph(n):
        links = [(u, v, r.choice("ab")) for u in range(n) for v in range(n) if u != v and r.random() < 0.35]
        return [r.choice("xy") for _ in range(n)], links

    def same(a, b):
        (sa, la), (sb, lb) = a, b
        return any(all(sa[i] == sb[p[i]] for i in range(len(sa))) and {(p[u], p[v], x) for u, v, x in la} == set(lb) for p in itertools.permutations(range(len(sa)))) if len(sa) == len(sb) else False

    graphs = [graph(n) for n in (2, 3, 3, 3, 4, 4) for _ in range(5)]
    for a in graphs[:]:
        p = list(range(len(a[0])))
        r.shuffle(p)
        moved = [None] * len(p)
        for i, j in enumerate(p):
            moved[j] = a[0][i]
        graphs.append((moved, [(p[u], p[v], x) for u, v, x in a[1]]))
    forms = [motifs.canonical_form(*g)[0] for g in graphs]
    for (a, x), (b, y) in itertools.combinations(list(zip(graphs, forms, strict=True)), 2):
        assert (x == y) == same(a, b)


def test_canonical_form_of_symmetric_graphs():
    star = [(0, i, "a") for i in range(1, 40)]
    other = [(39, i, "a") for i in range(39)]
    assert motifs.canonical_form(["x"] * 40, star)[0] == motifs.canonical_form(["x"] * 40, other)[0]
    ring = lambda p: [(p[i], p[(i + 1) % 10], "a") for i in range(10)]
    two = [(i, (i + 1) % 5, "a") for i in range(5)] + [(5 + i, 5 + (i + 1) % 5, "a") for i in range(5)]
    one = motifs.canonical_form(["x"] * 10, ring(list(range(10))))[0]
    assert one == motifs.canonical_form(["x"] * 10, ring([3, 1, 4, 0, 5, 9, 2, 6, 8, 7]))[0] != motifs.canonical_form(["x"] * 10, two)[0]


def test_selection_equals_sequential_greedy(spark):
    r = random.Random(9)
    found = [(i, float(r.randrange(4)), float(r.randrange(3)), r.choice("pq"), sorted(r.sample(range(25), 3)), 0.0, 0.0) for i in range(40)]
    order = sorted(found, key=lambda f: (f[1], f[2], f[3], -f[0]), reverse=True)
    used, want = set(), set()
    for f in order:
        if not used & set(f[4]):
            used |= set(f[4])
            want.add(f[0])
    df = spark.createDataFrame(found, "center long, density double, gain double, type string, nodes array<long>, raw_bits double, encoded_bits double")
    assert {x["center"] for x in motifs.select_disjoint(df).collect()} == want
    assert motifs.select_disjoint(df.limit(0)).count() == 0


def test_mining_contracts_repeated_cliques(spark):
    rows = []
    for k in range(30):
        p = [10 * k + i for i in range(5)]
        rows += [(u, v, "a", 1.0) for u in p for v in p if u != v]
        rows.append((p[0], 10 * ((k + 1) % 30), "b", 1.0))
    levels, members = motifs.mine(spark.createDataFrame(rows, EDGE), max_levels=2, cap=8)
    first = levels.orderBy("level").first()
    assert first["nodes"] == 150 and first["chosen"] > 0 and first["encoded_bits"] < first["raw_bits"] and first["nodes_after"] < 150
    assert members.count() == 150 and members.select("node").distinct().count() == 150
    assert members.filter(F.col("owner") > F.col("node")).count() == 0
    empty, none = motifs.mine(spark.createDataFrame([], EDGE))
    assert empty.first()["stop"] == "min_graph_nodes" and none.count() == 0


def test_ports_are_the_edges_that_leave(spark):
    edges = spark.createDataFrame([(1, 2, "a", 1.0), (2, 3, "a", 1.0), (3, 4, "b", 1.0)], EDGE)
    egos = motifs.ego_nodes(edges).filter("center = 2")
    got = {(x["node"], x["relation"], x["direction"], x["n"]) for x in motifs.boundary_ports(edges, egos).collect()}
    assert got == {(3, "b", "o", 1)}


def test_huffman_single_and_pair():
    assert coding.huffman_lengths({"a": 3}) == {"a": 1}
