import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import families, iterative, samplers, spectral, text

RING = [(0, 1, "a"), (1, 2, "a"), (2, 0, "b")]


def test_features_do_not_depend_on_node_order():
    turned = [((u + 1) % 3, (v + 1) % 3, r) for u, v, r in RING]
    for value in (families.refined_histogram, families.graphlet_histogram):
        assert np.allclose(value(["X"] * 3, RING), value(["X"] * 3, turned))
    assert families.signature(["X"] * 3, RING) == families.signature(["X"] * 3, turned)
    assert families.signature(["X"] * 3, RING) != families.signature(["X"] * 3, [(0, 1, "a"), (1, 2, "a"), (0, 2, "b")])


def test_isomorphism_maps_links(spark):
    link = lambda shift: [(u + shift, v + shift, r) for u, v, r in RING]
    rows = [(1, [(i, "X") for i in range(3)], RING), (9, [(i + 7, "X") for i in range(3)], [((u + 1) % 3 + 7, (v + 1) % 3 + 7, r) for u, v, r in RING])]
    egos = spark.createDataFrame(rows, "center long, nodes array<struct<node:long,symbol:string>>, links array<struct<u:long,v:long,relation:string>>")
    got = {r["a"]: r for r in families.isomorphisms(egos).collect()}
    to = dict(zip(got[9]["nodes_a"], got[9]["nodes_b"], strict=True))
    assert got[9]["b"] == 1 and {(to[u], to[v], r) for u, v, r in rows[1][2]} == set(link(0))


def test_families_fold():
    known: dict = {}
    assert families.resolve_families(known, [{"a", "b"}, {"c"}]) == ["WF_000001", "WF_000002"]
    assert families.resolve_families(known, [{"a", "b", "d"}, {"e"}, {"c"}]) == ["WF_000001", "WF_000003", "WF_000002"]
    assert known["WF_000001"] == {"a", "b", "d"}


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="metric"):
        families.nearest_egos(spark.range(1), [], "none", 2)


def test_growth_follows_a_heap(spark):
    random.seed(5)
    pairs = sorted({tuple(sorted(random.sample(range(60), 2))) for _ in range(120)})
    degree = Counter(x for p in pairs for x in p)
    key = {n: (-float(k), n) for n, k in degree.items()}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, best = set(), []
    for n in sorted(near):
        if n not in seen:
            part, stack = {n}, [n]
            while stack:
                for m in near[stack.pop()] - part:
                    part.add(m)
                    stack.append(m)
            seen |= part
            best = max(best, sorted(part), key=len)
    heap, queued, want = [min(key[n] for n in best)], set(), []
    queued.add(heap[0][1])
    while len(want) < 20:
        n = heapq.heappop(heap)[1]
        want.append(n)
        for m in near[n] - queued:
            queued.add(m)
            heapq.heappush(heap, key[m])
    degrees = spark.createDataFrame([(n, float(k)) for n, k in degree.items()], "node long, degree double")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = iterative.best_first_growth(degrees, edges, 20, 5.0).orderBy("place").collect()
    assert [r["node"] for r in got] == want
    with pytest.raises(ValueError, match="under the target"):
        iterative.best_first_growth(degrees, edges.limit(0), 20, 5.0)


def test_levels_near_targets():
    assert iterative.pick_levels({0: 100, 1: 60, 2: 30}, [90, 70, 31, 10]) == ({0: [90], 1: [70, 31]}, [10])
    with pytest.raises(ValueError, match="two levels"):
        iterative.pick_levels({0: 5}, [5])


def test_angles_of_bases(spark):
    random_ = np.random.default_rng(0)
    a, b = random_.normal(size=(30, 2)), random_.normal(size=(30, 3))
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, coords array<double>")
    assert spectral.angles(frame(a), frame(b))[1] == pytest.approx(spectral.subspace_distance(a, b), abs=1e-9)
    assert spectral.angles(frame(a), frame(a @ np.array([[1.0, 2], [0, 3]])))[1] == pytest.approx(0, abs=1e-6)


def test_snapshot_of_a_complete_graph(spark):
    rows = [(i, j, 1.0) for i in range(5) for j in range(i)]
    got = {r["metric"]: r["value"] for r in samplers.snapshot(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()}
    assert got["nodes"] == 5 and got["mean_degree"] == 4 and got["clustering"] == 1 and got["mean_path"] == 1
    assert got["spreading_threshold"] == 0.25 and got["spectral_gap"] == pytest.approx(1.25) and got["largest_betweenness"] == 0


def test_connectors(spark):
    edges = spark.createDataFrame([(1, 2, "a", 2.0), (1, 3, "b", 1.0), (3, 1, "a", 4.0)], "src long, dst long, relation string, weight double")
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "node long, label long")
    got = {r["label"]: tuple(r)[1:] for r in families.connectors(edges, labels).collect()}
    assert got[7] == (2.0, 1.0, 4.0, "b=1.0000", 1 / 3) and got[8] == (0.0, 4.0, 1.0, "a=4.0000", 1.0)


def test_concepts_and_descriptor(spark):
    docs = spark.createDataFrame([(1, "red cat sat. red dog sat. blue cat ran."), (2, None)], "doc_id long, text string")
    index = text.ConceptIndex(least=1).fit(docs)
    assert index.search("cat", 2).count() == 2 and index.search("none").count() == 0
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(16) for j in range(16) if i != j], "src long, dst long, weight double")
    got = text.graphon_descriptor(edges)
    assert len(got) == 28 and got[0] == pytest.approx(15) and got[9] == 1 and got[10] == 0
    assert not text.graphon_descriptor(edges.filter(F.lit(False))).any()
