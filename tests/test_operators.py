import heapq
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import coding, components, iterative, relational, spectral, vectors


def edges(spark, rows, schema="src long, dst long, distance double"):
    return spark.createDataFrame(rows, schema)


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    got = {x["node"]: x["root"] for x in components.components(edges(spark, pairs, "src long, dst long")).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]])
    assert components.components(edges(spark, [], "src long, dst long")).count() == 0


def test_matching_equals_sequential_greedy(spark):
    r = random.Random(4)
    rows = list({(a, b): (a, b, float(r.randrange(9))) for a, b in ((r.randrange(20), r.randrange(20, 40)) for _ in range(90))}.values())
    used, want = set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in rows):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = {(x["src"], x["dst"]) for x in iterative.greedy_matching(edges(spark, rows)).collect()}
    assert got == want


def test_spanning_forest_and_star(spark):
    r = random.Random(5)
    rows = list({(a, b): (a, b, float(r.randrange(50))) for a, b in ((r.randrange(12), r.randrange(12, 24)) for _ in range(50))}.values())
    label, want = {}, set()
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for d, a, b in sorted((d, a, b) for a, b, d in rows):
        if find(a) != find(b):
            label[find(a)] = find(b)
            want.add((a, b))
    assert {(x["src"], x["dst"]) for x in iterative.spanning_forest(edges(spark, rows)).collect()} == want
    star = edges(spark, [(0, i, 1.0) for i in range(1, 10)])
    nodes = spark.range(10).selectExpr("id as node")
    assert iterative.agglomerate(nodes, star, 0.5).select("root").distinct().count() == 5
    assert iterative.greedy_matching(star, 5).count() == 1


def test_bfs(spark):
    path = edges(spark, [(i, i + 1) for i in range(6)], "src long, dst long")
    got = {x["node"]: x["hops"] for x in iterative.bfs_distances(path, spark.createDataFrame([(2,)], "node long")).collect()}
    assert got == {i: abs(i - 2) for i in range(7)}


def test_apply_relational(spark):
    both = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    got = {(r["id"], r["strength"]) for r in relational.apply("a5_strength", both=both).collect()}
    assert got == {(0, 1.0), (1, 2.0), (2, 1.0)}
    lap = {(r["src"], r["dst"]): r["l"] for r in relational.apply("g15_normalized_laplacian", both=both).collect()}
    assert lap[0, 1] == pytest.approx(-1 / 2**0.5)


def test_spectral(spark):
    n = 12
    ring = [(i, (i + d) % n, 1.0) for i in range(n) for d in (1, -1)]
    values, coords = spectral.top_eigenpairs(spark.createDataFrame(ring, "src long, dst long, weight double"), 3)
    assert values[0] == pytest.approx(1) and values[1] == pytest.approx(np.cos(2 * np.pi / n))
    assert coords.count() == n
    assert spectral.critical_beta(np.array([1, 0.5, -0.5]))[0] == 0.5
    assert spectral.relative_error(np.zeros(2), np.zeros(2)) == 0
    assert spectral.subspace_distance(np.eye(4)[:, :2], np.eye(4)[:, :2]) == 0
    s = np.array([[0, 1.0], [1.0, 0]])
    lam, vec = np.linalg.eigh(s)
    exact = spectral.linear_dynamics(lam, vec, np.array([1.0, 0]), np.array([0, 1.0]), 1, 0.5)
    steps = spectral.nonlinear_dynamics(s, np.array([1.0, 0]), "linear", 1, 0.5, 0, 0.01, 100)
    assert np.allclose(exact[-1], steps[-1], atol=1e-8)


def test_large_eigenpairs_follow_dense(spark, monkeypatch):
    r = np.random.default_rng(0)
    a = r.random((14, 14))
    a = a + a.T
    rows = [(i, j, float(a[i, j])) for i in range(14) for j in range(14)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    dense, _ = spectral.top_eigenpairs(df, 2)
    monkeypatch.setattr(spectral, "DENSE", 3)
    some, _ = spectral.top_eigenpairs(df, 2, tolerance=0.01)
    assert np.allclose(dense, some, atol=0.05)
    with pytest.raises(RuntimeError, match="settle"):
        spectral.top_eigenpairs(df, 2, iterations=1)


def test_knn(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(40, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = {(x["id"], x["rank"]): x["nbr"] for x in vectors.cosine_knn(df, 3, block_rows=15).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9) + np.diag([9.0] * 40)
    assert all(got[i, k + 1] == np.argsort(d[i], kind="stable")[k] for i in range(40) for k in range(3))
    assert vectors.wishart_clusters(vectors.cosine_knn(df, 3), 3).count() == 40


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 50), min_size=1, max_size=12))
def test_huffman(freq):
    lengths = coding.huffman_lengths(freq)
    codes = coding.canonical_codes(lengths)
    text = [s for s, n in freq.items() for _ in range(n)]
    assert coding.unpack_bits(coding.pack_bits(text, codes), codes, len(text)) == text
    heap = list(freq.values())
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        best += x
        heapq.heappush(heap, x)
    assert sum(freq[s] * n for s, n in lengths.items()) == (best or next(iter(freq.values())))


def test_codec_round_trip(spark, tmp_path):
    rows = [(i, i % 7 - 3, i * 5 % 11, "ab"[i % 2], i / 3) for i in range(50)]
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, relation string, weight double")
    out = coding.round_trip(df).first()
    assert (out["records"], out["differing"]) == (50, 0)
    coding.write_archive(coding.encode_records(df), str(tmp_path / "a.zip"), {"v": 2})


def test_set_packing():
    f = frozenset
    # one large occurrence beats the two it meets
    assert coding.select_occurrences([(3, 3, "a", 0, f({1})), (2, 2, "b", 1, f({2})), (1, 6, "c", 2, f({1, 2}))]) == [2]
    assert coding.select_occurrences([(3, 3, "a", 0, f({1})), (1, 2, "c", 2, f({1, 2}))]) == [0]
