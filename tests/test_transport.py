import random
from collections import deque

import numpy as np

from tessella.operators import iterative, motifs, spectral, transport, vectors

EDGE = "src long, dst long, relation string, weight double"


def test_equal_graphs_are_near_and_others_far():
    path = np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0)))
    clique = 1.0 - np.eye(4)
    f = np.eye(4)[:, :2]
    move = [2, 0, 3, 1]
    same, plain, far = transport.fused_gromov_wasserstein([(path, f, path[np.ix_(move, move)], f[move]), (path, f, path, f), (path, f, clique, f)])
    assert abs(same - plain) < 1e-6 and plain < 0.3 < far
    lone = transport.fused_gromov_wasserstein([(np.zeros((1, 1)), f[:1], path, f)], alpha=1.0)[0]
    # one point against all: the plan is forced, so the value is the mean squared distance
    assert abs(lone - np.sqrt((path**2).mean())) < 1e-9
    assert len(transport.fused_gromov_wasserstein([])) == 0


def test_batches_do_not_change_distances():
    r = np.random.default_rng(2)
    graphs = []
    for n in (2, 3, 5, 6):
        c = r.integers(1, 4, (n, n)).astype(float)
        c = np.triu(c, 1) + np.triu(c, 1).T
        graphs.append((c, r.random((n, 3))))
    pairs = [(*a, *b) for a in graphs for b in graphs]
    together = transport.fused_gromov_wasserstein(pairs)
    assert np.allclose(together, [transport.fused_gromov_wasserstein([p])[0] for p in pairs], atol=1e-9)


def test_transport_neighbours(spark):
    rows = []
    for k in range(4):
        rows += [(10 * k, 10 * k + i, "a", 1.0) for i in range(1, 4 if k < 2 else 6)]
    graph = spark.createDataFrame(rows, EDGE)
    egos = motifs.ego_graphs(graph, spark.createDataFrame([], "node long, symbol string")).filter("center % 10 = 0")
    knn = transport.transport_knn(transport.shapes(egos, ["a"]), 1).collect()
    assert {(r["id"], r["nbr"]) for r in knn} == {(0, 10), (10, 0), (20, 30), (30, 20)}


def test_histogram_and_euclidean_neighbours(spark):
    r = np.random.default_rng(3)
    m = r.integers(0, 5, (30, 4)).astype(float)
    m[3] = m[4] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")

    def js(p, q):
        if not p.sum() or not q.sum():
            return 0.0 if p.sum() == q.sum() else 1.0
        p, q = p / p.sum(), q / q.sum()
        kl = lambda x, y: sum(a * np.log2(a / b) for a, b in zip(x, y, strict=True) if a > 0)
        return np.sqrt(max(0, (kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2))

    for knn, distance in ((vectors.histogram_knn, js), (vectors.euclidean_knn, lambda p, q: np.linalg.norm(p - q))):
        got = knn(df, 3, block_rows=8).collect()
        for i in range(30):
            want = sorted((round(distance(m[i], m[j]), 7), j) for j in range(30) if j != i)[:3]
            mine = sorted((round(x["distance"], 7), x["nbr"]) for x in got if x["id"] == i)
            assert np.allclose([d for d, _ in mine], [d for d, _ in want], atol=1e-6)


def test_similarity_edges(spark):
    m = np.random.default_rng(5).normal(size=(25, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(25) for j in range(i + 1, 25) if unit[i] @ unit[j] >= 0.5}
    assert {(x["src"], x["dst"]) for x in vectors.similarity_edges(df, 0.5, block_rows=7).collect()} == want


def test_adjusted_rand(spark):
    frame = lambda labels: spark.createDataFrame(list(enumerate(labels)), "id long, label long")
    ari = lambda a, b: vectors.adjusted_rand(frame(a), frame(b)).first()["ari"]
    assert ari([0, 0, 1, 1], [5, 5, 7, 7]) == 1.0
    assert abs(ari([0, 0, 1, 1], [0, 1, 0, 1]) + 0.5) < 1e-12
    assert ari([0], [3]) == 1.0


def test_bfs_sample_follows_the_queue(spark):
    r = random.Random(8)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(60)]
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    start = min(near, key=lambda n: (-len(near[n]), n))
    for limit in (1, 9, 1000):
        want, queue = [start], deque([start])
        while queue and len(want) < limit:
            for n in sorted(near[queue.popleft()] - set(want), key=lambda n: (-len(near[n]), n)):
                if len(want) < limit:
                    want.append(n)
                    queue.append(n)
        got = iterative.bfs_sample(spark.createDataFrame(pairs, "src long, dst long"), limit).orderBy("place").collect()
        assert [x["node"] for x in got] == want


def test_transition_without_contraction_loses_nothing(spark):
    r = random.Random(6)
    links = {(i, (i + 1) % 12) for i in range(12)} | {(r.randrange(12), r.randrange(12)) for _ in range(8)}
    rows = [(a, b, 1.0 + a + b) for a, b in links if a != b]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src long, dst long, weight double")
    itself = spectral.evaluate_transition(edges, spark.createDataFrame([(i, i) for i in range(12)], "node long, label long"))
    assert itself["reduction"] == 0 and max(itself[k] for k in ("subspace", "eigenvalue", "full_error", "slow_error", "late_error")) < 1e-6
    half = spectral.evaluate_transition(edges, spark.createDataFrame([(i, i // 2) for i in range(12)], "node long, label long"))
    assert half["coarse"] == 6 and half["full_error"] > 0
    few = spectral.evaluate_transition(edges, spark.createDataFrame([(i, i % 2) for i in range(12)], "node long, label long"))
    assert few["subspace"] is None and few["coarse"] == 2
