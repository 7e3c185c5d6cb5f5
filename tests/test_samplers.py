import collections
import random

import pytest

from tessella.operators import samplers


def brandes(pairs, sources):
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = dict.fromkeys(near, 0.0)
    for s in sources:
        depth, paths, order = {s: 0}, collections.Counter({s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        need = collections.Counter()
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    need[v] += paths[v] / paths[w] * (1 + need[w])
            if w != s:
                out[w] += need[w]
    return {v: x * len(near) / len(sources) / 2 for v, x in out.items()}


def test_betweenness(spark):
    r = random.Random(2)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(40)]
    sources = sorted({a for a, b in pairs if a != b})[:6]
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = samplers.betweenness(df, spark.createDataFrame([(s,) for s in sources], "node long"))
    want = brandes(pairs, sources)
    assert {x["node"]: x["betweenness"] for x in got.collect()} == pytest.approx(want)


def test_first_passage(spark):
    path = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (4, 4, 1.0), (5, 6, 3.0), (5, 7, 1.0)]
    df = spark.createDataFrame(path, "src long, dst long, weight double")
    pairs = spark.createDataFrame([(0, 3), (0, 9), (4, 1), (5, 6)], "start long, goal long")
    got = {(x["start"], x["goal"]): x for x in samplers.first_passage(df, pairs, walks=200, max_steps=5).collect()}
    assert (got[0, 3]["hit_rate"], got[0, 3]["mean_steps"]) == (1.0, 3.0)
    assert got[0, 9]["hit_rate"] == 0 and got[4, 1]["hit_rate"] == 0
    assert got[5, 6]["hit_rate"] == pytest.approx(0.75, abs=0.1)
