"""Sampled graph measures: betweenness from sources, and first-passage walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, betweenness) over undirected edges (src, dst), from ``sources`` (node).

    Brandes' scheme by depth for all sources at once: a forward pass counts shortest
    paths, a backward pass sums dependencies. The sum is scaled by nodes / sources / 2.
    """
    both = materialize(edges.filter("src <> dst").select("src", "dst").union(edges.filter("src <> dst").select("dst", "src")).distinct(), "topology")
    nodes = both.select(F.col("src").alias("node")).distinct()
    layer = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "layer")
    layers, seen = [layer], layer.select("source", "node")
    while True:
        step = layer.join(both, layer.node == both.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        layer = materialize(step.join(seen, ["source", "node"], "left_anti"), "layer")
        if not layer.limit(1).count():
            break
        layers.append(layer)
        seen = materialize(seen.union(layer.select("source", "node")), "seen")
    found = None
    below = None
    for upper in reversed(layers):
        if below is None:
            part = upper.withColumn("dependency", F.lit(0.0))
        else:
            child = below.select("source", F.col("node").alias("child"), ((1 + F.col("dependency")) / F.col("paths")).alias("share"))
            through = upper.select("source", "node", "paths").join(both, upper.node == both.src).select("source", "node", "paths", F.col("dst").alias("child")).join(child, ["source", "child"])
            sums = through.groupBy("source", "node").agg(F.sum(F.col("paths") * F.col("share")).alias("dependency"))
            part = upper.join(sums, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("dependency", F.lit(0.0)).alias("dependency"))
        below = materialize(part, "dependency")
        own = below.filter("source <> node").select("node", "dependency")
        found = own if found is None else found.union(own)
    scale = nodes.count() / max(1, sources.count()) / 2
    total = found.groupBy("node").agg(F.sum("dependency").alias("d"))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def first_passage(edges: DataFrame, pairs: DataFrame, walks: int = 20, max_steps: int = 50, seed: int = 1) -> DataFrame:
    """(start, goal, hit_rate, mean_steps) of weighted random walks along (src, dst, weight).

    Every step of every walk is drawn from a hash of seed, walk and step, so reruns agree;
    all walks advance together by one join a step. A dead end stops its walk.
    """
    order = W.partitionBy("src").orderBy("dst")
    share = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).filter("w > 0")
    share = share.withColumn("high", F.sum("w").over(order) / F.sum("w").over(W.partitionBy("src")))
    choice = materialize(share.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).select("src", "dst", "low", "high"), "choice")
    live = pairs.select("start", "goal", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.col("start").alias("at"))
    live, done = materialize(live.filter("start <> goal"), "walks"), []
    for step in range(1, max_steps + 1):
        drawn = live.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "start", "goal", "walk", F.lit(step)), F.lit(1 << 52)) / float(1 << 52))
        moved = drawn.join(choice, (drawn.at == choice.src) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        moved = materialize(moved.select("start", "goal", "walk", F.col("dst").alias("at")), "walks")
        done.append(moved.filter("at = goal").select("start", "goal", F.lit(step).alias("steps")))
        live = moved.filter("at <> goal")
        if not live.limit(1).count():
            break
    hits = done[0]
    for d in done[1:]:
        hits = hits.union(d)
    rate = hits.groupBy("start", "goal").agg((F.count("*") / walks).alias("hit_rate"), F.avg("steps").alias("mean_steps"))
    return pairs.join(rate, ["start", "goal"], "left").select("start", "goal", F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"), "mean_steps")


def snapshot(edges: DataFrame, samples: int = 8, seed: int = 7, walks: int = 10, max_steps: int = 12) -> DataFrame:
    """(metric, value): degree moments and thresholds, mass, spectrum and sampled path measures of a graph.

    Directed weights are added both ways first. Every sampler draws its nodes by its own
    hash seed, so a measure does not depend on the ones before it.
    """
    from ..session import materialize
    from . import iterative, spectral

    both = edges.filter("src <> dst").select("src", "dst", "weight").union(edges.filter("src <> dst").select("dst", "src", "weight"))
    both = materialize(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "both")
    node = materialize(both.groupBy("src").agg(F.count("*").alias("k"), F.sum("weight").alias("s")), "strength")
    names = node.select(F.col("src").alias("node"))
    draw = lambda i: iterative.ego_sample(names, seed + i, samples)
    m = node.agg(F.count("*").alias("n"), F.avg("k").alias("k1"), F.avg(F.col("k") * F.col("k")).alias("k2"), F.max("s").alias("top"), F.sum("s").alias("all")).first()
    out: dict[str, float | None] = {"nodes": m["n"], "mean_degree": m["k1"], "second_moment": m["k2"]}
    out["spreading_threshold"] = m["k1"] / m["k2"] if m["k2"] else None
    out["percolation_threshold"] = m["k1"] / (m["k2"] - m["k1"]) if m["k2"] and m["k2"] > m["k1"] else None
    out["largest_mass"] = m["top"] / m["all"] if m["all"] else None
    values, _ = spectral.top_eigenpairs(both, 2)
    out["spectral_gap"] = float(values[0] - values[1]) if len(values) > 1 else None
    pairs = draw(0).select(F.col("node").alias("start"), F.lit(0).alias("x")).join(iterative.ego_sample(names, seed + 1, 1).select(F.col("node").alias("goal"), F.lit(0).alias("x")), "x").drop("x").filter("start <> goal")
    walk = first_passage(both, pairs, walks, max_steps).agg(F.avg("hit_rate").alias("h"), F.avg("mean_steps").alias("m")).first()
    out["hit_rate"], out["mean_first_passage"] = walk["h"], walk["m"]
    out["largest_betweenness"] = betweenness(both, draw(2)).agg(F.max("betweenness")).first()[0]
    near = draw(3).join(both.select(F.col("src").alias("node"), "dst"), "node")
    ends = near.select("node", F.col("dst").alias("a")).join(near.select("node", F.col("dst").alias("b")), "node").filter("a < b").join(both.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi").groupBy("node").agg(F.count("*").alias("t"))
    share = near.groupBy("node").agg(F.count("*").alias("d")).join(ends, "node", "left").select(F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c"))
    out["clustering"] = share.agg(F.avg("c")).first()[0]
    hops = iterative.bfs_distances(both, draw(4)).filter("hops > 0").agg(F.avg("hops").alias("a"), F.median("hops").alias("b"), F.percentile("hops", 0.95).alias("c")).first()
    out["mean_path"], out["median_path"], out["p95_path"] = hops["a"], hops["b"], hops["c"]
    return edges.sparkSession.createDataFrame([(k, None if v is None else round(float(v), 9)) for k, v in out.items()], "metric string, value double")
