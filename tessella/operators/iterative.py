"""Iterative graph operators: short loops of materialised DataFrame rounds."""

from __future__ import annotations

import heapq
import math
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

__all__ = ["agglomerate", "bfs_distances", "component_labels", "contraction_plan", "greedy_matching", "label_quotient", "largest_component", "spanning_forest"]


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node; an isolated node is its own root."""
    roots = components(edges)
    return nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties go to the smallest root."""
    best = labels.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1).select("root")
    return labels.join(F.broadcast(best), "root", "left_semi")


def bfs_distances(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, node, hops) by frontier joins over undirected edges (src, dst), to the end.

    With ``max_hops`` a node farther away raises.
    """
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "topology")
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("hops")), "bfs")
    frontier = seen
    for hop in count(1):
        step = frontier.join(both, frontier.node == both.src).select("source", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")), "frontier")
        if not frontier.limit(1).count():
            return seen
        if hop == max_hops:
            raise RuntimeError(f"nodes lie beyond {max_hops} hops")
        seen = materialize(seen.unionByName(frontier), "bfs")


def greedy_matching(edges: DataFrame, budget: int | None = None) -> DataFrame:
    """Pairs (src, dst, distance) taken in (distance, src, dst) order while both ends are free.

    Each round takes the edges that come first at both their ends, which for a total
    order gives the sequential result; a budget keeps the first pairs of that order.
    """
    order = F.struct("distance", "src", "dst")
    left = materialize(edges.select("src", "dst", "distance").filter("src <> dst"), "open")
    taken: DataFrame | None = None
    while True:  # every round takes a pair, the first of the order at least
        ends = left.select(F.col("src").alias("n"), order.alias("o")).union(left.select(F.col("dst"), order))
        best = materialize(ends.groupBy("n").agg(F.min("o").alias("o")), "best")
        a, b = best.select(F.col("n").alias("src"), F.col("o").alias("oa")), best.select(F.col("n").alias("dst"), F.col("o").alias("ob"))
        now = materialize(left.withColumn("o", order).join(a, "src").join(b, "dst").filter("o = oa and o = ob").select("src", "dst", "distance"), "taken")
        if not now.limit(1).count():
            break
        taken = now if taken is None else taken.union(now)
        used = now.select(F.col("src").alias("n")).union(now.select("dst"))
        left = materialize(left.join(used, left.src == used.n, "left_anti").join(used, F.col("dst") == used.n, "left_anti"), "open")
    out = left.limit(0) if taken is None else taken
    return out if budget is None else out.orderBy("distance", "src", "dst").limit(budget)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest in (distance, src, dst) order, by Boruvka rounds."""
    order = F.struct("distance", "src", "dst")
    live = materialize(edges.filter("src <> dst").select("src", "dst", "distance", F.col("src").alias("a"), F.col("dst").alias("b")), "live")
    forest = live.select("src", "dst", "distance").limit(0)
    while True:  # every round at least halves the trees that can still grow
        sides = live.select(F.col("a").alias("r"), order.alias("o")).union(live.select(F.col("b"), order))
        chosen = materialize(sides.groupBy("r").agg(F.min("o").alias("o")).select("o.*").distinct(), "chosen")
        if not chosen.limit(1).count():
            break
        forest = forest.union(chosen.select("src", "dst", "distance"))
        joined = live.join(chosen.select("src", "dst"), ["src", "dst"]).select("a", "b")
        roots = materialize(components(joined, "a", "b"), "roots")
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = live.join(ra, "a", "left").join(rb, "b", "left").select("src", "dst", "distance", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        live = materialize(live.filter("a <> b"), "live")
    return forest


def agglomerate(nodes: DataFrame, edges: DataFrame, fraction: float) -> DataFrame:
    """(node, root) after the first floor(n * fraction) merges of single linkage along edges."""
    n = nodes.select("node").distinct().count()
    merges = math.floor(n * fraction + 1e-12)
    kept = spanning_forest(edges).orderBy("distance", "src", "dst").limit(merges)
    return component_labels(nodes, kept)


def label_quotient(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Directed quotient by (label, component within the label); label -1 or none stays single."""
    la, lb = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    inner = edges.join(la, "src").join(lb, "dst").filter("la = lb and la >= 0").select("src", "dst")
    owner = materialize(component_labels(labels.select("node"), inner), "owner")
    a, b = owner.select(F.col("node").alias("src"), F.col("root").alias("ra")), owner.select(F.col("node").alias("dst"), F.col("root").alias("rb"))
    ends = F.coalesce("ra", "src").alias("src"), F.coalesce("rb", "dst").alias("dst")
    return edges.join(a, "src", "left").join(b, "dst", "left").groupBy(*ends).agg(F.sum("weight").alias("weight"))


def contraction_plan(spark: SparkSession, nodes: int, fraction: float, least: int, levels: int) -> DataFrame:
    """(level, nodes): sizes when every level merges floor(n * fraction + 1e-12) pairs."""
    rows, n = [(0, nodes)], nodes
    for level in range(1, levels + 1):
        m = n - math.floor(n * fraction + 1e-12)
        if m == n or m < least:
            break
        n = m
        rows.append((level, n))
    return spark.createDataFrame(rows, "level long, nodes long")


def hierarchy(nodes: DataFrame, edges: DataFrame, fraction: float, levels: int, least: int = 3) -> DataFrame:
    """(level, node, cluster): repeated agglomeration; distance is 1 / weight, summed in the quotient."""
    found = materialize(nodes.select(F.lit(0).cast("long").alias("level"), "node", F.col("node").alias("cluster")), "level")
    current, graph = found.select("node", "cluster"), materialize(edges.select("src", "dst", "weight"), "graph")
    for level in range(1, levels + 1):
        units = current.select(F.col("cluster").alias("node")).distinct()
        before = units.count()
        if before < least:
            break
        pairs = graph.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((1 / F.sum("weight")).alias("distance"))
        root = materialize(agglomerate(units, pairs, fraction), "merge")
        if root.select("root").distinct().count() == before:
            break
        current = materialize(current.join(root.withColumnRenamed("node", "cluster"), "cluster").select("node", F.col("root").alias("cluster")), "members")
        found = found.union(current.select(F.lit(level).cast("long"), "node", "cluster"))
        a, b = root.select(F.col("node").alias("src"), F.col("root").alias("ra")), root.select(F.col("node").alias("dst"), F.col("root").alias("rb"))
        graph = materialize(graph.join(a, "src").join(b, "dst").groupBy(F.col("ra").alias("src"), F.col("rb").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")
    return found


def ego_sample(nodes: DataFrame, seed: int, limit: int) -> DataFrame:
    """The ``limit`` nodes with the smallest seeded hash: a sample that reruns agree on."""
    return nodes.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string")))).orderBy("h", "node").limit(limit).drop("h")


def run_lengths(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Maximal runs of consecutive ``order`` values per key: (key, first, last, length)."""
    island = rows.withColumn("island", F.col(order) - F.row_number().over(W.partitionBy(key).orderBy(order)))
    return island.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("island")


def bfs_sample(edges: DataFrame, limit: int) -> DataFrame:
    """(node, place): breadth-first from the node of most neighbours, exactly ``limit`` if so many connect.

    A queue visits nodes by (place of the first parent, falling degree, id); ties for the
    start go to the smallest id. Every round takes one hop, cut at what is still missing.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    both = materialize(both, "topology")
    degree = materialize(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "degree")
    seen = materialize(degree.orderBy(F.desc("degree"), "node").limit(min(1, limit)).select("node", F.lit(0).cast("long").alias("place")), "sample")
    frontier, n = seen, seen.count()
    while n < limit:
        near = frontier.join(both, frontier.node == both.src).groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("parent"))
        fresh = near.join(seen, "node", "left_anti").join(degree, "node").orderBy("parent", F.desc("degree"), "node").limit(limit - n)
        place = F.row_number().over(W.orderBy("parent", F.desc("degree"), "node")) - 1 + n
        frontier = materialize(fresh.select("node", place.cast("long").alias("place")), "frontier")
        added = frontier.count()
        if not added:
            break
        seen, n = materialize(seen.union(frontier), "sample"), n + added
    return seen


def degree_pool(degrees: DataFrame, edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the largest component among the ``size`` nodes of highest degree.

    ``degrees`` is (node, degree), ties by node; of components of one size the one with the
    best node counts.
    """
    pool = materialize(degrees.orderBy(F.desc("degree"), "node").limit(size), "pool")
    a, b = pool.select(F.col("node").alias("src")), pool.select(F.col("node").alias("dst"))
    inner = materialize(edges.filter("src <> dst").select("src", "dst").distinct().join(a, "src", "left_semi").join(b, "dst", "left_semi"), "inner")
    labels = materialize(component_labels(pool, inner).join(pool, "node"), "labels")
    best = labels.groupBy("root").agg(F.count("*").alias("n"), F.max("degree").alias("d"), F.min_by("node", F.struct(-F.col("degree"), "node")).alias("first"))
    root = best.orderBy(F.desc("n"), F.desc("d"), "first").limit(1).select("root")
    nodes = materialize(labels.join(F.broadcast(root), "root", "left_semi").select("node", "degree"), "nodes")
    return nodes, inner.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


GROWTH_NODES, GROWTH_EDGES = 2_000_000, 10_000_000


def best_first_growth(degrees: DataFrame, edges: DataFrame, target: int, multiplier: float = 2.0) -> DataFrame:
    """(node, place) of exactly ``target`` connected nodes, the best neighbour of what is taken first.

    The order depends on every step before, so it runs on the driver, over the largest
    component of a pool of ceil(target * multiplier) nodes. While that component is under
    the target and there are more nodes, the pool doubles. A pool over ``GROWTH_NODES`` or
    ``GROWTH_EDGES`` raises, as does a graph without a component of the target's size.
    """
    size = math.ceil(target * multiplier)
    while True:
        if size > GROWTH_NODES:
            raise ValueError(f"a pool of {size} nodes is over {GROWTH_NODES}")
        nodes, inner = degree_pool(degrees, edges, size)
        if nodes.count() >= target:
            break
        if degrees.limit(size + 1).count() <= size:
            raise ValueError("the graph's largest component is under the target")
        size = max(1, size) * 2
    if inner.limit(GROWTH_EDGES + 1).count() > GROWTH_EDGES:
        raise ValueError("the pool's largest component has too many edges")
    key = {r["node"]: (-r["degree"], r["node"]) for r in nodes.collect()}
    near: dict = {}
    for r in inner.toLocalIterator():
        near.setdefault(r["src"], []).append(r["dst"])
        near.setdefault(r["dst"], []).append(r["src"])
    heap = [min(key.values())] if target else []
    queued, taken = {heap[0][1]} if heap else set(), []
    while len(taken) < target:
        node = heapq.heappop(heap)[1]
        taken.append(node)
        for other in near.get(node, ()):
            if other not in queued:
                queued.add(other)
                heapq.heappush(heap, key[other])
    return edges.sparkSession.createDataFrame([(x, i) for i, x in enumerate(taken)], f"node {dict(nodes.dtypes)['node']}, place long")


def pick_levels(sizes: dict[int, int], targets: list[int]) -> tuple[dict[int, list[int]], list[int]]:
    """(targets by level, targets under the last size): the level nearest in size, never the last."""
    last = max(sizes)
    if last == min(sizes):
        raise ValueError("a hierarchy needs two levels")
    out: dict[int, list[int]] = {}
    small = [t for t in targets if t < sizes[last]]
    for t in targets:
        if t not in small:
            out.setdefault(min((level for level in sizes if level != last), key=lambda v: (abs(sizes[v] - t), v)), []).append(t)
    return out, small
