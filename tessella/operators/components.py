"""Connected components of an undirected edge table, as short materialised rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _lower(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (a, b) to (u, m): every end with the smallest of itself and its neighbours."""
    least = edges.groupBy(F.col(a).alias("k")).agg(F.min(b).alias("least"))
    return least.select("k", F.least("k", "least").alias("m"))


def components(edges: DataFrame, left: str = "src", right: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge touches; root is the smallest node reachable.

    Alternates large-star and small-star steps. Each step groups by node with a
    partial aggregate and joins the minimum back, so a hub's edges stay spread over
    tasks. The number of rounds grows with the logarithm of the component's size.
    Self-loops and null ends are ignored; an empty table gives no rows.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lower(both, "a", "b"), both.a == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        small = down.join(_lower(down, "a", "b"), down.a == F.col("k"))
        star = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        e = materialize(star.filter("a <> b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
