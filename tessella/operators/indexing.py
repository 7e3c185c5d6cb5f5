"""Global orders without a global task: rows are dealt by range and numbered within ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.store import numbered


def node_index(assertions: DataFrame) -> DataFrame:
    """(uri, id): all endpoints numbered from 0 in the order of their URIs."""
    return numbered(assertions.select(F.col("start_uri").alias("uri")).union(assertions.select("end_uri")).distinct(), ["uri"], "id")


def indexed_edges(assertions: DataFrame) -> DataFrame:
    """(src, dst, weight) over node numbers, weights of parallel edges added."""
    n = materialize(node_index(assertions), "index")
    a, b = n.select(F.col("uri").alias("start_uri"), F.col("id").alias("src")), n.select(F.col("uri").alias("end_uri"), F.col("id").alias("dst"))
    # parallel edges are added before the two joins, which then see each pair once
    pairs = assertions.groupBy("start_uri", "end_uri").agg(F.sum("weight").alias("weight"))
    return pairs.join(a, "start_uri").join(b, "end_uri").select("src", "dst", F.round("weight", 6).alias("weight"))


def sorted_candidates(edges: DataFrame) -> DataFrame:
    """(place, src, dst, distance): pairs by (1 / weight, src, dst), numbered from 1."""
    rows = edges.groupBy("src", "dst").agg((1 / F.sum("weight")).alias("w"))
    return numbered(rows, ["w", "src", "dst"], "at").select((F.col("at") + 1).alias("place"), "src", "dst", F.round("w", 6).alias("distance"))


def finalised(members: DataFrame) -> DataFrame:
    """(fine, cluster): clusters numbered by their smallest member."""
    least = numbered(members.groupBy("coarse").agg(F.min("fine").alias("least")), ["least"], "cluster")
    return members.join(least, "coarse").select("fine", "cluster")


def graphon_grid(edges: DataFrame, side: int = 16) -> DataFrame:
    """(gx, gy, w): weights binned by the place of both ends in falling order of degree."""
    d = edges.groupBy(F.col("src").alias("id")).agg((-F.count("*")).alias("down"))
    ranked = materialize(numbered(d, ["down", "id"], "r"), "ranked")
    cell = F.floor(F.col("r") * float(side) / F.lit(ranked.count()))
    a, b = ranked.select(F.col("id").alias("src"), cell.alias("gx")), ranked.select(F.col("id").alias("dst"), cell.alias("gy"))
    return edges.join(a, "src").join(b, "dst").groupBy("gx", "gy").agg(F.round(F.sum("weight"), 6).alias("w"))
