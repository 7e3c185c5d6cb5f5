"""Text operators: positional co-occurrence and sentence contexts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token) of lower-cased a-z runs."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "token"))


def cooccurrence(docs: DataFrame, window: int = 4, least: int = 20) -> DataFrame:
    """(a, b, n): unordered pairs of different tokens within ``window`` places, n at least ``least``.

    Partners come from an array slice of the own document, so there is no join.
    """
    seq = docs.select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = seq.select("w", F.posexplode("w").alias("pos", "x")).select("x", F.explode(F.slice("w", F.col("pos") + 2, F.lit(window - 1))).alias("y"))
    named = pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return named.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


COOCCURRENCE_SQL = """
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) as pos from documents where lang = 'en')
select least(x.token, y.token) as a, greatest(x.token, y.token) as b, count(*) as n
from w x join w y on x.doc_id = y.doc_id and y.pos between x.pos + 1 and x.pos + 3 and x.token <> y.token
group by 1, 2 having count(*) >= 20
"""


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, place, sentence)."""
    parts = F.filter(F.transform(F.split("text", "[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("place", "sentence"))


def contexts(docs: DataFrame, concept: str, reach: int = 3) -> DataFrame:
    """(doc_id, place, context): sentences that hold a concept with ``reach`` sentences around."""
    around = W.partitionBy("doc_id").orderBy("place").rowsBetween(-reach, reach)
    rows = sentences(docs).withColumn("context", F.array_join(F.collect_list("sentence").over(around), " "))
    return rows.filter(F.contains(F.lower("sentence"), F.lit(concept))).select("doc_id", "place", "context")


def graphon_descriptor(edges: DataFrame, grid: int = 16, values: int = 8, blocks: int = 4) -> np.ndarray:
    """Descriptor of an undirected graph (src, dst, weight): leading singular values of its degree-ordered
    grid, mean, degree mean, deviation and 90th percentile (degrees over the largest), and block means.

    A cell of the grid is the mean weight over its node pairs, over the largest cell, so
    only grid x grid numbers reach the driver.
    """
    from ..session import materialize
    from ..sources.store import numbered

    degree = materialize(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")).withColumn("down", -F.col("degree")), "degree")
    n, top = degree.agg(F.count("*"), F.max("degree")).first()
    if not n:
        return np.zeros(values + 4 + blocks * blocks)
    cell = numbered(degree, ["down", "id"], "place").select("id", F.floor(F.col("place") * grid / n).cast("int").alias("g"))
    cell = materialize(cell, "cells")
    a, b = cell.select(F.col("id").alias("src"), F.col("g").alias("x")), cell.select(F.col("id").alias("dst"), F.col("g").alias("y"))
    size = np.zeros(grid)
    for r in cell.groupBy("g").agg(F.count("*").alias("n")).collect():
        size[r["g"]] = r["n"]
    w = np.zeros((grid, grid))
    for r in edges.join(a, "src").join(b, "dst").groupBy("x", "y").agg(F.sum("weight").alias("w")).collect():
        w[r["x"], r["y"]] = r["w"]
    w = w / np.maximum(np.outer(size, size), 1)
    w = w / w.max() if w.max() > 0 else w
    stats = degree.select((F.col("degree") / top).alias("d")).agg(F.avg("d"), F.stddev_pop("d"), F.percentile("d", 0.9)).first()
    single = np.linalg.svd(w, compute_uv=False)[:values]
    means = w.reshape(blocks, grid // blocks, blocks, grid // blocks).mean(axis=(1, 3))
    return np.concatenate([np.pad(single, (0, values - len(single))), [w.mean(), *stats], means.ravel()])


class ConceptIndex:
    """Concepts of a corpus by their co-occurrence neighbours: ``fit(docs)``, then ``search(concept, k)``.

    A concept is a token with a pair of at least ``least`` co-occurrences; two concepts are
    as alike as the cosine of their neighbour counts.
    """

    def __init__(self, window: int = 4, least: int = 20) -> None:
        self.window, self.least = window, least

    def fit(self, docs: DataFrame) -> ConceptIndex:
        from ..session import materialize

        pairs = cooccurrence(docs, self.window, self.least)
        both = pairs.select("a", "b", "n").union(pairs.select("b", "a", "n"))
        norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("a")))
        self.weights = materialize(both.withColumn("w", F.col("n") / norm).select("a", "b", "w"), "concepts")
        return self

    def search(self, concept: str, k: int = 5) -> DataFrame:
        """(concept, similarity) of the k most alike concepts, itself excluded; none for an unknown one."""
        own = self.weights.filter(F.col("a") == concept).select("b", F.col("w").alias("q"))
        near = self.weights.filter(F.col("a") != concept).join(own, "b").groupBy(F.col("a").alias("concept")).agg(F.round(F.sum(F.col("w") * F.col("q")), 9).alias("similarity"))
        return near.orderBy(F.desc("similarity"), "concept").limit(k)
