"""Mixing sources to target weights.

Words are counted per document, summed per source, and turned into repetition rates;
a document is emitted ``floor(rate)`` times plus one copy drawn by a seeded hash of its
doc_id with the rate's fraction as probability, so reruns agree.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share
``EPOCHS`` times all words; a source stops at ``MAX_RATE`` times its own words and what
is over goes to the others by weight, until none is above. That is the water level L
with sum(min(weight * L, cap)) = budget, found from the sources in order of cap / weight.

Defined cases: null text has 0 words; a source without words has target and rate 0;
the null source is a source of its own; repeated rows get the same draw; an empty table
gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import NOT_SPACE, fresh, table

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MAX_RATE = 2
SEED = 17
#: Rows of the per-source table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE)).cast("long")


def source_rates(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, rate), a row for each source of ``sized(source, size)``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod("place", F.lit(len(WEIGHTS)))).cast("double")
    caps = ranked.select("source", "source_size", "place", weight.alias("weight"), (F.col("source_size") * MAX_RATE).cast("double").alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    level = caps.withColumns({
        "budget": F.sum("source_size").over(W.partitionBy()) * EPOCHS,
        "full": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    # the level if all before this source are full: right for the first that then stays below its cap
    level = level.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    level = level.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(W.partitionBy())["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_RATE)), target / F.col("source_size"))).otherwise(0.0)
    return level.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(doc_id: Column, rate: Column) -> Column:
    """floor(rate), and one more where the document's hash falls under the fraction."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_rates(sized: DataFrame, left: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``left`` with the columns of its source's rates, and how these are named there."""
    rates = materialize(source_rates(sized), "rates")
    names = {c: fresh(left, f"__{c}") for c in rates.columns}
    rates = rates.select(*[F.col(c).alias(n) for c, n in names.items()])
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    return left.join(rates, left["source"].eqNullSafe(F.col(names["source"]))), names


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, rate and copies."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out, names = _with_rates(sized, sized)
    out = out.withColumn("copies", copies(F.col("doc_id"), F.col(names["rate"])))
    return out.select("doc_id", "size", F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), F.col(names["rate"]).alias("rate"), "copies")


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    out, names = _with_rates(sized, docs)
    times = F.array_repeat(F.lit(0), copies(docs["doc_id"], F.col(names["rate"])).cast("int"))
    copy = fresh(docs, "__copy")
    return out.select(*[docs[c] for c in docs.columns], F.explode(times).alias(copy)).drop(copy)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
