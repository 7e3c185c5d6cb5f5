"""Document fingerprints by consistent weighted sampling.

Terms are the distinct words of a text, weighted by their counts. For each of ``SAMPLES``
hash functions a term draws r and c from Gamma(2, 1) and b from Uniform(0, 1), all from its
own hash; with t = floor(ln w / r + b) its score is ln c - r * (t - b + 1), and the least
score wins. Two texts pick the same (term, t) with a probability equal to the
generalised Jaccard similarity of their weights.

All stays in generated JVM code: documents are shuffled once, by blocks of neighbouring
doc_ids, and every later grouping is within a block, so it needs no further exchange.
Scores are rounded to 2^-31 and carry 24 bits that name the pick, so a sample is one
long and its minimum is a plain aggregate.

A text's least score lies under ln(EXPECTED / words) but for exp(-EXPECTED) of the samples.
So terms whose score is surely above are left out by bounds with fewer logarithms or none,
before they are grouped; the texts with a sample that has no term under that (about 0.6 %)
are sampled again without a bound. Results are those of all scores.

The next document, in descending doc_id, is found within the block; only a block's first
document is sent to the block above. Quantiles of doc_id cut the documents into zones, a
zone into blocks by linear interpolation; an id that fills a quantile is a zone of its own
and is cut by the hash of the text, like the rows without an id. So blocks are even for
outliers, for ids at both ends of long and for ids in groups, and bounds never change a
result, since every cut keeps the order.

Defined cases: a null or empty text has no terms and the fingerprint of all zeros;
rows with one doc_id follow each other by falling hash of the text; a null doc_id
comes last; a single document is its own successor; an empty table gives an empty
result; other columns are untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import NOT_SPACE, let, table, words

SAMPLES = 64
#: Scores of a text that are looked at for each sample, on average.
EXPECTED = 10
#: Documents to a block, on average, blocks to a group of blocks, and quantiles of doc_id.
BLOCK = 64
BLOCKS = 1024
ZONES = 256
_NAME_BITS = 24
_UNIT = float(1 << 21)
_FINE = float(1 << 31)


def _uniform(h: Column, low: int) -> Column:
    """A uniform value in (0, 1] from 21 bits of a hash."""
    return (F.shiftrightunsigned(h, low).bitwiseAND((1 << 21) - 1) + 1) / _UNIT


def _gamma(h: Column) -> Column:
    """A value from Gamma(2, 1) of the lower 42 bits of a hash, never 0."""
    return -F.log(_uniform(h, 0) * _uniform(h, 21) * (1 - 1e-12))


def blocks(docs: DataFrame) -> Column:
    """Block of a row with ``doc_id`` and ``th``: it rises with doc_id, then th; rows without an id come first."""
    n, found, some, low, high = docs.agg(
        F.count("*"), F.percentile_approx("doc_id", [i / ZONES for i in range(1, ZONES)], 10_000), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")
    ).first()
    share = some / ZONES  # documents to a quantile
    cuts: dict[int, int] = {}
    for q in found or []:
        cuts[q] = cuts.get(q, 0) + 1
    # zones: rows without an id, then by turns the ids between two cuts and a cut itself
    zones, last, at = [(None, None, n - some)], low, 0
    for q, times in cuts.items():
        zones += [(last, q, share), (None, None, times * share)]
        last = q
    zones.append((last, high, share))
    lows, widths, sizes, starts = [], [], [], []
    for a, b, rows in zones:
        lows.append(float(a or 0))
        widths.append(0.0 if a is None else float(max(1, b - a)))
        sizes.append(max(1, math.ceil(rows / BLOCK)))
        starts.append(at)
        at += sizes[-1]
    bounds = F.array(*[F.lit(q) for q in cuts]).cast("array<bigint>")
    doc = F.col("doc_id")
    zone = F.when(doc.isNull(), 0).otherwise(1 + 2 * F.size(F.filter(bounds, lambda q: q < doc)) + F.array_contains(bounds, doc).cast("int"))

    def of(z: Column) -> Column:
        low_, width, size, start = (F.get(F.array(*map(F.lit, x)), z) for x in (lows, widths, sizes, starts))
        by_hash = F.col("th").cast("double") / float(1 << 64) + 0.5
        part = F.when(width > 0, (doc.cast("double") - low_) / F.greatest(width, F.lit(1.0))).otherwise(by_hash)
        return start + F.greatest(F.lit(0), F.least(size - 1, F.floor(part * size)))

    return let(zone, of).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """block, place, doc_id, text, next_text, next_block, next_place: each document and its successor."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.withColumn("block", blocks(docs))

    # the blocks in use, each with the next one below it; after the last the first
    used = rows.groupBy("block").agg(F.max(F.struct("doc_id", "th")).alias("first"))
    used = materialize(used.select("block", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"), F.floor(F.col("block") / BLOCKS).alias("group")), "blocks")
    groups = used.groupBy("group").agg(F.max("block").alias("top"))
    over_groups = W.orderBy(F.desc("group"))
    groups = groups.select("group", F.coalesce(F.lead("top").over(over_groups), F.first("top").over(over_groups)).alias("below"))
    inner = used.withColumn("lower", F.lead("block").over(W.partitionBy("group").orderBy(F.desc("block"))))
    follows = inner.join(groups, "group").select("block", F.coalesce("lower", "below").alias("next_block"))

    firsts = used.select(F.col("block").alias("__block"), "first_id", "first_th")
    first = (rows.block == F.col("__block")) & (rows.th == F.col("first_th")) & rows.doc_id.eqNullSafe(F.col("first_id"))
    head = rows.join(firsts, first).groupBy("block").agg(F.min("text").alias("head"))
    below = follows.join(head.withColumnRenamed("block", "next_block"), "next_block").select(F.col("block").alias("__block"), "next_block", "head")

    order = W.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("th"), "text")
    placed = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("lead"))
    placed = placed.join(below, placed.block == F.col("__block"))
    last = F.col("lead").isNull()
    return placed.select(
        "block", "place", "doc_id", "text", F.coalesce("lead", "head").alias("next_text"),
        F.when(last, F.col("next_block")).otherwise(F.col("block")).alias("next_block"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half replaced by the beginning of the next one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def _where(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` where ``condition`` holds. No filter moves below a column that is not deterministic; it would draw anew at each mention."""
    return rows.withColumn("__kept", F.when(condition, F.spark_partition_id())).where(F.col("__kept").isNotNull()).drop("__kept")


def _may_count(dealt: DataFrame) -> DataFrame:
    """The rows whose c * exp(-r * (t - b + 1)) may be up to ``most``, told without a logarithm.

    With U = exp(-c), V = exp(-r): c >= 4 (1 - sqrt(U)) / (1 + sqrt(U)). For weight 1 the other factor is
    V^(1 - b), over the weighted harmonic mean (q / (1 - b + b q))^8 of q = V^(1/8) and 1; for weight w
    it is over V / w. b = 1 counts as 0.
    """
    h, g, p, q, d, v = map(F.col, "hgpqdv")
    share = (F.shiftrightunsigned(h, 42) + 1).bitwiseAND((1 << 21) - 1) * F.col("single") / _UNIT
    rows = dealt.select("*", (_uniform(h, 0) * _uniform(h, 21)).alias("v"), F.sqrt(_uniform(g, 0) * _uniform(g, 21)).alias("p"), share.alias("f"))
    rows = rows.withColumn("q", F.sqrt(F.sqrt(F.sqrt(v)))).withColumn("d", 1 - F.col("f") * (1 - q))
    rows = rows.withColumn("d", d * d).withColumn("d", d * d)
    return _where(rows, (1 - p) * 4 * v <= (1 + p) * F.col("most") * d * d)


def _may_count_by_step(drawn: DataFrame) -> DataFrame:
    """As ``_may_count``, for a weight w of each side: r * (t - b + 1) is ln w + r * (1 - f), with f the part of ln w / r + b over t."""
    p, q, v = map(F.col, "pqv")
    rows = drawn.select("*", *[(1 - (F.col(f"y{side}") - F.col(f"t{side}")) * (1 - q)).alias(f"d{side}") for side in (0, 1)])
    for _ in range(2):
        rows = rows.withColumns({f"d{side}": F.col(f"d{side}") * F.col(f"d{side}") for side in (0, 1)})
    may = [(1 - p) * 4 * v <= (1 + p) * F.col(f"most{side}") * F.col(f"d{side}") * F.col(f"d{side}") for side in (0, 1)]
    return _where(rows, F.coalesce(may[0], F.lit(False)) | F.coalesce(may[1], F.lit(False)))


def _both(first: Column, second: Column) -> Column:
    """Two numbers under 2^31 in one long."""
    return first.cast("long") + F.shiftleft(second.cast("long"), 32)


def _apart(name: str, to: str) -> list[Column]:
    return [F.col(name).bitwiseAND((1 << 32) - 1).alias(f"{to}0"), F.shiftrightunsigned(name, 32).alias(f"{to}1")]


def signatures(texts: DataFrame, keys: list[str], partition: str, expected: float | None = None) -> DataFrame:
    """``keys`` and, for ``a`` and ``b``, an array of sampled terms and the number of them found; texts without terms are absent.

    ``texts`` is partitioned by the column ``partition``, which is among ``keys``. With ``expected``
    only scores below a bound are looked at, under which that many lie on average: a sample
    that is found is the right one, and exp(-expected) of the samples are not found.
    """
    split = texts.select(*keys, words(F.col("a")).alias("w0"), words(F.col("b")).alias("w1"))
    bounds = [] if expected is None else ["sizes"]
    if bounds:
        split = split.select("*", _both(F.size("w0"), F.size("w1")).alias("sizes"))
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"w{side}").alias("t")) for side in (0, 1)]))
    terms = split.select(*keys, *bounds, sides.alias("s")).select(*keys, *bounds, "s.side", F.explode("s.t").alias("word"))
    # a term of both texts has the same draws in both; both counts in one long keep the groups small
    counts = F.sum(F.when(F.col("side") == 0, F.lit(1)).otherwise(F.lit(1 << 32))).alias("counts")
    weighted = terms.select(*keys, *bounds, "side", F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(counts, *[F.max(x).alias(x) for x in bounds])
    weighted = weighted.select("*", *_apart("counts", "n"))
    if bounds:
        # exp of the least score is exponentially distributed, at the rate of the number of words
        weighted = weighted.select("*", *_apart("sizes", "z"))
        weighted = weighted.select("*", *[(F.lit(float(expected)) / F.greatest(F.col(f"z{side}"), F.lit(1))).alias(f"x{side}") for side in (0, 1)])
    about = [F.log(F.nullif(F.col(f"n{side}"), F.lit(0)).cast("double")).alias(f"lw{side}") for side in (0, 1)]
    if bounds:
        about += [F.floor((F.log(f"x{side}") + 96) * _FINE).alias(f"top{side}") for side in (0, 1)]
        about += [(F.col(f"n{side}") * F.col(f"x{side}") * (1 + 1e-6)).alias(f"most{side}") for side in (0, 1)]
        about.append((F.greatest(F.col("n0") * F.col("x0"), F.col("n1") * F.col("x1")) * (1 + 1e-6)).alias("most"))
        about.append(F.when(F.greatest("n0", "n1") == 1, 1).otherwise(0).alias("single"))
    tops = ["top0", "top1"] if bounds else []
    dealt = weighted.select(*keys, "term", *about).select("*", F.explode(F.array(*[F.lit(i) for i in range(SAMPLES)])).alias("lane"))
    dealt = dealt.withColumn("h", F.xxhash64("term", "lane")).withColumn("g", F.xxhash64("h"))
    if bounds:
        dealt = _may_count(dealt)
    h, g = F.col("h"), F.col("g")
    held = ["g", "v", "p", "q", "most0", "most1"] if bounds else ["g"]
    dealt = dealt.select(*keys, "lane", "lw0", "lw1", *tops, *held, _gamma(h).alias("r"), _uniform(h, 42).alias("b"))
    dealt = dealt.select("*", *[(F.col(f"lw{side}") / F.col("r") + F.col("b")).alias(f"y{side}") for side in (0, 1)])
    dealt = dealt.select("*", *[F.floor(f"y{side}").alias(f"t{side}") for side in (0, 1)])
    if bounds:
        dealt = _may_count_by_step(dealt)
    dealt = dealt.select(*keys, "lane", *tops, "g", "r", "b", "t0", "t1", F.log(_gamma(g)).alias("c"))

    def score(side: int) -> Column:
        r, c, b, t = (F.col(x) for x in ("r", "c", "b", f"t{side}"))
        # over -28 - 29 - ln w, so over -96 for any text, and under 4; null for a term that is not in the text
        return F.floor((c - r * (t - b + 1) + 96) * _FINE).cast("long").alias(f"s{side}")

    def sample(side: int) -> Column:
        s, t = F.col(f"s{side}"), F.col(f"t{side}")
        # bits of the hash that the draws leave over, with t
        name = F.shiftrightunsigned(g, 64 - _NAME_BITS).bitwiseXOR(t).bitwiseAND((1 << _NAME_BITS) - 1)
        known = s <= F.col(f"top{side}") if bounds else s.isNotNull()
        return F.when(known, F.shiftleft(s, _NAME_BITS) + name).alias(f"m{side}")

    dealt = dealt.select("*", score(0), score(1)).select(*keys, "lane", sample(0), sample(1))
    if bounds:
        dealt = _where(dealt, F.col("m0").isNotNull() | F.col("m1").isNotNull())
    # least and greatest skip nulls
    lanes = dealt.groupBy(*keys, "lane").agg(F.min("m0").alias("m0"), F.min("m1").alias("m1"))
    # one row a text: lanes in order
    names = [F.coalesce(F.col(f"m{side}").bitwiseAND((1 << _NAME_BITS) - 1), F.lit(0)).cast("int").alias(f"n{side}") for side in (0, 1)]
    whole = lanes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lane", *names))).alias("lanes"), F.count("m0").alias("found_a"), F.count("m1").alias("found_b"))
    return whole.select(*keys, F.col("lanes.n0").alias("sig_a"), F.col("lanes.n1").alias("sig_b"), "found_a", "found_b")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return equal / float(SAMPLES)


def as_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), _NAME_BITS // 4, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and both likenesses."""
    pairs = with_next(docs)
    pairs = pairs.select("*", edited(F.col("text"), F.col("next_text")).alias("edit"))
    keys, none = ["block", "place"], F.array_repeat(F.lit(0), SAMPLES)

    def signed(about: DataFrame, rows: DataFrame, expected: float | None) -> DataFrame:
        sigs = signatures(rows.select(*keys, F.col("text").alias("a"), F.col("edit").alias("b")), keys, "block", expected)
        return about.join(sigs, keys, "left").withColumns({s: F.coalesce(s, none) for s in ("sig_a", "sig_b")})

    has = [F.col(t).rlike(NOT_SPACE).alias(f"has_{side}") for t, side in (("text", "a"), ("edit", "b"))]
    about = pairs.select(*keys, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit"), 256).alias("edited_sha256"), "next_block", "next_place", *has)
    lacking = [F.col(f"has_{side}") & (F.coalesce(f"found_{side}", F.lit(0)) < SAMPLES) for side in "ab"]
    found = signed(about, pairs, EXPECTED).withColumn("again", lacking[0] | lacking[1]).drop("has_a", "has_b", "found_a", "found_b")
    found = materialize(found, "signatures")
    # the few texts with a sample that was not found go again without a bound; texts do not pass a second exchange for them
    again = materialize(found.where("again").drop("again", "sig_a", "sig_b"), "again")
    found = found.where(~F.col("again")).drop("again")
    if not again.isEmpty():
        rest = signed(again, pairs.join(again.select(*keys), keys), None)
        found = found.unionByName(materialize(rest.select(*found.columns), "rest"))
    after = found.select(F.col("block").alias("next_block"), F.col("place").alias("next_place"), F.col("sig_a").alias("sig_next"))
    out = found.join(after, ["next_block", "next_place"])
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig_a")).alias("fingerprint"), as_text(F.col("sig_b")).alias("edited_fingerprint"), likeness(F.col("sig_a"), F.col("sig_b")).alias("near_edited"), likeness(F.col("sig_a"), F.col("sig_next")).alias("near_next"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
