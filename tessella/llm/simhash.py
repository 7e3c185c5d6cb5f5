"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint has a bit set where over half of the text's 3-word shingle hashes
have it. Distinct fingerprints are cut into three segments, each read as a 23-bit word
of the perfect Golay code. With two errors in all, some pair of segments holds at most
one of them (pigeonhole), so one of the two agrees exactly and the other lies within
one bit. A word's keys are the indices of the codewords within distance 4, one to six of
them; words one bit apart always share a word's own (nearest) codeword. Every
fingerprint is filed under its keys for each pair of segments, neighbours in a bucket
are verified by popcount, and the links become components.

A bucket over ``BUCKET`` fingerprints is not compared pair by pair: its members are
filed exactly, under all values one bit away. Two fingerprints share such a value if and
only if they differ in at most two bits, and at most 65 can hold one value, so no link
is lost and no group is large.

Defined cases: null and empty texts have fingerprint 0 and link like any other; equal
fingerprints are one class; repeated rows get the same result; an empty table gives an
empty result; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import materialize, shuffle_partitions
from .common import table
from .golay import Golay

SHINGLE = 3
SEED = 42
#: Links join fingerprints with at most so many differing bits; the keys are made for 2.
MAX_BITS = 2
BUCKET = 32
#: Bit widths of the segments.
SEGMENTS = (22, 21, 21)

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    each = hashes.view(np.uint8).reshape(-1, 8)
    value = 0
    for byte in range(8):
        counts = np.bincount(each[:, byte], minlength=256) @ _BITS
        value |= int(np.packbits(2 * counts > len(hashes), bitorder="little")[0]) << (8 * byte)
    return value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): each fingerprint's keys, for the three pairs of segments."""
    parts, low = [], 0
    for width in SEGMENTS:
        parts.append((fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
        low += width
    near = [code.near(p) for p in parts]
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for own, other, own_first in ((i, j, True), (j, i, False)):
            first, (all_, counts) = near[own][0][:, :1], near[other]
            key = (pair << 24) | ((first << 12 | all_) if own_first else (all_ << 12 | first))
            row = np.broadcast_to(np.arange(len(fps))[:, None], key.shape)
            rows.append(row[counts])
            keys.append(key[counts])
    return np.concatenate(rows), np.concatenate(keys)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 20_000):
            some = fps[i : i + 20_000]
            row, key = golay_keys(some.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], ["key", "fp"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within buckets, sorted by key and fp; (a, null) for members of a large bucket."""
    key_left, fp_left, large = np.empty(0, np.int64), np.empty(0, np.int64), None

    def found(key: np.ndarray, fp: np.ndarray, last: bool) -> tuple[list, list, int, int]:
        nonlocal large
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        in_large = np.repeat(size > BUCKET, size)
        if large is not None and len(key) and key[0] == large:
            in_large[: size[0]] = True
        done = len(key)
        if not last and len(size):
            if in_large[-1]:
                large = key[-1]
            else:  # the last bucket may go on
                done = start[-1]
        a, b = [fp[:done][in_large[:done]]], [np.zeros(0, np.int64)]
        hot = len(a[0])
        key, fp, small = key[:done], fp[:done], ~in_large[:done]
        for d in range(1, BUCKET):
            near = (key[d:] == key[:-d]) & small[d:]
            if not near.any():
                break
            x, y = fp[:-d][near], fp[d:][near]
            ok = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS)
            a.append(x[ok])
            b.append(y[ok])
        return a, b, hot, done

    def batch_of(a: list, b: list, hot: int) -> pa.RecordBatch:
        left, right = np.concatenate(a), np.concatenate(b)
        links = np.unique(np.stack([left[hot:], right], axis=1), axis=0) if len(right) else np.empty((0, 2), np.int64)
        flagged = np.unique(left[:hot])
        return pa.RecordBatch.from_arrays([pa.array(np.r_[links[:, 0], flagged]), pa.array(np.r_[links[:, 1], flagged], mask=np.r_[np.zeros(len(links), bool), np.ones(len(flagged), bool)])], ["a", "b"])

    for batch in batches:
        key = np.r_[key_left, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp_left, batch.column(1).to_numpy(zero_copy_only=False)]
        a, b, hot, done = found(key, fp, False)
        key_left, fp_left = key[done:], fp[done:]
        yield batch_of(a, b, hot)
    if len(key_left):
        a, b, hot, _ = found(key_left, fp_left, True)
        yield batch_of(a, b, hot)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``; their closure is that of all links."""
    parts = shuffle_partitions(distinct.sparkSession)
    filed = distinct.select("fp").mapInArrow(_file, "key long, fp long")
    found = materialize(filed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_verify, "a long, b long").distinct(), "links")
    hot = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    near = hot.select("fp", F.explode(flips).alias("value")).groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter("size(fps) > 1")
    star = near.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return found.filter("b is not null").union(star)


def _named_rows(fps: DataFrame, named: DataFrame) -> DataFrame:
    """``fps`` with component_id. Fingerprints of many documents are joined apart.

    Those over 1 / (4 * partitions) of all rows number under 4 * partitions: they are
    broadcast, and no task of the shuffled join gets a large group.
    """
    limit = fps.count() / (4 * shuffle_partitions(fps.sparkSession))
    hot = F.broadcast(named.filter(F.col("n") > limit).drop("n"))
    rest = named.filter(F.col("n") <= limit).drop("n")
    many = fps.join(hot, fps.fp == hot.key)
    few = fps.join(hot, fps.fp == hot.key, "left_anti").join(rest, fps.fp == rest.key)
    return many.unionByName(few)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = materialize(components(links(classes), "a", "b"), "roots")
    # only classes with a link have a root; the others are their own component
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = linked.join(least, "root").select("fp", "component_id")
    named = classes.join(of_class, "fp", "left").select(F.col("fp").alias("key"), F.coalesce("component_id", "first").alias("component_id"), "n")
    out = _named_rows(fps, materialize(named, "named"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
