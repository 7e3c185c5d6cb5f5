"""Packing along a space-filling curve.

A document's vector is the histogram of its token ids hashed to ``BUCKETS`` places,
projected by random signs to ``DIMENSIONS`` coordinates of the normalised vector. Its
Hilbert key orders the documents; ranges of the curve are packed by one task each, and
every task cuts its run of tokens into sequences of ``LENGTH``. The end of a run is cut
into powers of two, which need no padding.

The ranges come from approximate quantiles of the keys of a hashed sample of documents
(1 in ``SAMPLE``): they only balance the tasks, each document is packed whatever they
are. The key is followed by bits of the doc_id's hash, so a third of all documents with
one vector still spreads over many ranges. Texts are tokenised once and ids travel as 16
bits each.

Ids are those of ``byte_bpe_50k.json`` by the tokenizers library with its defaults. The
same vocabulary is read as ranks by tiktoken, which is about four times as fast, for texts
of characters below U+0250, where both libraries' Unicode classes agree, that hold none of
the vocabulary's added tokens; any other text goes through tokenizers itself.

Defined cases: a null or empty text is the closing id 0 alone; repeated rows are packed
each for itself; equal keys are ordered by doc_id; a null doc_id sorts first; an empty
table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import table

LENGTH = 1024
CLOSE = 0
BUCKETS = 1024
DIMENSIONS = 4
#: Bits of a coordinate on the Hilbert grid, and bits of the doc_id's hash behind the key.
GRID_BITS = 10
TIE_BITS = 22
SAMPLE = 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
_SAFE = re.compile("[\x00-ɏ]*")


class Tokenizer:
    """Ids of texts, equal to those of tokenizers; one for each Python worker."""

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.full = public_tokenizers.path("byte_bpe_50k.json"), None
        with open(self.path, encoding="utf-8") as f:
            self.added = tuple(t["content"] for t in json.load(f)["added_tokens"])

    def exact(self, text: str) -> list[int]:
        if self.full is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Full

            self.full = Full.from_file(self.path)
        return self.full.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids, closed by ``CLOSE``."""
        if not text:
            return np.array([CLOSE], np.uint16)
        plain = _SAFE.fullmatch(text) and not any(t in text for t in self.added)
        found = self.fast.encode_ordinary(text) if plain else self.exact(text)
        return np.array([*found, CLOSE], np.uint16)


def hilbert(coordinates: list[int], bits: int) -> int:
    """Key of a grid point on the Hilbert curve (Skilling's transpose form)."""
    x, n = list(coordinates), len(coordinates)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


class Curve:
    """Hilbert keys of token id arrays. The projection is seeded, so all tasks agree."""

    def __init__(self) -> None:
        random = np.random.default_rng(7)
        self.bucket = random.integers(0, BUCKETS, 1 << 16)
        self.signs = random.choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))

    def key(self, ids: np.ndarray) -> int:
        counts = np.sqrt(np.bincount(self.bucket[ids], minlength=BUCKETS))
        point = counts @ self.signs / np.sqrt(counts @ counts)
        grid = np.clip((np.tanh(point) + 1) / 2 * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1).astype(int)
        return hilbert(grid.tolist(), GRID_BITS)


def _keyed(bounds: list[int] | None):
    """Arrow function: the place of each document on the curve, and with bounds its range and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, curve = Tokenizer(), Curve()
        limits = np.array(bounds or [], np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                ids = [tokenizer.ids(t.as_py()) for t in some.column("text")]
                place = np.array([curve.key(x) for x in ids], np.int64) << TIE_BITS | some.column("tie").to_numpy(zero_copy_only=False)
                if bounds is None:
                    yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])
                else:
                    part = np.searchsorted(limits, place, "right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(place), some.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "place", "doc_id", "ids"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the partition's run of documents into sequences; only the pieces are held."""
    from pyspark import TaskContext

    sequence = TaskContext.get().partitionId() << 40
    room: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
    held = 0

    def close(pieces: list[tuple], at: int) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, at, offset))
            offset += len(ids)
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(_FIELDS))], _FIELDS)

    for batch in batches:
        rows = []
        for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            ids = np.frombuffer(blob.as_buffer(), np.uint16)
            start = 0
            while start < len(ids):
                cut = ids[start : start + LENGTH - held]
                room.append((doc, start, cut.copy() if start + len(cut) == len(ids) else cut, len(ids)))
                held += len(cut)
                start += len(cut)
                if held == LENGTH:
                    rows += close(room, sequence)
                    sequence, room, held = sequence + 1, [], 0
        yield batch_of(rows)
    rows, width = [], LENGTH
    while held:  # the end: sequences of powers of two
        while width > held:
            width //= 2
        full, left, taken = [], [], 0
        for doc, start, ids, total in room:
            cut = ids[: max(0, width - taken)]
            taken += len(cut)
            if len(cut):
                full.append((doc, start, cut, total))
            if len(cut) < len(ids):
                left.append((doc, start + len(cut), ids[len(cut) :], total))
        rows += close(full, sequence)
        sequence, room, held = sequence + 1, left, held - width
    yield batch_of(rows)


def pack(docs: DataFrame) -> DataFrame:
    """The pieces of all documents; see ``SCHEMA``."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    rows = docs.select("doc_id", "text", tie.alias("tie"))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(SAMPLE)) == 0)
    shares = [i / parts for i in range(1, parts)]
    bounds = sample.mapInArrow(_keyed(None), "place long").agg(F.percentile_approx("place", shares or [0.5], 10_000)).first()[0] or []
    keyed = rows.mapInArrow(_keyed(sorted(bounds)), "part int, place long, doc_id long, ids binary")
    ranged = keyed.repartitionById(max(parts, len(bounds) + 1), F.col("part")).sortWithinPartitions("place", "doc_id")
    return ranged.select("doc_id", "ids").mapInArrow(_pack, SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
