"""Suffix-array dedup by a distributed merge sort of front-coded suffix runs.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id.
Sorting every suffix would exchange many times the input, so a cheap round first finds
the suffixes that can have a partner; the merge of all of these decides, byte by byte.

1. *Candidates.* The least of the hashed ``GRAM``-byte grams in a 50-byte window (leftmost
   on ties) is the window's anchor; equal windows have equal anchors. The windows of one
   anchor form a segment of 50 to 76 bytes. A task drops a segment whose bytes it holds
   already under a smaller doc_id (covered; the bytes are compared). Of the others the
   grams' hashes are exchanged: a segment whose gram is in one document only is unique.
   The hash decides nothing else; a clash costs a suffix more in the merge.
2. *Suffixes.* The suffixes at all other segments' anchors, as far as the segment goes,
   are sorted per task into runs, front-coded and exchanged by gram, with the bytes before
   the anchor. Each receiver combines its runs with a loser tree that keeps the length of
   the prefix known to be shared and compares only what follows. The shared lengths tell
   which suffixes agree as far as a window reaches; with equal bytes before the anchor
   the windows are equal, and all but the smallest doc_id's are covered.

Runs hold each distinct segment once with its smallest doc_id, so a passage in a third of
all documents is exchanged once a task. A receiver holds one of its ``SPLIT`` buckets at a
time. The places it finds go to the documents in one row a partition of documents, whatever
the number of documents, and meet the texts there. A task holds the places of its partition.

Defined cases: a null or empty text, and one under 50 bytes, loses nothing and has no
partner; equal strings in one document, or in rows with one doc_id, do not count; a null
doc_id counts as the largest; repeated rows get equal results; an empty table gives an
empty result; other columns are untouched. Offsets are in bytes of UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .common import table, xxhash_int, xxhash_long

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM + 1  # grams in a window
TILE = 1 << 19
NO_DOC = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEYS = np.random.default_rng(5).integers(1, 1 << 63, (2, 10), dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(6).integers(0, 1 << 32, 256, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of an (n, 8 * m) byte array."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    out = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        out += _mixed(words[:, j] + _KEYS[0, j]) * _KEYS[1, j]
    return _mixed(out)


def anchor_offsets(buffer: np.ndarray) -> np.ndarray:
    """For each window start, the anchor's offset in the window. Needs 50 bytes after the last start."""
    n = len(buffer) - LENGTH + 1
    out = np.empty(max(n, 0), np.uint8)
    for s in range(0, n, TILE):
        e = min(s + TILE, n)
        h = _BYTE[buffer[s : e + LENGTH - 1]]
        eight = None
        for size, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F)):
            if size == 8:
                eight = h
            h = h[:-size] * np.uint32(factor) + h[size:]
            h ^= h >> np.uint32(15)
        h = h[: len(eight) - 16] * np.uint32(0x165667B1) + eight[16:]
        h ^= h >> np.uint32(13)
        least, at, width = h, np.zeros(len(h), np.uint8), 1
        while width < REACH:
            step = min(width, REACH - width)
            right = least[step:] < least[:-step]
            at = np.where(right, at[step:] + np.uint8(step), at[:-step])
            least = np.minimum(least[:-step], least[step:])
            width += step
        out[s:e] = at[: e - s]
    return out


class Batch:
    """The documents of an Arrow batch in one buffer."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self.buffer = np.frombuffer(b"".join(texts) + bytes(80), np.uint8)
        self.doc = batch.column("d").to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = batch.column("th").to_numpy(zero_copy_only=False).astype(np.int32)

    def segments(self) -> tuple[np.ndarray, ...]:
        """(row, first window, number of further windows, anchor) of each segment, in the buffer's offsets."""
        total = len(self.buffer) - 80
        rows, firsts, more, anchors = [], [], [], []
        if total < LENGTH:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        offset = anchor_offsets(self.buffer[:total])
        room = np.zeros(total + 1, np.int8)  # window starts inside a document
        has = self.lengths >= LENGTH
        np.add.at(room, self.starts[has], 1)
        np.add.at(room, (self.starts + self.lengths - LENGTH + 1)[has], -1)
        valid = np.cumsum(room[: len(offset)], dtype=np.int8) > 0
        # a new segment: the anchor changes, a document begins, or windows begin again
        change = np.ones(len(offset), bool)
        change[1:] = offset[1:] + np.int16(1) != offset[:-1].astype(np.int16)
        change[1:] |= ~valid[:-1]
        change[self.starts[has]] = True
        first = np.flatnonzero(change & valid)
        end = np.flatnonzero(np.concatenate([(change | ~valid)[1:], [True]]) & valid)
        row = np.searchsorted(self.starts, first, "right") - 1
        return row, first, end - first, first + offset[first]

    def grams(self, anchor: np.ndarray) -> np.ndarray:
        """Hash of each anchor's gram."""
        out, rows = np.empty(len(anchor), np.uint64), sliding_window_view(self.buffer, GRAM)
        for i in range(0, len(anchor), 50_000):
            out[i : i + 50_000] = _hash_rows(rows[anchor[i : i + 50_000]])
        return out

    def bytes_of(self, first: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The bytes of each segment, filled up to 80 with zeros."""
        return sliding_window_view(self.buffer, 80)[first] * (np.arange(80) < (more + LENGTH)[:, None])

    def segment_hashes(self, first: np.ndarray, more: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.uint64)
        for i in range(0, len(first), 50_000):
            some = slice(i, i + 50_000)
            out[some] = _hash_rows(self.bytes_of(first[some], more[some])) ^ _mixed(more[some].astype(np.uint64))
        return out

    def same_bytes(self, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Whether the segments at ``a`` and at ``b`` have equal bytes."""
        out = np.empty(len(a), bool)
        for i in range(0, len(a), 50_000):
            some = slice(i, i + 50_000)
            out[some] = (self.bytes_of(a[some], more[some]) == self.bytes_of(b[some], more[some])).all(axis=1)
        return out


#: With the bucket, g stands for a gram.
_SEGMENT = np.dtype([("g", "<u4"), ("row", "<u2"), ("first", "<u4"), ("more", "u1"), ("anchor", "u1")])
#: Documents and bytes of text handled as one run (one text may be longer); a row number fits 16 bits.
MAX_ROWS, MAX_BYTES = 4_000, 64 << 20
#: Buckets of a receiver; it holds one at a time.
SPLIT = 4
_PLACE = np.dtype([("first", "<u4"), ("more", "u1"), ("anchor", "u1")])
#: A document of a row of places, and its number of places.
_ABOUT = np.dtype([("d", "<i8"), ("th", "<i4"), ("n", "<u4")])
#: Places that a receiver gathers over its buckets before it gives them out.
HELD = 2_000_000
COVERED, UNSURE, RUN = 0, 1, 2
OUT = "kind int, bucket int, d long, th int, blob binary, docs binary"
_OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("d", pa.int64()), ("th", pa.int32()), ("blob", pa.binary()), ("docs", pa.binary())])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _OUT, strict=True)], schema=_OUT)


def _part_of(d: np.ndarray, th: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a document, as in ``_part_column``."""
    return xxhash_int(th, xxhash_long(d)).view(np.int64) % parts


def _part_column(parts: int) -> Column:
    return F.pmod(F.xxhash64("d", "th"), F.lit(parts)).cast("int")


def _by_part(kind: int, key: np.ndarray, docs: np.ndarray, hashes: np.ndarray, places: np.ndarray, parts: int) -> list[tuple]:
    """A row for each partition of documents: its places (``blob``) and, with their number for each, its documents (``docs``).

    ``key`` numbers the documents of the places.
    """
    if not len(key):
        return []
    used, key = np.unique(key, return_inverse=True)
    part = _part_of(docs[used], hashes[used], parts)
    rank = np.empty(len(used), np.int64)
    by_part = np.argsort(part, kind="stable")
    rank[by_part] = np.arange(len(used))
    places = places[np.argsort(rank[key], kind="stable")]
    about = np.empty(len(used), _ABOUT)
    about["d"], about["th"], about["n"] = docs[used], hashes[used], np.bincount(key, minlength=len(used))
    about, part = about[by_part], part[by_part]
    end = np.r_[0, np.cumsum(about["n"], dtype=np.int64)]
    cut = np.flatnonzero(_changes(part))
    return [(kind, int(part[a]), None, None, places[end[a] : end[b]].tobytes(), about[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True)]


class _Found:
    """Places found in a receiver's buckets; given out by partitions of documents, ``HELD`` places at a time."""

    def __init__(self, kind: int, parts: int) -> None:
        self.kind, self.into = kind, parts
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, key: np.ndarray, docs: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        used, key = np.unique(key, return_inverse=True)
        self.parts.append((key, docs[used], hashes[used], places))
        if sum(len(p[0]) for p in self.parts) >= HELD:
            yield from self.given()

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            begin = np.cumsum([0, *(len(p[1]) for p in self.parts)])
            key = np.concatenate([p[0] + at for p, at in zip(self.parts, begin, strict=False)])
            docs, hashes, places = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
            self.parts = []
            rows = _by_part(self.kind, key, docs, hashes, places, self.into)
            for i in range(0, len(rows), 2000):
                yield _emit(rows[i : i + 2000])


def _places(first: np.ndarray, more: np.ndarray | int, anchor: np.ndarray | int = 0) -> np.ndarray:
    out = np.empty(len(first), _PLACE)
    out["first"], out["more"], out["anchor"] = first, more, anchor
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``MAX_ROWS`` documents and, but for a single text, ``MAX_BYTES`` of text."""
    for batch in batches:
        size = np.array([len(t.as_py() or "") for t in batch.column("text")], np.int64)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(size[at : at + MAX_ROWS]), MAX_BYTES, "right"))
            n = max(1, min(n, MAX_ROWS))
            yield batch.slice(at, n)
            at += n


def _first_of_group(new: np.ndarray) -> np.ndarray:
    """Index of the first element of each element's group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _segment_runs(parts: int):
    buckets = parts * SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in _slices(batches):
            batch = Batch(raw)
            row, first, more, anchor = batch.segments()
            gram = batch.grams(anchor)
            order = np.argsort(gram, kind="stable")
            gram, row, first, more, anchor = (x[order] for x in (gram, row, first, more, anchor))
            doc = batch.doc[row]
            # segments of grams that the run has more than once: drop what a smaller doc_id covers
            new = _changes(gram)
            again = np.flatnonzero(~new | np.append(~new[1:], [False])[: len(new)])
            whole = batch.segment_hashes(first[again], more[again])
            again = again[(order := np.lexsort((doc[again], whole, gram[again])))]
            least = again[_first_of_group(_changes(gram[again], whole[order]))] if len(again) else again
            later = doc[again] > doc[least]
            again, least = again[later], least[later]
            again = again[batch.same_bytes(first[again], first[least], more[again])]
            covered = np.zeros(len(gram), bool)
            covered[again] = True
            inside = first - batch.starts[row]
            rows = _by_part(COVERED, row[covered], batch.doc, batch.hash, _places(inside[covered], more[covered]), parts)
            keep = ~covered
            packed = np.empty(int(keep.sum()), _SEGMENT)
            packed["g"], packed["row"] = gram[keep] >> np.uint64(32), row[keep]
            packed["first"], packed["more"], packed["anchor"] = inside[keep], more[keep], (anchor - first)[keep]
            bucket = (gram[keep] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = packed[order[ends[b] : ends[b + 1]]]
                if len(own):
                    used, index = np.unique(own["row"], return_inverse=True)
                    own["row"] = index
                    rows.append((RUN, b, None, None, own.tobytes(), batch.doc[used].tobytes() + batch.hash[used].tobytes()))
            for i in range(0, len(rows), 2000):
                yield _emit(rows[i : i + 2000])

    return run


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[tuple[bytes, bytes]]]]:
    """From rows sorted by bucket: the runs of each bucket, or rows that are settled and pass on."""
    bucket, runs = None, []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (kinds != RUN).any():
            yield batch.filter(pa.array(kinds != RUN)), []
        batch = batch.filter(pa.array(kinds == RUN))
        for b, blob, docs in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            if b != bucket:
                if runs:
                    yield None, runs
                bucket, runs = b, []
            runs.append((blob, docs))
    if runs:
        yield None, runs


def _doc_tables(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id and text hash of all documents of the runs, and where each run's begin."""
    docs = [np.frombuffer(d, np.int64, len(d) // 12) for _, d in runs]
    hashes = [np.frombuffer(d, np.int32, len(d) // 12, len(d) // 12 * 8) for _, d in runs]
    return np.concatenate(docs), np.concatenate(hashes), np.cumsum([0, *map(len, docs)])


def _match_segments(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(UNSURE, parts)
        for settled, runs in _bucket_groups(batches):
            if settled is not None:
                yield settled
                continue
            docs, hashes, begin = _doc_tables(runs)
            items = [np.frombuffer(b, _SEGMENT) for b, _ in runs]
            key = np.concatenate([x["row"].astype(np.int64) + at for x, at in zip(items, begin, strict=False)])
            item = np.concatenate(items)
            order = np.argsort(item["g"], kind="stable")
            key, item = key[order], item[order]
            doc = docs[key]
            start = np.flatnonzero(_changes(item["g"]))
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            unsure = np.repeat(several, np.diff(np.r_[start, len(doc)]))
            places = _places(item["first"][unsure], item["more"][unsure], item["anchor"][unsure])
            yield from found.add(key[unsure], docs, hashes, places)
        yield from found.given()

    return run


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted equal-length rows as shared-prefix lengths and the bytes that follow them."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return shared.tobytes(), rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def read_front_coded(shared: bytes, rest: bytes, width: int = LENGTH) -> list[bytes]:
    out, at, last = [], 0, b""
    for k in shared:
        end = at + width - k
        last = last[:k] + rest[at:end]
        at = end
        out.append(last)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the string before) of all strings in order.

    A loser tree over the runs. Every contestant carries how much of the last winner it
    is known to share: the longer shared prefix wins, and only on a tie are the strings
    compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; sets what the loser shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k = known[a]
        x, y = x[k:], y[k:]
        if x == y:
            (a, b) = (a, b) if a < b else (b, a)
            known[b] = k + len(x)
            return a, b
        equal = len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        if x > y:
            a, b = b, a
        known[b] = k + equal
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while head[winner] is not None:
        run = winner
        yield run, at[run], known[run]
        at[run] += 1
        if at[run] < len(runs[run]):
            head[run], known[run] = runs[run][at[run]], shared[run][at[run]]
        else:
            head[run] = None
        node = (run + size) >> 1
        while node:
            # inlined common case: different known prefixes
            other = loser[node]
            if head[winner] is not None and head[other] is not None and known[winner] != known[other]:
                if known[winner] < known[other]:
                    winner, loser[node] = other, winner
            else:
                winner, loser[node] = play(winner, other)
            node >>= 1


#: What goes with a suffix: its document, its segment's first window and further windows, and the bytes before it, nearest first.
_SUFFIX = np.dtype([("row", "<u2"), ("first", "<u4"), ("more", "u1"), ("anchor", "u1"), ("before", "u1", REACH - 1)])


def _suffix_runs(parts: int):
    buckets = parts * SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in _slices(_gathered(_placed(batches, only=True))):
            batch = Batch(raw)
            found = [np.frombuffer(blob, _PLACE) for blob in raw.column("places").to_pylist()]
            place = np.concatenate(found) if found else np.empty(0, _PLACE)
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            start = batch.starts[row] + place["first"]
            at, more = place["anchor"].astype(np.int64), place["more"].astype(np.int64)
            # the suffix at the anchor as far as the segment goes, and what stands before it, backwards
            suffix = sliding_window_view(batch.buffer, LENGTH)[start + at] * (np.arange(LENGTH) < (more + LENGTH - at)[:, None])
            step = np.arange(1, REACH)
            before = batch.buffer[np.maximum((start + at)[:, None] - step, 0)] * (step <= at[:, None])
            order = np.argsort(suffix.astype(np.uint8).view(f"S{LENGTH}").ravel(), kind="stable")
            suffix = suffix[order].astype(np.uint8)
            about = np.empty(len(order), _SUFFIX)
            about["row"], about["before"] = row[order], before[order]
            for name in ("first", "more", "anchor"):
                about[name] = place[name][order]
            # equal windows share the whole gram
            bucket = _hash_rows(suffix[:, :GRAM]) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                own = order[ends[b] : ends[b + 1]]
                if len(own):
                    mine = about[own]
                    used, mine["row"] = np.unique(mine["row"], return_inverse=True)
                    shared, rest = front_code(suffix[own])
                    out.append((RUN, b, None, None, len(own).to_bytes(4, "little") + shared + mine.tobytes() + rest, batch.doc[used].tobytes() + batch.hash[used].tobytes()))
            for i in range(0, len(out), 2000):
                yield _emit(out[i : i + 2000])

    return run


def _covered(known: np.ndarray, about: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index, first window, further windows) of what is covered, of suffixes in merged order.

    Whole segments first: those with all bytes equal are one class, and all but its
    smallest doc_id's are covered. A window that begins ``o`` bytes before the anchor
    equals another if the suffixes share ``LENGTH - o`` bytes, which the merge has told
    for neighbours and so for all between, and the ``o`` bytes before them are equal.
    """
    # the bytes before the anchor in sorted order; the closing 1 keeps zeros at the end
    before = np.ascontiguousarray(np.concatenate([about["before"], np.ones((len(about), 1), np.uint8)], axis=1)).view(f"S{REACH}").ravel()
    by_before = np.argsort(before, kind="stable")
    steps = about["before"][by_before]
    differs = steps[1:] != steps[:-1]
    alike = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), REACH)] if len(about) else np.empty(0, np.int64)
    place = np.empty(len(about), np.int64)

    def classes(o: int) -> np.ndarray:
        """Number of each suffix's class by the ``o`` bytes before the anchor."""
        place[by_before] = np.cumsum(alike < o)
        return place

    more, high = about["more"].astype(np.int64), about["anchor"].astype(np.int64)
    shared, back = np.cumsum(known < LENGTH), classes(REACH - 1).copy()
    order = np.lexsort((doc, back, high, more, shared))
    least = order[_first_of_group(_changes(shared[order], more[order], high[order], back[order]))]
    later = doc[order] > doc[least]
    gone = order[later]
    yield gone, about["first"][gone].astype(np.int64), more[gone]
    # what is left in a group of equal grams, where another class has another document
    left = np.ones(len(about), bool)
    left[gone] = False
    group = np.cumsum(known < GRAM) - 1
    start = np.flatnonzero(_changes(group))
    least_doc, most_doc = (f.reduceat(np.where(left, doc, z), start) for f, z in ((np.minimum, NO_DOC), (np.maximum, -NO_DOC - 1)))
    left &= (least_doc < most_doc)[group]
    for o in range(REACH):
        has = np.flatnonzero(left & (high - more <= o) & (o <= high))
        if not len(has):
            continue
        shared, back = np.cumsum(known < LENGTH - o)[has], classes(o)[has]
        order = np.lexsort((doc[has], back, shared))
        least = _first_of_group(_changes(shared[order], back[order]))
        ranked = has[order]
        gone = ranked[doc[ranked] > doc[ranked[least]]]
        yield gone, about["first"][gone] + (high[gone] - o), np.zeros(len(gone), np.int64)


def _merge_suffixes(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(COVERED, parts)
        for _, runs in _bucket_groups(batches):
            docs, hashes, begin = _doc_tables(runs)
            strings, shared, about, keys = [], [], [], []
            for (blob, _), at in zip(runs, begin, strict=False):
                n = int.from_bytes(blob[:4], "little")
                shared.append(blob[4 : 4 + n])
                about.append(np.frombuffer(blob, _SUFFIX, n, 4 + n))
                keys.append(about[-1]["row"].astype(np.int64) + at)
                strings.append(read_front_coded(shared[-1], blob[4 + n + n * _SUFFIX.itemsize :]))
            n = sum(map(len, strings))
            offset = np.cumsum([0, *map(len, strings)]).tolist()
            order, known = np.empty(n, np.int64), np.empty(n, np.int64)
            for i, (of, index, same) in enumerate(merge_runs(strings, shared)):
                order[i], known[i] = offset[of] + index, same
            known[:1] = 0
            del strings
            key, item = np.concatenate(keys)[order], np.concatenate(about)[order]
            index, first, more = (np.concatenate(x) for x in zip(*_covered(known, item, docs[key]), strict=True))
            yield from found.add(key[index], docs, hashes, _places(first, more))
        yield from found.given()

    return run


#: A row with places comes before the texts of its partition.
PLACES, TEXT = 0, 1


def _by_document(rows: list[tuple[bytes, bytes]]) -> dict[tuple[int, int], bytes]:
    """The places of each document (d, th), from the rows of a partition."""
    if not rows:
        return {}
    about = np.concatenate([np.frombuffer(docs, _ABOUT) for _, docs in rows])
    places = np.frombuffer(b"".join(blob for blob, _ in rows), _PLACE)
    n = about["n"].astype(np.int64)
    begin = np.cumsum(n) - n
    order = np.lexsort((about["th"], about["d"]))
    about, n = about[order], n[order]
    end = np.cumsum(n)
    places = places[np.repeat(begin[order] - end + n, n) + np.arange(len(places))]
    cut = np.flatnonzero(_changes(about["d"], about["th"]))
    starts, ends = (end - n)[cut], end[np.append(cut[1:], len(end)) - 1]
    return {doc: places[a:b].tobytes() for doc, a, b in zip(zip(about["d"][cut].tolist(), about["th"][cut].tolist(), strict=True), starts, ends, strict=True)}


def _placed(batches: Iterator[pa.RecordBatch], only: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, d, th, text and places, from rows sorted by bucket and turn; ``only`` documents with places."""
    bucket, rows, places = None, [], {}
    for batch in batches:
        buckets, turns = batch.column("bucket").to_numpy(), batch.column("turn").to_numpy()
        cut = np.flatnonzero(_changes(buckets, turns)).tolist()
        for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=False):
            part = batch.slice(a, b - a)
            if buckets[a] != bucket:
                bucket, rows, places = buckets[a], [], {}
            if turns[a] == PLACES:
                rows += zip(part.column("blob").to_pylist(), part.column("docs").to_pylist(), strict=True)
                continue
            if rows:
                rows, places = [], _by_document(rows)
            found = [places.get(doc, b"") for doc in zip(part.column("d").to_pylist(), part.column("th").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*map(part.column, _DOCUMENT), pa.array(found, pa.binary())], [*_DOCUMENT, "places"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_())) if only else out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that fill a run, as far as the rows of one fit."""
    some, rows, size = [], 0, 0
    for batch in batches:
        if some and (rows + batch.num_rows > MAX_ROWS or size + batch.nbytes > MAX_BYTES):
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, rows, size = [], 0, 0
        if batch.num_rows:
            some.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


_DOCUMENT = ["doc_id", "d", "th", "text"]


def _spans(size: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs."""
    place = np.frombuffer(blob, _PLACE)
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(size + 2, np.int32)
    first = place["first"].astype(np.int64)
    np.add.at(edge, first + 1, 1)
    np.add.at(edge, first + place["more"] + LENGTH + 1, -1)
    inside = (np.cumsum(edge) > 0).astype(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _placed(batches, only=False):
        rows = []
        for text, blob in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            starts, ends = _spans(len(data), blob)
            digest, at = hashlib.sha256(), 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            rows.append((len(data), int((ends - starts).sum()), len(starts), digest.hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document; see ``RESULT``."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)).alias("d"), F.hash("text").alias("th"), "text")

    def exchanged(found: DataFrame, match) -> DataFrame:
        return found.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(match, OUT)

    def with_texts(found: DataFrame) -> DataFrame:
        """The places of each partition of documents before its texts, for ``_placed``."""
        texts = rows.select(_part_column(parts).alias("bucket"), F.lit(TEXT).alias("turn"), *_DOCUMENT)
        found = found.select("bucket", F.lit(PLACES).alias("turn"), "blob", "docs")
        return texts.unionByName(found, allowMissingColumns=True).repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "turn")

    matched = materialize(exchanged(rows.select("d", "th", "text").mapInArrow(_segment_runs(parts), OUT), _match_segments(parts)), "matched")
    suffixes = with_texts(matched.filter(F.col("kind") == UNSURE)).mapInArrow(_suffix_runs(parts), OUT)
    merged = materialize(exchanged(suffixes, _merge_suffixes(parts)), "merged")
    return with_texts(matched.filter(F.col("kind") == COVERED).union(merged)).mapInArrow(_digest, RESULT)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
