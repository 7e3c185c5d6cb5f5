"""Near copies by SimHash and Golay keys at a similarity, for the pipeline's dedup stage.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or
more. Golay keys find the candidates, the sets themselves decide.

1. *Classes.* Texts of equal words (A-Z lower-cased) are one class, told by 128 bits.
2. *Keys.* A class has a fingerprint of 184 bits over its set of shingles, read as eight
   words of the Golay code. For each pair of words it is filed under the nearest codeword
   of one with every codeword within distance 4 of the other, both ways round.
3. *Candidates.* Within a bucket, fingerprints are compared on 64 bits. A bucket of up to
   ``PAIRS`` classes gives all pairs within ``FIRST_BITS``, a larger one a spanning tree by
   distance; pairs it leaves out follow in step 5. Candidates go on if they differ in at most
   ``ALL_BITS`` of 184 bits and in size as the similarity allows.
4. *Verification.* In rounds, every component verifies its nearest candidates on the shingle
   sets, ``START`` at first (enough to connect most of a group at once, so that few
   candidates are left to relabel) and ``GROWTH`` times as many in each later round, and
   linked components merge; candidates within a component are spared. Once there are at most two
   candidates to a text, all are verified. So a group of near copies is mostly settled by
   as many set comparisons as it has members, and no candidate that could join two groups
   is left out.
5. *The rest.* The links need not be those of a bucket's tree, so a pair it leaves out could
   still join two groups. The members of larger buckets are filed once more with their
   component and whole fingerprint. Pairs of a bucket within ``FIRST_BITS`` and ``ALL_BITS``
   whose components differ connect these to regions (a bucket gives a spanning forest of its
   components); on 64 bits alone chance pairs of a large table would connect all to one
   region, and its tiles grow with the square of the table. All pairs of a region whose components differ are compared, ``TILE`` by ``TILE`` members at a time:
   a tile counts common shingles by a matrix product and gives the links of a spanning
   forest. So there is no row for a pair, and what is left out is within a component.

A bucket over ``TREE`` classes is cut into runs of neighbours in the order of each of
``TURNS`` rotations of the fingerprint; every run gives its tree, and runs are chained.
The README states the recall, measured against brute force.

Defined cases: a text without words equals any other such text; under five words the whole
sequence is one shingle; a null text counts as empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import materialize, shuffle_partitions
from .common import fresh
from .golay import Golay

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
WORDS = 8
BITS = 23
FIRST_BITS, ALL_BITS = 20, 42
START, GROWTH = 4, 8
PAIRS, TREE, TURNS = 4, 2048, 8
#: Members of a side of a tile, and columns of its matrix product at a time.
TILE, COLUMNS = 512, 4096
#: Passes over the pairs of words in which all classes are filed with their component, so that its shuffle holds a part of the keys.
PASSES = 7
#: Sub-buckets of a task, so that it holds a part of its keys at a time; rows of a join with one text.
SPLIT = 8
SALT_ROWS = 256
_MULTIPLIERS = np.random.default_rng(3).integers(1, 1 << 63, (3, 2), dtype=np.uint64) | np.uint64(1)
_ENTRY = np.dtype([("key", "<u4"), ("f0", "<u8"), ("id", "<i8")])
_ROOTED = np.dtype([*_ENTRY.descr, ("f1", "<u8"), ("f2", "<u8"), ("root", "<i8")])


def shingle_set(text: str | None) -> tuple[bytes, np.ndarray]:
    """128 bits that tell the sequence of words, and the sorted distinct hashes of its shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    name = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    if not words:
        return name, np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return name, np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Three words of 64 bits: a bit is set where over half of the hashes, mixed for the word, have it."""
    out = np.zeros(3, np.uint64)
    for w, (a, b) in enumerate(_MULTIPLIERS):
        x = hashes * a
        x ^= x >> np.uint64(32)
        x *= b
        x ^= x >> np.uint64(29)
        counts = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def golay_words(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 8) words of 23 bits from (n, 3) fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(fingerprints).view(np.uint8), axis=1, bitorder="little")[:, : WORDS * BITS]
    return bits.reshape(-1, WORDS, BITS).astype(np.int64) @ (1 << np.arange(BITS))


def keys(fingerprints: np.ndarray, code: Golay, turn: int = 0, passes: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of all keys, by pairs of words; of several passes, those of the pairs whose turn it is."""
    words = golay_words(fingerprints)
    near = [code.near(words[:, i]) for i in range(WORDS)]
    pair = 0
    for i in range(WORDS):
        for j in range(i):
            if pair % passes != turn:
                pair += 1
                continue
            a, b = near[i][0][:, :1], near[j][0][:, :1]
            both = np.concatenate([a << 12 | near[j][0], near[i][0] << 12 | b], axis=1)
            counts = np.concatenate([near[j][1], near[i][1]], axis=1)
            counts[:, near[j][0].shape[1]] = False  # both nearest: filed once
            row, column = np.nonzero(counts)
            yield row, (pair << 24 | both[row, column]).astype(np.uint32)
            pair += 1


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, prints, sizes = [], [], []
        for t in batch.column("text"):
            name, hashes = shingle_set(t.as_py())
            names.append(name)
            prints.append(fingerprint(hashes).view(np.int64))
            sizes.append(len(hashes))
        f = np.array(prints, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), *(pa.array(f[:, i]) for i in range(3)), pa.array(sizes, pa.int32())], ["doc_id", "th", "name", "f0", "f1", "f2", "n"])


def _file(parts: int, rooted: bool = False, turn: int = 0, passes: int = 1):
    buckets = parts * SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for whole in batches:
            for at in range(0, whole.num_rows, 8000):
                batch = whole.slice(at, 8000)
                ids, *f = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                found = list(keys(np.stack(f, axis=1).view(np.uint64), code, turn, passes))
                row, key = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket = (key * np.uint32(0x9E3779B1) >> np.uint32(7)) % np.uint32(buckets)
                order = np.argsort(bucket, kind="stable")
                entries = np.empty(len(order), _ROOTED if rooted else _ENTRY)
                entries["key"], entries["f0"], entries["id"] = key[order], f[0].view(np.uint64)[row[order]], ids[row[order]]
                if rooted:
                    entries["f1"], entries["f2"] = f[1].view(np.uint64)[row[order]], f[2].view(np.uint64)[row[order]]
                    entries["root"] = batch.column(4).to_numpy(zero_copy_only=False)[row[order]]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(ends[1:] > ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([entries[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary())], ["bucket", "blob"])

    return run


def _tree(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning tree by distance (Prim), from each node to the one it hangs on."""
    n = len(f)
    best, parent = np.bitwise_count(f ^ f[0]).astype(np.int16), np.zeros(n, np.int64)
    best[0] = 999
    nodes, on = [], []
    for _ in range(n - 1):
        k = int(best.argmin())
        nodes.append(k)
        on.append(parent[k])
        d = np.bitwise_count(f ^ f[k])
        nearer = (d < best) & (best < 999)
        best[nearer], parent[nearer] = d[nearer], k
        best[k] = 999
    return np.array(nodes, np.int64), np.array(on, np.int64)


def _large(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges that connect a large bucket; see the module's text."""
    if len(f) <= TREE:
        return _tree(f)
    a, b = [], []
    for turn in range(TURNS):
        k = np.uint64(64 // TURNS * turn)
        order = np.argsort(f << k | f >> (np.uint64(64) - k) if turn else f, kind="stable")
        for at in range(0, len(f), TREE - 1):  # neighbours share a member
            run = order[at : at + TREE]
            if len(run) > 1:
                x, y = _tree(f[run])
                a.append(run[x])
                b.append(run[y])
    return np.concatenate(a), np.concatenate(b)


def _grouped(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    """``found(blobs)`` of every bucket."""
    bucket, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and blobs:
                yield from found(blobs)
                blobs = []
            bucket = b
            blobs.append(blob)
    if blobs:
        yield from found(blobs)


def _by_key(blobs: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of key and id, and the start and size of each key's."""
    entries = np.frombuffer(b"".join(blobs), dtype)
    entries = entries[np.lexsort((entries["id"], entries["key"]))]
    key = entries["key"]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return entries, start, np.diff(np.r_[start, len(key)])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, large): candidate pairs, and whether the bucket gave a tree only; a = b only marks a member of one."""

    def found(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries, start, size = _by_key(blobs, _ENTRY)
        key, f, ids = entries["key"], np.ascontiguousarray(entries["f0"]), entries["id"]
        small = np.repeat(size <= PAIRS, size)
        a, b = [], []
        for d in range(1, PAIRS):
            left = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            if not len(left):
                break
            a.append(left)
            b.append(left + d)
        for s, n in zip(start[size > PAIRS], size[size > PAIRS], strict=True):
            x, y = _large(f[s : s + n])
            a.append(x + s)
            b.append(y + s)
        left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        ok = (np.bitwise_count(f[left] ^ f[right]) <= FIRST_BITS) & (ids[left] != ids[right])
        left, right = left[ok], right[ok]
        # runs need not give every member of a bucket over TREE an edge
        runs = ids[np.repeat(size > TREE, size)]
        x, y = np.concatenate([ids[left], runs]), np.concatenate([ids[right], runs])
        large = np.concatenate([~small[left], np.ones(len(runs), bool)])
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), large], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(bool))], ["a", "b", "large"])

    yield from _grouped(batches, found)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): all pairs of a larger bucket within ``FIRST_BITS`` whose components differ."""

    def found(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries, start, size = _by_key(blobs, _ROOTED)
        for s, n in zip(start[size > PAIRS], size[size > PAIRS], strict=True):
            f, ids, root = (np.ascontiguousarray(entries[c][s : s + n]) for c in ("f0", "id", "root"))
            if (root == root[0]).all():
                continue
            for i in range(n - 1):
                near = (np.bitwise_count(f[i + 1 :] ^ f[i]) <= FIRST_BITS) & (root[i + 1 :] != root[i])
                if near.any():
                    other = ids[i + 1 :][near]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, ids[i])), pa.array(np.maximum(other, ids[i]))], ["a", "b"])

    yield from _grouped(batches, found)


class _Forest:
    """Union-find over names; ``join`` says whether two were apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ra, rb): components that a pair of ``_apart`` within ``ALL_BITS`` joins, as a spanning forest of each bucket's."""

    def found(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries, start, size = _by_key(blobs, _ROOTED)
        forest, edges = _Forest(), []
        prints, roots = [np.ascontiguousarray(entries[c]) for c in ("f0", "f1", "f2")], np.ascontiguousarray(entries["root"])
        for s, n in zip(start[size > PAIRS].tolist(), size[size > PAIRS].tolist(), strict=True):
            f, root = [x[s : s + n] for x in prints], roots[s : s + n]
            if (root == root[0]).all():
                continue
            names, group, counts = np.unique(root, return_inverse=True, return_counts=True)
            # members of the largest component are met by all others
            others = np.flatnonzero(group != counts.argmax())
            step = max(1, TILE * TILE // n)
            for at in range(0, len(others), step):
                some = others[at : at + step]
                first, *rest = (np.bitwise_count(x[some, None] ^ x) for x in f)
                near = (first <= FIRST_BITS) & (first.astype(np.int16) + rest[0] + rest[1] <= ALL_BITS) & (group != group[some, None])
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    own = int(root[some[i]])
                    for other in names[np.unique(group[near[i]])].tolist():
                        if forest.join(own, other):
                            edges.append((own, other))
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], ["ra", "rb"])

    yield from _grouped(batches, found)


def _sparse(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the sets' elements that are among ``shared``, by column."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    column = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
    ok = shared[column] == values
    column, row = column[ok], row[ok]
    order = np.argsort(column, kind="stable")
    return column[order], row[order]


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each set of ``a`` with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(shared):
        return out
    sides = [_sparse(x, shared) for x in (a, b)]
    for at in range(0, len(shared), COLUMNS):
        parts = []
        for (column, row), n in zip(sides, (len(a), len(b)), strict=True):
            some = slice(*np.searchsorted(column, (at, at + COLUMNS)))
            part = np.zeros((n, COLUMNS), np.float32)
            part[row[some], column[some] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links between the components of a tile; ``side`` 2 is on both sides."""

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r[0] in (k, 2)] for k in (0, 1)]
        if not all(sides):
            return
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
        root = [np.array([r[2] for r in side]) for side in sides]
        size = [np.array([len(x) for x in side]) for side in sets]
        both = common(*sets)
        alike = both >= SIMILARITY * (size[0][:, None] + size[1] - both) - 1e-9
        alike &= root[0][:, None] != root[1]
        forest = _Forest()
        links = [(sides[0][i][1], sides[1][j][1]) for i, j in np.argwhere(alike).tolist() if forest.join(sides[0][i][2], sides[1][j][2])]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    tile, rows = None, []
    for batch in batches:
        for t, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "id", "root", "hashes")), strict=True):
            if t != tile and rows:
                yield from found(rows)
                rows = []
            tile = t
            rows.append(tuple(row))
    if rows:
        yield from found(rows)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets of shingles are similar enough."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _bucketed(filed: DataFrame, parts: int) -> DataFrame:
    return filed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")


def _fitting(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, d): the pairs that differ in at most ``ALL_BITS`` and in size as the similarity allows."""
    sides = [classes.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("f0", "f1", "f2", "n")]) for s in ("a", "b")]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    distance = sum((F.bit_count(F.col(f"a_f{i}").bitwiseXOR(F.col(f"b_f{i}"))) for i in (1, 2)), F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))))
    fits = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * (SIMILARITY - 1e-9)
    return joined.filter(fits).select("a", "b", distance.cast("int").alias("d")).filter(F.col("d") <= ALL_BITS)


def near_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, large) of ``classes(id, f0, f1, f2, n)``; see ``_candidates``."""
    parts = shuffle_partitions(classes.sparkSession)
    filed = classes.filter("n > 0").select("id", "f0", "f1", "f2").mapInArrow(_file(parts), "bucket int, blob binary")
    return _bucketed(filed, parts).mapInArrow(_candidates, "a long, b long, large boolean").groupBy("a", "b").agg(F.max("large").alias("large"))


def candidates(classes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, d): pairs of ``classes(id, f0, f1, f2, n)`` that may be similar, with their distance."""
    pairs = near_pairs(classes) if pairs is None else pairs
    return _fitting(pairs.filter("a <> b").select("a", "b"), classes)


def _rooted(classes: DataFrame, pairs: DataFrame, links: DataFrame | None) -> DataFrame:
    """(id, f0, f1, f2, root): the members of larger buckets with their component."""
    roots = classes.select("id", F.col("id").alias("root"))
    if links is not None:
        linked = materialize(components(links, "a", "b"), "linked")
        roots = classes.select("id").join(linked, F.col("id") == linked["node"], "left").select("id", F.coalesce("root", "id").alias("root"))
    members = pairs.filter("large").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return materialize(classes.join(members, "id").join(roots, "id").select("id", "f0", "f1", "f2", "root"), "rooted")


def remaining(classes: DataFrame, pairs: DataFrame, edges: DataFrame, links: DataFrame | None) -> DataFrame:
    """(a, b, d, ra, rb): the candidates that the trees of larger buckets left out and that join two components.

    The plain form of what ``remaining_links`` verifies, with a row for each pair.
    """
    parts = shuffle_partitions(classes.sparkSession)
    rooted = _rooted(classes, pairs, links)
    filed = rooted.mapInArrow(_file(parts, True), "bucket int, blob binary")
    apart = _bucketed(filed, parts).mapInArrow(_apart, "a long, b long").distinct().join(edges.select("a", "b"), ["a", "b"], "left_anti")
    fitting = _fitting(apart, classes)
    for side in ("a", "b"):
        fitting = fitting.join(rooted.select(F.col("id").alias(side), F.col("root").alias(f"r{side}")), side)
    return fitting.select("a", "b", "d", "ra", "rb")


def _with_set(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the set of one side. A text in many pairs is copied, and its pairs spread over the copies."""
    copies = pairs.groupBy(side).agg(F.ceil(F.count("*") / SALT_ROWS).alias("copies"))
    own = copies.join(sets.withColumnRenamed("id", side), side).select(side, F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("salt"), F.col("hashes").alias(f"set_{side}"))
    other = "b" if side == "a" else "a"
    salted = pairs.join(copies, side).withColumn("salt", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies")
    return salted.join(own, [side, "salt"]).drop("salt")


def similar_links(edges: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Verified links among the candidates ``edges(a, b, d)`` that connect what all verified ones would.

    Components known before are named by ``ra`` and ``rb``.
    """
    known = "ra" in edges.columns
    open_ = materialize(edges.select("a", "b", "d", F.col("ra" if known else "a").alias("ra"), F.col("rb" if known else "b").alias("rb")), "open")
    nodes = sets.count()
    links: DataFrame | None = None
    share = START
    while left := open_.count():
        if left <= 2 * nodes:
            chosen = open_.select("a", "b", "ra", "rb")
        else:
            # the nearest of each component's candidates, of each of ``share`` parts by hash
            parted = open_.select(F.struct("d", "a", "b", "ra", "rb").alias("e"), F.pmod(F.xxhash64("a", "b"), F.lit(share)).alias("part"))
            nearest = [parted.groupBy(F.col(f"e.{side}").alias("r"), "part").agg(F.min("e").alias("e")) for side in ("ra", "rb")]
            chosen = nearest[0].union(nearest[1]).groupBy("r", "part").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.ra", "e.rb").distinct()
        chosen = materialize(chosen, "chosen")
        found = _with_set(_with_set(chosen.select("a", "b"), sets, "a"), sets, "b").mapInArrow(_alike, "a long, b long")
        found = materialize(found, "alike")
        links = found if links is None else links.union(found)
        if left <= 2 * nodes:
            break
        roots = materialize(components(found.join(chosen, ["a", "b"]).select("ra", "rb"), "ra", "rb"), "roots")
        rest = open_.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("ra", "rb"):
            of_side = roots.select(F.col("node").alias(side), F.col("root").alias("to"))
            rest = rest.join(of_side, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        open_ = materialize(rest.select("a", "b", "d", "ra", "rb").filter("ra <> rb"), "open")
        share *= GROWTH
    return links


def remaining_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, links: DataFrame | None) -> DataFrame:
    """(a, b): links between components that the trees of larger buckets left out; see step 5."""
    parts = shuffle_partitions(classes.sparkSession)
    rooted = _rooted(classes, pairs, links)
    # chance fills buckets as the classes grow, until most classes are members of larger ones
    passes = max(1, math.ceil(PASSES * rooted.count() / max(1, classes.count())))
    meeting: DataFrame | None = None
    for turn in range(passes):
        filed = rooted.mapInArrow(_file(parts, True, turn, passes), "bucket int, blob binary")
        met = materialize(_bucketed(filed, parts).mapInArrow(_meeting, "ra long, rb long").distinct(), "meeting")
        meeting = met if meeting is None else meeting.union(met)
    regions = components(meeting, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("region"))
    # a component of a tile or more has blocks of its own, the others of a region share some
    sized = rooted.groupBy("root").count().join(regions, "root")
    small = F.col("count") < TILE
    sized = materialize(sized.select("root", "region", F.when(~small, F.col("root")).alias("own"), "count"), "regions")
    blocks = sized.groupBy("region", "own").agg(F.ceil(F.sum("count") / TILE).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    placed = sized.join(blocks, sized["region"].eqNullSafe(blocks["region"]) & sized["own"].eqNullSafe(blocks["own"])).select("root", sized["region"], sized["own"], "blocks")
    members = rooted.join(placed, "root").select("id", "root", "region", "own", F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("root")).otherwise(F.col("id"))), F.col("blocks")).cast("int").alias("block"))
    members = materialize(members, "members")
    every = blocks.select("region", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("region", F.struct("own", "block").alias("at"))
    tiles = every.withColumnRenamed("at", "x").join(every.withColumnRenamed("at", "y"), "region")
    tiles = tiles.filter((F.col("x") <= F.col("y")) & (F.col("x.own").isNull() | ~F.col("x.own").eqNullSafe(F.col("y.own"))))
    tiles = tiles.withColumn("tile", F.xxhash64("region", "x", "y"))
    same = F.col("x") == F.col("y")
    sides = tiles.select("region", "tile", F.explode(F.when(same, F.array(F.struct(F.lit(2).alias("side"), F.col("x").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at"))))).alias("s"))
    sides = sides.select("region", "tile", "s.side", F.col("s.at.own").alias("s_own"), F.col("s.at.block").alias("block"))
    sets = _sets_of(docs, classes, members.select(F.col("id").alias("a"), F.col("id").alias("b")))
    held = members.join(sides, ["region", "block"]).filter(F.col("own").eqNullSafe(F.col("s_own"))).select("tile", "side", "id", "root")
    held = held.join(sets, "id").select("tile", "side", "id", "root", "hashes")
    return held.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_tile_links, "a long, b long")


def text_hash(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _classes(docs: DataFrame) -> DataFrame:
    """A row for each sequence of words: its first document, fingerprint and number of shingles."""
    described = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text").mapInArrow(_describe, "doc_id long, th string, name binary, f0 long, f1 long, f2 long, n int")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    grouped = described.groupBy("name", "f0", "f1", "f2", "n").agg(least)
    return grouped.select(F.xxhash64("name").alias("id"), "f0", "f1", "f2", "n", "least")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(t.as_py())[1].tobytes() for t in batch.column("text")], pa.binary())], ["id", "hashes"])


def _sets_of(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, hashes): the shingle sets of the classes in ``edges``."""
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    firsts = classes.join(nodes, "id").select("id", F.col("least.doc_id").alias("first_id"), F.col("least.th").alias("first_th"))
    texts = docs.select("doc_id", "text", text_hash(F.col("text")).alias("th"))
    texts = texts.join(firsts, texts["doc_id"].eqNullSafe(firsts["first_id"]) & (texts["th"] == firsts["first_th"])).select("id", "text")
    return materialize(texts.mapInArrow(_sets, "id long, hashes binary").dropDuplicates(["id"]), "sets")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with all its columns.

    Documents are told apart by doc_id and text, so different ones may share a doc_id; a
    null doc_id comes last. Of rows that agree in both, one stays.
    """
    classes = materialize(_classes(docs), "classes")
    pairs = materialize(near_pairs(classes), "pairs")
    edges = materialize(candidates(classes, pairs), "candidates")
    links = similar_links(edges, _sets_of(docs, classes, edges))
    more = materialize(remaining_links(docs, classes, pairs, links), "rest")
    links = more if links is None else links.union(more)
    roots = components(links, "a", "b")
    out = classes.join(roots, classes["id"] == roots["node"], "left").select(F.coalesce("root", "id").alias("root"), "least")
    kept_id, kept_th, th = fresh(docs, "__first"), fresh(docs, "__first_th"), fresh(docs, "__th")
    first = out.groupBy("root").agg(F.min("least").alias("least"))
    first = materialize(first.select(F.col("least.doc_id").alias(kept_id), F.col("least.th").alias(kept_th)), "firsts")
    keyed = docs.withColumn(th, text_hash(F.col("text")))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(F.col(kept_id)) & (keyed[th] == F.col(kept_th)), "left_semi")
    if kept.groupBy("doc_id", th).count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", th])
    return kept.drop(th)
