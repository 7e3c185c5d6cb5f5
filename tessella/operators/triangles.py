"""Triangles of every node, by blocks of edges in place of a join of all wedges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

#: Edges of a task on average, wedges of a step within it, and edges dealt out at a time.
TASK_EDGES, STEP, DEAL = 5_000_000, 1_000_000, 2_000_000


def count_triangles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, triangles of each) of distinct undirected edges (a, b), a <> b.

    Edges run from the end of lower degree, which bounds the wedges by edges ** 1.5. A
    wedge is closed if its ends are an edge, looked up by bisection in a step of bounded size.
    """
    nodes = np.union1d(np.unique(a), np.unique(b))
    u, v = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    order = np.argsort(np.bincount(u, minlength=len(nodes)) + np.bincount(v, minlength=len(nodes)), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    u, v = rank[u], rank[v]
    code = np.minimum(u, v) * len(nodes) + np.maximum(u, v)
    code.sort()
    u, v = np.divmod(code, max(1, len(nodes)))
    start = np.searchsorted(u, np.arange(len(nodes) + 1))
    later = start[u + 1] - np.arange(len(u)) - 1  # edges of the same lower end after this one
    total = np.concatenate([[0], np.cumsum(later)])
    found = np.zeros(len(nodes), np.int64)
    at = 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
        first = np.repeat(np.arange(at, to), later[at:to])
        second = np.arange(len(first)) - np.repeat(total[at:to] - total[at], later[at:to]) + first + 1
        wanted = v[first] * len(nodes) + v[second]
        place = np.searchsorted(code, wanted)
        closed = code[np.minimum(place, len(code) - 1)] == wanted
        first, second = first[closed], second[closed]
        for corner in (u[first], v[first], v[second]):
            found += np.bincount(corner, minlength=len(nodes))
        at = to
    return nodes[order], found


def _colour(ids: np.ndarray, p: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % p


def _tasks(p: int) -> tuple[list[tuple[int, ...]], dict[tuple[int, int], list[int]]]:
    """The sets of one to three of ``p`` colours, and the numbers of those that need the edges of each pair."""
    sets = [(i,) for i in range(p)] + [(i, j) for i in range(p) for j in range(i + 1, p)]
    sets += [(i, j, k) for i in range(p) for j in range(i + 1, p) for k in range(j + 1, p)]
    needs: dict[tuple[int, int], list[int]] = {}
    for n, colours in enumerate(sets):
        for i in colours:
            for j in colours:
                if i < j or i == j and len(colours) < 3:
                    needs.setdefault((i, j), []).append(n)
    return sets, needs


def _pack(a: np.ndarray, b: np.ndarray) -> bytes:
    """Sorted edges as differences, byte by byte, so that they compress."""
    both = np.concatenate([np.diff(a, prepend=0), b - a])
    return np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    a = np.cumsum(both[: len(both) // 2])
    return a, a + both[len(both) // 2 :]


def _deal(p: int):
    _, needs = _tasks(p)

    def blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        x, y = _colour(a, p), _colour(b, p)
        key = np.minimum(x, y) * p + np.maximum(x, y)
        order = np.lexsort((b, a, key))
        key, a, b = key[order], a[order], b[order]
        for k in np.unique(key):
            lo, hi = np.searchsorted(key, [k, k + 1])
            blob = pa.compress(_pack(a[lo:hi], b[lo:hi]), codec="zstd", asbytes=True)
            to = needs[divmod(int(k), p)]
            columns = [pa.array(to, pa.int32()), pa.array([hi - lo] * len(to), pa.int64()), pa.array([blob] * len(to), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["task", "edges", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)))
            n += batch.num_rows
            if n >= DEAL:
                yield from blocks(parts)
                parts, n = [], 0
        if n:
            yield from blocks(parts)

    return run


def _count(p: int):
    sets, _ = _tasks(p)

    def rows(task: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*(_unpack(pa.decompress(z, n * 16, codec="zstd", asbytes=True)) for n, z in blobs), strict=True))
        nodes, found = count_triangles(a, b)
        # a triangle of one colour is also in the p - 1 pairs of that colour
        found = found * (2 - p if len(sets[task]) == 1 else 1)
        order = np.argsort(nodes)
        nodes, found = nodes[order], found[order]
        # edges within a colour are counted in its own task, others in that of their pair
        own = _colour(a, p) != _colour(b, p) if len(sets[task]) == 2 else np.full(len(a), len(sets[task]) == 1)
        later = np.bincount(np.searchsorted(nodes, a[own]), minlength=len(nodes))
        degree = later + np.bincount(np.searchsorted(nodes, b[own]), minlength=len(nodes))
        some = (degree > 0) | (found != 0)
        return pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in (nodes, degree, later, found)], ["node", "degree", "later", "triangles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blobs = None, []
        for batch in batches:
            for task, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if task != last and blobs:
                    yield rows(last, blobs)
                    blobs = []
                last = task
                blobs.append((n, blob))
        if blobs:
            yield rows(last, blobs)

    return run


def node_triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, later, triangles) of distinct edges (src, dst), src < dst; ``later`` is the number of larger neighbours.

    Nodes get one of p colours by hash. A task sees the edges between three colours, among
    two, or within one, so every triangle is found, and those found more than once are taken
    off again. An edge is sent to p tasks, packed; no row is made for a wedge.
    """
    m = edges.count()
    p = max(1, math.ceil(math.sqrt(6 * m / TASK_EDGES)))
    dealt = edges.select("src", "dst").mapInArrow(_deal(p), "task int, edges long, blob binary")
    tasks = max(len(_tasks(p)[0]), shuffle_partitions(edges.sparkSession))
    parts = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("task").mapInArrow(_count(p), "node long, degree long, later long, triangles long")
    return materialize(parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("degree", "later", "triangles")]), "triangles")
