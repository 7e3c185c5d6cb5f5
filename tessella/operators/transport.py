"""Optimal-transport distances between small typed graphs, in numpy over a table of pairs.

A graph is a row (id, cost, feature): ``cost`` holds the hop distances between its
landmarks, ``feature`` a relation profile per landmark. Graphs are bounded by the number
of landmarks, so a pair is one row and pairs are spread over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import cosine_knn

#: Pairs solved side by side.
BATCH = 256
SHAPE = "id long, cost array<array<double>>, feature array<array<double>>, descriptor array<double>"


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _padded(found: list[np.ndarray], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((len(found), rows, columns))
    for i, x in enumerate(found):
        out[i, : x.shape[0], : x.shape[1]] = x
    return out


def fused_gromov_wasserstein(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alpha: float = 0.5, epsilon: float = 0.05, outer: int = 20, inner: int = 100, tolerance: float = 0.02) -> np.ndarray:
    """Square roots of the fused objective at entropic plans, without the entropy itself.

    A pair is (cost, feature) of the left and of the right graph, with uniform masses.
    ``alpha`` weighs structure against features; 1 gives the plain Gromov-Wasserstein
    distance. All pairs are solved side by side: the inner loop is Sinkhorn scaling in
    the log domain, the outer one renews the structural cost. A plan whose marginals are
    off by over ``tolerance`` raises.
    """
    if not pairs:
        return np.zeros(0)
    size = max(len(x) for pair in pairs for x in pair)
    width = pairs[0][1].shape[1]
    c1, c2 = (_padded([pair[i] for pair in pairs], size, size) for i in (0, 2))
    f1, f2 = (_padded([pair[i] for pair in pairs], size, width) for i in (1, 3))
    mass = lambda i: np.array([[1 / len(pair[i]) if j < len(pair[i]) else 0.0 for j in range(size)] for pair in pairs])
    p, q = mass(0), mass(2)
    real = (p[:, :, None] > 0) & (q[:, None, :] > 0)
    log_p, log_q = (np.where(x > 0, np.log(np.where(x > 0, x, 1)), -1e9) for x in (p, q))
    m = np.where(real, ((f1[:, :, None, :] - f2[:, None, :, :]) ** 2).sum(axis=3), 0)
    constant = (c1**2 @ p[:, :, None]) + (c2**2 @ q[:, :, None]).transpose(0, 2, 1)
    structure = lambda t: np.maximum(constant - 2 * c1 @ t @ c2.transpose(0, 2, 1), 0)
    plan = p[:, :, None] * q[:, None, :]
    for _ in range(outer):
        k = np.where(real, -((1 - alpha) * m + alpha * structure(plan)) / epsilon, -1e9)
        v = np.zeros_like(q)
        for _ in range(inner):
            u = log_p - _logsumexp(k + v[:, None, :], 2)
            v = log_q - _logsumexp(k + u[:, :, None], 1)
        plan = np.where(real, np.exp(np.minimum(k + u[:, :, None] + v[:, None, :], 0)), 0)
    off = max(np.abs(plan.sum(axis=2) - p).max(), np.abs(plan.sum(axis=1) - q).max())
    if not off <= tolerance:
        raise FloatingPointError("a plan misses its marginals: raise epsilon or the iterations")
    return np.sqrt(np.maximum(0, ((1 - alpha) * m * plan + alpha * structure(plan) * plan).sum(axis=(1, 2))))


def _hops(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    near: list[set[int]] = [set() for _ in range(n)]
    for u, v in links:
        near[u].add(v)
        near[v].add(u)
    out = np.full((n, n), float(n))  # unreachable: farther than any path
    for s in range(n):
        out[s, s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if out[s, v] == n and v != s:
                    out[s, v] = out[s, u] + 1
                    queue.append(v)
    return out


def shapes(egos: DataFrame, relations: list[str], landmarks: int = 8) -> DataFrame:
    """``SHAPE`` rows of ego graphs (center, nodes, links); landmarks by falling degree, then place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = {(r, side): 2 * i + side for i, r in enumerate(relations) for side in (0, 1)}
        for pdf in batches:
            rows = []
            for center, nodes, links in zip(pdf["center"], pdf["nodes"], pdf["links"], strict=True):
                at = {int(x["node"]): i for i, x in enumerate(nodes)}
                pairs = [(at[x["u"]], at[x["v"]]) for x in links]
                feature, degree = np.zeros((len(at), max(1, 2 * len(relations)))), np.zeros(len(at))
                for (u, v), x in zip(pairs, links, strict=True):
                    feature[u, column[x["relation"], 0]] += 1
                    feature[v, column[x["relation"], 1]] += 1
                for u, v in {(min(p), max(p)) for p in pairs}:
                    degree[[u, v]] += 1
                total = feature.sum(axis=1, keepdims=True)
                feature = feature / np.where(total > 0, total, 1)
                keep = np.lexsort((np.arange(len(at)), -degree))[:landmarks]
                cost = _hops(len(at), pairs)[np.ix_(keep, keep)]
                described = np.r_[feature.mean(axis=0), degree.mean() / len(at), cost.mean() / len(at), 1.0]
                rows.append((center, cost.tolist(), feature[keep].tolist(), described.tolist()))
            yield pd.DataFrame(rows, columns=["id", "cost", "feature", "descriptor"])

    return egos.mapInPandas(run, SHAPE)


def shortlist(found: DataFrame, k: int, exact: int = 64) -> DataFrame:
    """(a, b), a < b: all pairs of up to ``exact`` shapes, else the k nearest by descriptor, both ways."""
    if found.limit(exact + 1).count() <= exact:
        ids = found.select("id")
        return ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    near = cosine_knn(found.select("id", F.col("descriptor").alias("v")), k)
    return near.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


def distances(found: DataFrame, pairs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(a, b, distance) of the pairs, each computed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = lambda x: np.array([np.asarray(r, float) for r in x])
        for pdf in batches:
            values = np.zeros(len(pdf))
            for i in range(0, len(pdf), BATCH):
                some = [(matrix(r.ca), matrix(r.fa), matrix(r.cb), matrix(r.fb)) for r in pdf.iloc[i : i + BATCH].itertuples()]
                values[i : i + BATCH] = fused_gromov_wasserstein(some, alpha)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "distance": values})

    left = found.select(F.col("id").alias("a"), F.col("cost").alias("ca"), F.col("feature").alias("fa"))
    right = found.select(F.col("id").alias("b"), F.col("cost").alias("cb"), F.col("feature").alias("fb"))
    spread = pairs.join(left, "a").join(right, "b").repartition("a", "b")
    return spread.mapInPandas(run, "a long, b long, distance double")


def transport_knn(found: DataFrame, k: int, alpha: float = 0.5, exact: int = 64) -> DataFrame:
    """(id, rank, nbr, distance) by the fused distance over the shortlist; ties by id."""
    d = distances(found, shortlist(found, k, exact), alpha)
    both = d.select(F.col("a").alias("id"), F.col("b").alias("nbr"), "distance").union(d.select("b", "a", "distance"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "nbr"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "nbr", "distance")
