"""Vector operators: exact blocked k-nearest neighbours and density clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SWEEP_POINTS = 1_000_000


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norm > 0, norm, 1)

    return 1 - unit(x) @ unit(y).T


def _euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _jensen_shannon(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def share(m: np.ndarray) -> np.ndarray:
        total = m.sum(axis=1, keepdims=True)
        return m / np.where(total > 0, total, 1)

    def entropy_terms(m: np.ndarray) -> np.ndarray:
        return np.where(m > 0, m * np.log2(np.where(m > 0, m, 1)), 0)

    p, q = share(x), share(y)
    mixed = np.zeros((len(p), len(q)))
    for i in range(p.shape[1]):
        mixed += entropy_terms((p[:, i, None] + q[None, :, i]) / 2)
    own = (entropy_terms(p).sum(axis=1)[:, None] + entropy_terms(q).sum(axis=1)[None, :]) / 2
    out = np.sqrt(np.maximum(own - mixed, 0))
    none_p, none_q = (p.sum(axis=1) == 0)[:, None], (q.sum(axis=1) == 0)[None, :]
    return np.where(none_p & none_q, 0.0, np.where(none_p | none_q, 1.0, out))


def cosine_knn(vectors: DataFrame, k: int, block_rows: int = 1000) -> DataFrame:
    """(id, rank, nbr, distance): the k nearest by cosine distance, ties by id, self excluded.

    Zero vectors are at distance 1 from all.
    """
    return _blocked_knn(vectors, k, block_rows, _cosine)


def histogram_knn(vectors: DataFrame, k: int, block_rows: int = 1000) -> DataFrame:
    """As ``cosine_knn``, by the Jensen-Shannon distance (base 2) of histograms.

    Two empty histograms are at distance 0, an empty one is at 1 from any other.
    """
    return _blocked_knn(vectors, k, block_rows, _jensen_shannon)


def euclidean_knn(vectors: DataFrame, k: int, block_rows: int = 1000) -> DataFrame:
    """As ``cosine_knn``, by the Euclidean distance."""
    return _blocked_knn(vectors, k, block_rows, _euclidean)


def _block_pairs(vectors: DataFrame, block_rows: int, found, schema: str) -> DataFrame:
    """Vectors are dealt to blocks, and ``found(ids, values, ids, values)`` sees every pair of blocks in one task.

    Memory is two blocks a task, whatever the number of vectors.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))
    dealt = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = dealt.select(F.col("block").alias("a"), F.explode(ids).alias("b"), F.lit(0).alias("side"), "id", "v")
    right = dealt.select(F.explode(ids).alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), "id", "v")
    values = lambda pdf: np.array(pdf["v"].tolist(), np.float64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}).astype({c.split()[0]: "float64" if c.endswith("double") else "int64" for c in schema.split(", ")})
        return found(x["id"].to_numpy(), values(x), y["id"].to_numpy(), values(y))

    return left.union(right).groupBy("a", "b").applyInPandas(run, schema)


def _blocked_knn(vectors: DataFrame, k: int, block_rows: int, distance) -> DataFrame:
    """Every pair of blocks keeps k candidates a row, and the candidates are ranked."""

    def nearest(xi: np.ndarray, x: np.ndarray, yi: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        d = np.round(distance(x, y), 9)
        d[xi[:, None] == yi[None, :]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"id": np.repeat(xi, order.shape[1]), "nbr": yi[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()})
        return out[np.isfinite(out.distance)]

    found = _block_pairs(vectors, block_rows, nearest, "id long, nbr long, distance double")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "nbr"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "nbr", "distance")


def similarity_edges(vectors: DataFrame, threshold: float, block_rows: int = 1000) -> DataFrame:
    """(src, dst, similarity), src < dst: all pairs of cosine similarity of at least ``threshold``."""

    def near(xi: np.ndarray, x: np.ndarray, yi: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        s = np.round(1 - _cosine(x, y), 9)
        i, j = np.nonzero((s >= threshold) & (xi[:, None] < yi[None, :]))
        return pd.DataFrame({"src": xi[i], "dst": yi[j], "similarity": s[i, j]})

    return _block_pairs(vectors, block_rows, near, "src long, dst long, similarity double")


def knn_under_exclusion(knn: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """Ranks anew among kept ids only; ``knn`` holds complete enough lists."""
    a, b = kept.select("id"), kept.select(F.col("id").alias("nbr"))
    some = knn.join(a, "id", "left_semi").join(b, "nbr", "left_semi")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("distance", "nbr"))).filter(F.col("rank") <= k).select("id", "rank", "nbr", "distance")


def wishart_sweep(ids: np.ndarray, radius: np.ndarray, neighbours: dict[int, list[int]], significance: float, least_size: int, weight: np.ndarray | None = None) -> dict[int, int]:
    """Labels (-1 noise) by a sweep over points by falling density, ties by id.

    The density is the weight (1 unless given) over the radius, in logarithms.
    """
    mass = np.zeros(len(ids)) if weight is None else np.log(np.maximum(np.asarray(weight, float), 1e-12))
    density = dict(zip(ids.tolist(), (mass - np.log(np.maximum(radius, 1e-12))).tolist(), strict=True))
    label: dict[int, int] = {}
    peak: dict[int, float] = {}
    closed: set[int] = set()
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent[c] != c:
            c = parent[c]
        return c

    fresh = 0
    for p in sorted(density, key=lambda i: (-density[i], i)):
        near = sorted({root(label[q]) for q in neighbours.get(p, ()) if q in label and label[q] >= 0} - {0})
        if not near:
            fresh += 1
            label[p], parent[fresh], peak[fresh] = fresh, fresh, density[p]
        elif len(near) == 1:
            label[p] = -1 if near[0] in closed else near[0]
        else:
            strong = [c for c in near if peak[c] - density[p] >= significance]
            if len(strong) > 1 or any(c in closed for c in near):
                closed.update(strong)
                for c in near:
                    if c not in strong and c not in closed:
                        parent[c] = 0
                label[p] = -1
                parent.setdefault(0, 0)
            else:
                keep = max(near, key=lambda c: (peak[c], -c))
                for c in near:
                    parent[c] = keep
                label[p] = keep
    final = {p: (root(c) if c >= 0 else -1) for p, c in label.items()}
    sizes: dict[int, int] = {}
    for c in final.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {p: (c if c > 0 and sizes[c] >= least_size else -1) for p, c in final.items()}


def wishart_clusters(knn: DataFrame, k: int, significance: float = 0.7, least_size: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """(id, label) by density; label is the smallest id of the cluster, -1 for noise.

    ``weights`` (id, weight) scale the densities.

    The sweep follows neighbour links only, so it runs on its own in each component of the
    neighbour graph. It takes points one by one, so a component must fit one task: over
    ``SWEEP_POINTS`` points it raises before any is collected.
    """
    from ..session import materialize
    from .iterative import component_labels

    graph = knn.filter(F.col("rank") <= k)
    radius = graph.groupBy("id").agg(F.max("distance").alias("radius"), F.sort_array(F.collect_list("nbr")).alias("nbrs"))
    radius = radius.withColumn("weight", F.lit(1.0)) if weights is None else radius.join(weights.select("id", F.col("weight").cast("double").alias("weight")), "id")
    labels = component_labels(graph.select(F.col("id").alias("node")), graph.select(F.col("id").alias("src"), F.col("nbr").alias("dst")))
    labels = materialize(labels, "components")
    if (labels.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > SWEEP_POINTS:
        raise ValueError(f"a component of the neighbour graph has over {SWEEP_POINTS} points: take a smaller k")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict[int, set[int]] = {}
        for i, nbrs in zip(pdf["id"].tolist(), pdf["nbrs"], strict=True):
            for j in nbrs:
                links.setdefault(int(i), set()).add(int(j))
                links.setdefault(int(j), set()).add(int(i))
        got = wishart_sweep(pdf["id"].to_numpy(), pdf["radius"].to_numpy(), {k_: sorted(v) for k_, v in links.items()}, significance, least_size, pdf["weight"].to_numpy())
        out = pd.DataFrame({"id": list(got), "c": list(got.values())})
        first = out[out.c >= 0].groupby("c")["id"].min()
        out["label"] = [int(first[c]) if c >= 0 else -1 for c in out.c]
        return out[["id", "label"]]

    return radius.join(labels, radius.id == labels.node).groupBy("root").applyInPandas(sweep, "id long, label long")


def lsh_buckets(vectors: DataFrame, planes: int = 16, seed: int = 3) -> DataFrame:
    """(id, bucket) by random hyperplanes: an index for approximate search."""
    first = vectors.select(F.size("v").alias("d")).first()
    normal = np.random.default_rng(seed).normal(size=(first["d"] if first else 1, planes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1) @ normal > 0
            yield pd.DataFrame({"id": pdf["id"], "bucket": bits @ (1 << np.arange(planes))})

    return vectors.select("id", "v").mapInPandas(run, "id long, bucket long")


def adjusted_rand(labels: DataFrame, other: DataFrame) -> DataFrame:
    """(ari): agreement of two labelings (id, label) on the ids of both, from pair counts."""
    cells = labels.join(other.select("id", F.col("label").alias("other")), "id").groupBy("label", "other").agg(F.count("*").alias("n"))
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    total = lambda key: cells.groupBy(key).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias(key))
    same = cells.agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("same"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = same.crossJoin(total("label")).crossJoin(total("other"))
    chance = F.col("label") * F.col("other") / F.nullif(pairs("n"), F.lit(0.0))
    top = (F.col("label") + F.col("other")) / 2
    return one.select(F.coalesce((F.col("same") - chance) / F.nullif(top - chance, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def k_sweep(vectors: DataFrame, ks: list[int], repeats: int = 2, share: float = 0.8, significance: float = 0.7) -> DataFrame:
    """(k, repeat, clusters, noise_share, ari): density clusters for each k and their stability.

    A repeat clusters a hashed subsample anew, from neighbour lists long enough to be
    complete after the exclusion of the rest but for rare cases, and compares the labels
    by the adjusted Rand index.
    """
    from ..session import materialize

    spark = vectors.sparkSession
    knn = materialize(cosine_knn(vectors, 4 * max(ks)), "knn")
    rows = []
    for k in ks:
        whole = materialize(wishart_clusters(knn.filter(F.col("rank") <= k), k, significance), "labels")
        n, clusters, noise = whole.agg(F.count("*"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))), F.coalesce(F.sum((F.col("label") < 0).cast("long")), F.lit(0))).first()
        for repeat in range(repeats):
            kept = vectors.select("id").filter(F.pmod(F.xxhash64("id", F.lit(repeat)), F.lit(1000)) < int(1000 * share))
            part = wishart_clusters(materialize(knn_under_exclusion(knn, kept, k), "part"), k, significance)
            rows.append((k, repeat, clusters, noise / n if n else 0.0, float(adjusted_rand(whole, part).first()["ari"])))
    return spark.createDataFrame(rows, "k int, repeat int, clusters long, noise_share double, ari double")
