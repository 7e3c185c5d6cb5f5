"""Features of ego graphs, neighbours of types by a named metric, type clusters and families."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.store import numbered
from . import transport, vectors
from .motifs import shaped

Links = list[tuple[int, int, str]]


def _hashed(counts: Counter, width: int) -> np.ndarray:
    out = np.zeros(width)
    for name, n in counts.items():
        out[zlib.crc32(name.encode()) % width] += n
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def refined_labels(symbols: list[str], links: Links, rounds: int = 3) -> list[list[str]]:
    """Labels of all nodes after each round: degree and symbol, then typed messages both ways."""
    degree = Counter(x for u, v, _ in links for x in (u, v))
    now = [f"{degree[i]}:{s}" for i, s in enumerate(symbols)]
    out = [now]
    for _ in range(rounds):
        heard: list[list[str]] = [[] for _ in symbols]
        for u, v, r in links:
            heard[u].append(f"o:{r}:{now[v]}")
            heard[v].append(f"i:{r}:{now[u]}")
        now = [f"{zlib.crc32('|'.join([x, *sorted(h)]).encode()):08x}" for x, h in zip(now, heard, strict=True)]
        out.append(now)
    return out


def refined_histogram(symbols: list[str], links: Links, width: int = 64) -> np.ndarray:
    return _hashed(Counter(x for labels in refined_labels(symbols, links) for x in labels), width)


def graphlet_histogram(symbols: list[str], links: Links, width: int = 64) -> np.ndarray:
    """All subsets of 3 and 4 nodes by edge count, sorted degrees and relation counts."""
    found: Counter = Counter()
    for k in (3, 4):
        for some in itertools.combinations(range(len(symbols)), k):
            inner = [x for x in links if x[0] in some and x[1] in some]
            degree = Counter(x for u, v, _ in inner for x in (u, v))
            kinds = sorted(Counter(r for _, _, r in inner).items())
            found[f"{k}/{len(inner)}/{sorted(degree[i] for i in some)}/{kinds}"] += 1
    return _hashed(found, width)


def signature(symbols: list[str], links: Links) -> str:
    """A hash key equal for isomorphic typed graphs; a match is to be verified by the canonical form."""
    last = refined_labels(symbols, links)[-1]
    return f"{len(symbols)}.{len(links)}.{zlib.crc32('|'.join(sorted(last)).encode()):08x}.{'|'.join(sorted({r for _, _, r in links}))}"


def _of_egos(egos: DataFrame, value: Callable[[list[str], Links], object], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for center, nodes, links in zip(pdf["center"], pdf["nodes"], pdf["links"], strict=True):
                at = {int(x["node"]): i for i, x in enumerate(nodes)}
                rows.append((center, value([x["symbol"] for x in nodes], [(at[x["u"]], at[x["v"]], x["relation"]) for x in links])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return egos.mapInPandas(run, schema)


def signatures(egos: DataFrame) -> DataFrame:
    """(center, signature) of ego graphs."""
    return _of_egos(egos, signature, "center long, signature string")


def relation_histogram(relations: list[str]) -> Callable[[list[str], Links], np.ndarray]:
    return lambda symbols, links: np.array([sum(r == x for _, _, x in links) for r in relations], float)


def isomorphisms(egos: DataFrame) -> DataFrame:
    """(a, b, nodes_a, nodes_b): every ego with the first of its shape, and nodes that match in order.

    Both node lists follow the canonical form, so the lists are an isomorphism.
    """
    found = materialize(shaped(egos), "shaped")
    first = found.groupBy("shape").agg(F.min_by(F.struct("center", "order"), "center").alias("f"))
    return found.join(first, "shape").select(F.col("center").alias("a"), F.col("f.center").alias("b"), F.col("order").alias("nodes_a"), F.col("f.order").alias("nodes_b"))


#: Metrics by name: each gives (id, rank, nbr, distance) of the k nearest egos by center.
METRICS: dict[str, Callable[[DataFrame, list[str], int], DataFrame]] = {
    "typed_wl": lambda egos, _, k: vectors.cosine_knn(_features(egos, refined_histogram), k),
    "graphlet": lambda egos, _, k: vectors.cosine_knn(_features(egos, graphlet_histogram), k),
    "relation_js": lambda egos, relations, k: vectors.histogram_knn(_features(egos, relation_histogram(relations)), k),
    "lowrank_gw": lambda egos, relations, k: transport.transport_knn(materialize(transport.shapes(egos, relations), "shapes"), k, alpha=1.0),
    "fgw": lambda egos, relations, k: transport.transport_knn(materialize(transport.shapes(egos, relations), "shapes"), k),
}


def _features(egos: DataFrame, value: Callable[[list[str], Links], np.ndarray]) -> DataFrame:
    return materialize(_of_egos(egos, lambda s, x: value(s, x).tolist(), "id long, v array<double>"), "features")


def nearest_egos(egos: DataFrame, relations: list[str], metric: str, k: int) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {sorted(METRICS)}")
    return METRICS[metric](egos, relations, k)


def type_clusters(egos: DataFrame, types: DataFrame, relations: list[str], metric: str = "typed_wl", k: int = 4, significance: float = 0.7, least_size: int = 2) -> DataFrame:
    """(type, support, label, radius): density clusters of types, weighted by support.

    Types (shape, type, support) are represented by their first ego. ``label`` is the
    smallest center of the cluster, -1 for noise. One type alone is noise with radius 0.
    """
    found = materialize(shaped(egos), "shaped")
    first = materialize(found.groupBy("shape").agg(F.min("center").alias("center")).join(types, "shape"), "first")
    some = egos.join(first.select("center"), "center", "left_semi")
    knn = materialize(nearest_egos(some, relations, metric, k), "knn")
    labels = vectors.wishart_clusters(knn, k, significance, least_size, first.select(F.col("center").alias("id"), F.col("support").alias("weight")))
    radius = knn.groupBy("id").agg(F.max("distance").alias("radius"))
    joined = first.join(labels, first.center == labels.id, "left").drop("id").join(radius, F.col("center") == radius.id, "left")
    return joined.select("type", "support", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("radius", F.lit(0.0)).alias("radius"))


def resolve_families(known: dict[str, set[str]], clusters: list[set[str]], least: float = 0.5) -> list[str]:
    """Family of each cluster in turn: the most alike known one (ties: smallest name), else a new one.

    ``known`` is updated: a family takes in the types of every cluster it matches. The fold
    is sequential and as long as the number of clusters, which the dictionary bounds.
    """
    out = []
    for types in clusters:
        score, name = min(((-len(types & f) / len(types | f), x) for x, f in known.items()), default=(0.0, ""))
        if not name or -score < least:
            name = f"WF_{len(known) + 1:06d}"
            known[name] = set()
        known[name] |= types
        out.append(name)
    return out


def vector_families(vectors_: DataFrame, covered: DataFrame, k: int = 8, significance: float = 0.7, least_size: int = 3) -> DataFrame:
    """(id, label) of all ids: density clusters of the covered ones, -1 for the rest."""
    knn = materialize(vectors.cosine_knn(vectors_.join(covered.select("id"), "id", "left_semi"), k), "knn")
    labels = vectors.wishart_clusters(knn, k, significance, least_size)
    return vectors_.select("id").join(labels, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def connectors(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, internal, outgoing, incoming, by_relation, exit): weights across the borders of labels.

    ``exit`` is the outgoing share of all weight that leaves the label's nodes.
    """
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    rows = edges.join(a, "src").join(b, "dst").groupBy("a", "b", "relation").agg(F.sum("weight").alias("w"))
    sides = rows.select(F.col("a").alias("label"), "relation", F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("i"), F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0).alias("o"), F.lit(0.0).alias("n"))
    sides = sides.union(rows.filter("a <> b").select("b", "relation", F.lit(0.0), F.lit(0.0), "w"))
    per = sides.groupBy("label", "relation").agg(*[F.sum(c).alias(c) for c in "ion"])
    entry = F.concat("relation", F.lit("="), F.col("o").cast("decimal(30,4)").cast("string"))
    out = per.groupBy("label").agg(F.sum("i").alias("internal"), F.sum("o").alias("outgoing"), F.sum("n").alias("incoming"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("o") > 0, entry))), ",").alias("by_relation"))
    return out.withColumn("exit", F.try_divide("outgoing", F.col("internal") + F.col("outgoing")))


def candidate_pairs(points: DataFrame, k: int = 7) -> DataFrame:
    """(src, dst, distance), src < dst: the k nearest of every point, for matching without edges."""
    knn = vectors.euclidean_knn(points, k)
    return knn.groupBy(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).agg(F.min("distance").alias("distance"))


SET_BLOCK, SET_COLUMNS = 2000, 4096


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets ``x`` with sets ``y``, by products over slices of their common tokens."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(t) for t in sets]), np.concatenate([np.empty(0, np.int64), *sets])

    (xr, xt), (yr, yt) = flat(x), flat(y)
    shared = np.intersect1d(xt, yt)
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, len(shared), SET_COLUMNS):
        some = shared[at : at + SET_COLUMNS]
        sides = []
        for rows, tokens, n in ((xr, xt, len(x)), (yr, yt, len(y))):
            column = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
            here = some[column] == tokens
            dense = np.zeros((n, len(some)), np.float32)
            dense[rows[here], column[here]] = 1
            sides.append(dense)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def best_set_match(rows: DataFrame, left: str, right: str, block_rows: int = SET_BLOCK) -> DataFrame:
    """(left_id, right_id, both_n, left_n, right_n): the right id whose set is most alike by Jaccard, ties by id.

    ``rows`` are distinct (s, x, y); a set is those of one s, and only tokens without a null
    are shared. ``left`` and ``right`` are conditions on s; ids without a shared token are
    absent. Equal sets are compared once, and classes of equal sets meet in pairs of blocks,
    so no row is made for a pair of ids.
    """
    rows = materialize(rows, "tokens")
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    tokens = materialize(numbered(rows.filter(whole).select("x", "y").distinct(), ["x", "y"], "token"), "vocabulary")
    named = rows.filter(f"({left}) or ({right})").join(tokens, ["x", "y"], "left")
    sets = materialize(named.groupBy("s").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("token")).alias("tokens")), "sets")
    classes = sets.groupBy("tokens", "n").agg(F.min("s").alias("class"), F.min(F.expr(f"case when {left} then s end")).alias("l"), F.min(F.expr(f"case when {right} then s end")).alias("r"))
    classes = materialize(classes.filter(F.size("tokens") > 0), "classes")
    many = classes.agg(F.count("l").alias("l"), F.count("r").alias("r")).first()
    a, b = (max(1, -(-many[c] // block_rows)) for c in "lr")
    block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    xs = classes.filter("l is not null").select(block(a).alias("a"), each(b).alias("b"), F.lit(0).alias("side"), F.col("class").alias("id"), "n", "tokens")
    ys = classes.filter("r is not null").select(each(a).alias("a"), block(b).alias("b"), F.lit(1).alias("side"), F.col("r").alias("id"), "n", "tokens")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("id")
        out = pd.DataFrame({c: np.empty(0, np.int64) for c in ("class", "right_id", "both_n", "left_n", "right_n")})
        if not len(x) or not len(y):
            return out
        both = _overlaps([np.asarray(t, np.int64) for t in x["tokens"]], [np.asarray(t, np.int64) for t in y["tokens"]])
        xn, yn = x["n"].to_numpy(), y["n"].to_numpy()
        best = np.floor(both / (xn[:, None] + yn[None, :] - both) * 1e9 + 0.5).argmax(axis=1)
        at = np.arange(len(x))
        found = pd.DataFrame({"class": x["id"].to_numpy(), "right_id": y["id"].to_numpy()[best], "both_n": both[at, best], "left_n": xn, "right_n": yn[best]})
        return found[found.both_n > 0]

    found = xs.union(ys).groupBy("a", "b").applyInPandas(run, "class long, right_id long, both_n long, left_n long, right_n long")
    order = F.struct((-F.round(F.col("both_n") / (F.col("left_n") + F.col("right_n") - F.col("both_n")), 9)).alias("d"), "right_id", "both_n", "left_n", "right_n")
    best = found.groupBy("class").agg(F.min(order).alias("o"))
    members = sets.filter(left).select("s", "n", "tokens").join(classes.select("tokens", "n", "class"), ["tokens", "n"]).select(F.col("s").alias("left_id"), "class")
    return members.join(best, "class").select("left_id", "o.right_id", "o.both_n", "o.left_n", "o.right_n")
