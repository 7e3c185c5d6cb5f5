"""Motif mining: typed ego graphs, canonical forms, selection by description length, contraction.

Edges are (src, dst, relation, weight); a symbol table (node, symbol) names node types.
An ego graph has at most ``cap`` nodes, so one row holds it, and its canonical form is
computed row by row. All that grows with the graph stays in Spark; only the code lengths
of a bounded dictionary are worked out on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.store import checksum, drop_levels, load, newest_level, save_level
from .coding import huffman_lengths

ATOM = "ATOM"
CANDIDATE = "center long, shape string, n long, e long, nodes array<long>, order array<long>"


def ego_nodes(edges: DataFrame, cap: int = 12) -> DataFrame:
    """(center, node): each node and its first ``cap - 1`` neighbours by id; lone centers go."""
    # dealt by node first: the distinct pairs and the window then need no further exchange
    near = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").repartition("src").distinct()
    place = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    some = near.withColumn("place", place).filter(F.col("place") < cap).select(F.col("src").alias("center"), F.col("dst").alias("node"))
    return some.union(some.select("center", F.col("center").alias("node")).distinct())


def ego_graphs(edges: DataFrame, symbols: DataFrame, cap: int = 12) -> DataFrame:
    """(center, nodes, links): one row per ego, nodes as (node, symbol), links as (u, v, relation)."""
    egos = materialize(ego_nodes(edges, cap), "egos")
    named = egos.join(symbols, "node", "left").withColumn("symbol", F.coalesce("symbol", F.lit(ATOM)))
    nodes = named.groupBy("center").agg(F.sort_array(F.collect_list(F.struct("node", "symbol"))).alias("nodes"))
    a = egos.select("center", F.col("node").alias("src"))
    b = egos.select("center", F.col("node").alias("dst"))
    inner = edges.filter("src <> dst").select("src", "dst", "relation").distinct().join(a, "src").join(b, ["center", "dst"])
    links = inner.groupBy("center").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), "relation"))).alias("links"))
    return nodes.join(links, "center")


def _refine(colour: list[int], out: list[list[tuple]], into: list[list[tuple]]) -> list[int]:
    """Stable colours: nodes stay together while their typed neighbourhoods agree."""
    while True:
        signs = [(c, sorted((r, colour[v]) for r, v in out[i]), sorted((r, colour[v]) for r, v in into[i])) for i, c in enumerate(colour)]
        ranked = sorted(range(len(colour)), key=lambda i: signs[i])
        fresh, at = [0] * len(colour), 0
        for k, i in enumerate(ranked):
            if k and signs[i] != signs[ranked[k - 1]]:
                at = k
            fresh[i] = at
        if len(set(fresh)) == len(set(colour)):
            return fresh
        colour = fresh


def canonical_form(symbols: Sequence[str], links: Sequence[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """(form, order): equal forms if and only if the typed graphs are isomorphic.

    Colours are refined and, where a cell has several members, each is singled out in
    turn; the smallest form wins. Members whose exchange maps the graph onto itself give
    the same form, so one of each such group is enough.
    """
    n = len(symbols)
    edge = {(u, v): () for u, v, _ in links}
    for u, v, r in sorted(set(links)):
        edge[u, v] += (r,)
    out = [[(edge[u, v], v) for (u, v) in edge if u == i] for i in range(n)]
    into = [[(edge[u, v], u) for (u, v) in edge if v == i] for i in range(n)]
    kinds = sorted(set(symbols))

    def twins(a: int, b: int) -> bool:
        swap = {a: b, b: a}
        rest = [(u, v) for (u, v) in edge if u in swap or v in swap]
        return all(edge.get((swap.get(u, u), swap.get(v, v))) == edge[u, v] for u, v in rest)

    best: list = [None, None]

    def search(colour: list[int]) -> None:
        colour = _refine(colour, out, into)
        size = Counter(colour)
        open_ = [c for c in size if size[c] > 1]
        if not open_:
            form = (tuple(symbols[i] for i in sorted(range(n), key=colour.__getitem__)), tuple(sorted((colour[u], colour[v], r) for (u, v), r in edge.items())))
            if best[0] is None or form < best[0]:
                best[:] = form, sorted(range(n), key=colour.__getitem__)
            return
        cell = [i for i in range(n) if colour[i] == min(open_)]
        tried: list[int] = []
        for i in cell:
            if not any(twins(i, j) for j in tried):
                tried.append(i)
                # the chosen member goes before the rest of its cell
                search([2 * c + (c == min(open_) and j != i) for j, c in enumerate(colour)])

    search([kinds.index(s) for s in symbols])
    names, pairs = best[0]
    return ";".join([",".join(names), *(f"{u}>{v}:{'|'.join(r)}" for u, v, r in pairs)]), best[1]


def candidates(edges: DataFrame, symbols: DataFrame, cap: int = 12) -> DataFrame:
    """One row per ego of the graph; see ``shaped``."""
    return shaped(ego_graphs(edges, symbols, cap))


def shaped(egos: DataFrame) -> DataFrame:
    """One row per ego graph: its canonical shape, sizes, sorted nodes, and nodes in canonical order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for center, nodes, links in zip(pdf["center"], pdf["nodes"], pdf["links"], strict=True):
                ids = [int(x["node"]) for x in nodes]
                at = {v: i for i, v in enumerate(ids)}
                form, order = canonical_form([x["symbol"] for x in nodes], [(at[x["u"]], at[x["v"]], x["relation"]) for x in links])
                rows.append((center, form, len(ids), len(links), ids, [ids[i] for i in order]))
            yield pd.DataFrame(rows, columns=["center", "shape", "n", "e", "nodes", "order"])

    return egos.mapInPandas(run, CANDIDATE)


def boundary_ports(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """(center, node, relation, direction, n): edges of ego nodes that leave the ego.

    ``egos`` has distinct rows. The edges of a node are counted once for all egos it is in,
    and those that stay within the ego are taken off, so no row is made for an ego and an
    edge of one of its nodes.
    """
    edges, egos = materialize(edges.filter("src <> dst").select("src", "dst", "relation"), "edges"), materialize(egos.select("center", "node"), "egos")
    sides = edges.select(F.col("src").alias("node"), "relation", F.lit("o").alias("direction")).union(edges.select("dst", "relation", F.lit("i")))
    ports = F.collect_list(F.struct("relation", "direction", "n")).alias
    every = sides.groupBy("node", "relation", "direction").agg(F.count("*").alias("n")).groupBy("node").agg(ports("ports"))
    pairs = egos.groupBy("center").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("center", F.posexplode("nodes").alias("at", "a"), "nodes")
    pairs = pairs.select("center", "a", F.explode(F.slice("nodes", F.col("at") + 2, F.size("nodes"))).alias("b"))
    placed = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation", (F.col("src") < F.col("dst")).alias("rising"))
    within = pairs.join(placed, ["a", "b"])
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.when(F.col("rising") == up, "o").otherwise("i").alias("direction")) for c, up in (("a", True), ("b", False))])
    within = within.select("center", "relation", F.explode(ends).alias("e")).groupBy("center", F.col("e.node").alias("node"), "relation", F.col("e.direction").alias("direction")).agg(F.count("*").alias("n"))
    inner = within.groupBy("center", "node").agg(ports("inner"))
    met = egos.join(inner, ["center", "node"], "left").join(every, "node")

    def left(port: Column) -> Column:
        same = F.filter("inner", lambda x: x["relation"].eqNullSafe(port["relation"]) & (x["direction"] == port["direction"]))
        return port["n"] - F.coalesce(F.get(same, F.lit(0))["n"], F.lit(0))

    found = met.select("center", "node", F.explode(F.transform("ports", lambda p: F.struct(p["relation"].alias("relation"), p["direction"].alias("direction"), left(p).alias("n")))).alias("p"))
    return found.select("center", "node", "p.relation", "p.direction", "p.n").filter("n > 0")


def registry(found: DataFrame, least_support: int = 2) -> DataFrame:
    """(shape, type, support): supported shapes named ``GT_000000`` on by their first center.

    Occurrences with the same shape and node set count once.
    """
    once = found.dropDuplicates(["shape", "nodes"]) if "nodes" in found.columns else found
    kinds = once.groupBy("shape").agg(F.count("*").alias("support"), F.min("center").alias("first")).filter(F.col("support") >= least_support)
    number = F.row_number().over(W.orderBy("first", "shape")) - 1
    return kinds.select("shape", F.concat(F.lit("GT_"), F.lpad(number.cast("string"), 6, "0")).alias("type"), "support")


def gains(found: DataFrame, types: DataFrame, graph_nodes: int, relations: int, code_bits: dict[str, int]) -> DataFrame:
    """Occurrences with raw and encoded bits, gain and density; every logarithm is at least 1."""
    log = lambda x: F.greatest(F.log2(x), F.lit(1.0))
    spark = found.sparkSession
    codes = spark.createDataFrame(sorted(code_bits.items()) or [("", 0)], "type string, bits long")
    per_edge = log(F.lit(relations + 1.0))
    rows = found.dropDuplicates(["shape", "nodes"]).join(types, "shape").join(F.broadcast(codes), "type")
    prototype = F.col("e") * (2 * log(F.col("n").cast("double")) + per_edge) + F.col("n")
    raw = F.col("e") * (2 * log(F.lit(float(graph_nodes))) + per_edge)
    encoded = F.col("n") * log(F.lit(float(graph_nodes))) + F.col("bits") + F.greatest(F.lit(0.0), prototype / F.col("support"))
    priced = rows.withColumn("raw_bits", raw).withColumn("encoded_bits", encoded).withColumn("gain", F.col("raw_bits") - F.col("encoded_bits"))
    return priced.withColumn("density", F.col("gain") / F.greatest(F.col("n") - 1, F.lit(1)))


def select_disjoint(found: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Greedy set packing of occurrences (center, density, gain, type, nodes) without shared nodes.

    The order is falling (density, gain, type, -center). Each round takes the occurrences
    that come first at all of their nodes, which gives the sequential result.
    """
    rank = F.struct("density", "gain", "type", (-F.col("center")).alias("late"))
    left = materialize(found, "open")
    taken = left.limit(0)
    for _ in range(max_rounds):
        at = left.select("center", rank.alias("rank"), F.explode("nodes").alias("node"))
        best = at.groupBy("node").agg(F.max("rank").alias("best"))
        wins = at.join(best, "node").groupBy("center").agg(F.bool_and(F.col("rank") == F.col("best")).alias("first")).filter("first").select("center")
        now = materialize(left.join(wins, "center", "left_semi"), "taken")
        if not now.limit(1).count():
            return taken
        taken = taken.union(now)
        used = now.select(F.explode("nodes").alias("node"))
        blocked = left.select("center", F.explode("nodes").alias("node")).join(used, "node", "left_semi").select("center").distinct()
        left = materialize(left.join(blocked, "center", "left_anti"), "open")
    raise RuntimeError(f"the selection did not settle in {max_rounds} rounds")


def contract(edges: DataFrame, symbols: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, symbols, owner) after every chosen occurrence becomes its smallest node.

    Weights are summed per relation and direction, and inner edges become loops. The new
    node has the occurrence's type; nodes outside keep their symbols.
    """
    owner = materialize(chosen.select(F.explode("nodes").alias("node"), F.array_min("nodes").alias("owner"), "type"), "owner")
    a = owner.select(F.col("node").alias("src"), F.col("owner").alias("a"))
    b = owner.select(F.col("node").alias("dst"), F.col("owner").alias("b"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    quotient = joined.groupBy(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "relation").agg(F.sum("weight").alias("weight"))
    kept = symbols.join(owner.select("node"), "node", "left_anti")
    new = owner.filter("node = owner").select("node", F.col("type").alias("symbol"))
    return materialize(quotient, "quotient"), materialize(kept.unionByName(new), "symbols"), owner.select("node", "owner")


LEVEL = "level long, nodes long, edges long, types long, chosen long, raw_bits double, encoded_bits double, nodes_after long, stop string"


def mine(edges: DataFrame, max_levels: int = 3, cap: int = 8, least_support: int = 2, least_nodes: int = 3, max_types: int = 4096, min_gain: float = 0.0, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels, members): recursive mining until a stop reason holds.

    ``levels`` has a row for each level with its stop reason or null; ``members`` maps
    every first node to its last owner. With ``store`` every level is kept in that folder,
    and a run that finds complete levels of the same edges and settings goes on after
    the last one; levels of other edges or settings raise.
    """
    spark = edges.sparkSession
    edges = materialize(edges.groupBy("src", "dst", "relation").agg(F.sum("weight").alias("weight")), "edges")
    relations = edges.select("relation").distinct().count()
    about, start, rows = {}, 0, []
    if store:
        about = {"input": list(checksum(edges.withColumn("weight", F.round("weight", 6)))), "settings": [cap, least_support, least_nodes, max_types, min_gain]}
        newest = newest_level(spark, store, about)
    if store and newest is not None:
        drop_levels(spark, store, newest + 1)
        kept, found_about = load(spark, f"{store}/level={newest}")
        edges, symbols, members = kept["edges"], kept["symbols"], kept["members"]
        rows = [tuple(r) for r in found_about["rows"]]
        start, n = newest + 1, rows[-1][7]
        if rows[-1][8] and (rows[-1][8] != "max_levels" or start >= max_levels):
            return spark.createDataFrame(rows, LEVEL), members
        rows[-1] = (*rows[-1][:8], None)
    else:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        members = materialize(nodes.select("node", F.col("node").alias("owner")), "members")
        symbols = spark.createDataFrame([], "node long, symbol string")
        n = members.count()
    for level in range(start, max_levels):
        m = edges.count()
        if n < least_nodes:
            rows.append((level, n, m, 0, 0, 0.0, 0.0, n, "min_graph_nodes"))
            break
        found = materialize(candidates(edges, symbols, cap), "candidates")
        types = registry(found, least_support)
        types = materialize(types.withColumn("type", F.concat(F.lit(f"L{level}_"), "type")), "types")
        count = types.count()
        if not count or count > max_types:
            rows.append((level, n, m, count, 0, 0.0, 0.0, n, "max_dictionary_size" if count else "no_candidates"))
            break
        bits = huffman_lengths({r["type"]: r["support"] for r in types.select("type", "support").collect()})
        good = gains(found, types, n, relations, bits).filter(F.col("gain") > min_gain)
        chosen = materialize(select_disjoint(good.select("center", "density", "gain", "type", "nodes", "raw_bits", "encoded_bits")), "chosen")
        total = chosen.agg(F.count("*").alias("k"), F.sum("raw_bits").alias("raw"), F.sum("encoded_bits").alias("coded")).first()
        if not total["k"]:
            rows.append((level, n, m, count, 0, 0.0, 0.0, n, "no_positive_mdl"))
            break
        edges, symbols, owner = contract(edges, symbols, chosen)
        step = owner.select(F.col("node").alias("owner"), F.col("owner").alias("next"))
        members = materialize(members.join(step, "owner", "left").select("node", F.coalesce("next", "owner").alias("owner")), "members")
        after = members.select("owner").distinct().count()
        rows.append((level, n, m, count, total["k"], round(total["raw"], 6), round(total["coded"], 6), after, "no_reduction" if after == n else "max_levels" if level + 1 == max_levels else None))
        if store:
            save_level({"edges": edges, "symbols": symbols, "members": members, "types": types, "chosen": chosen}, store, level, about | {"rows": rows})
        if after == n:
            break
        n = after
    return spark.createDataFrame(rows, LEVEL), members
