"""Queries of the stores, codecs, type families, dynamics reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding, components, families, indexing, iterative, motifs, samplers, spectral, text, triangles, vectors
from ..operators.relational import OPERATORS
from ..session import materialize, scratch_dir
from ..sources import assertions, store
from ..streaming import incremental
from . import catalog
from .dialect import run_sql


def _of(s: SparkSession, d: str, name: str) -> DataFrame:
    return catalog.inputs(s, d, "{" + name + "}")[name]


def _folder(s: SparkSession, name: str) -> str:
    return f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex}"


def _typed(s: SparkSession, d: str) -> DataFrame:
    return _of(s, d, "directed").select("src", "dst", "relation", F.col("weight").cast("double").alias("weight"))


def _quotient(s: SparkSession, d: str) -> DataFrame:
    sql = OPERATORS["j5_quotient"]
    return materialize(run_sql(s, sql, **catalog.inputs(s, d, sql)), "quotient")


def _strong(s: SparkSession, d: str) -> DataFrame:
    """The strong edges as a typed graph: its egos are small, so shapes recur."""
    return _of(s, d, "sparse").select("src", "dst", "relation", F.col("weight").cast("double").alias("weight"))


def _egos(s: SparkSession, d: str) -> DataFrame:
    return materialize(motifs.ego_graphs(_strong(s, d), s.createDataFrame([], "node long, symbol string"), 8), "egos")


def _relations(s: SparkSession, d: str) -> list[str]:
    return sorted(r["relation"] for r in _strong(s, d).select("relation").distinct().collect())


# stores and scans


def level_edges(s: SparkSession, d: str) -> DataFrame:
    return store.edge_records(_typed(s, d))


def stored_graph(s: SparkSession, d: str) -> DataFrame:
    """Save, load with verification, and count what came back."""
    path = _folder(s, "graph")
    store.save({"edges": _typed(s, d)}, path, {"kind": "directed"})
    tables, about = store.load(s, path)
    return tables["edges"].groupBy(F.lit(about["kind"]).alias("kind")).agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 2).alias("weight"))


def row_limit(s: SparkSession, d: str) -> DataFrame:
    """Rejects among the first 1000 physical lines of a text file."""
    path = _folder(s, "lines")
    lines = _of(s, d, "assertions").select(F.col("line").cast("string").alias("value"))
    lines.coalesce(1).write.text(path)
    return assertions.read_lines(s, path, max_rows=1000).agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def word_scan(s: SparkSession, d: str) -> DataFrame:
    v = _of(s, d, "vectors")
    lines = v.select(F.col("id").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("label").cast("string")), F.array_join(F.transform("v", lambda x: x.cast("string")), " ")).alias("value"))
    words = v.select(F.concat(F.lit("w"), F.col("label").cast("string")).alias("word")).filter("word <> 'w0'").distinct()
    width = v.select(F.size("v")).first()
    return store.word_vectors(lines, words, width[0] if width else 0).select("word", F.round(F.element_at("v", 1), 4).alias("x1"))


def flattened(s: SparkSession, d: str) -> DataFrame:
    rows = assertions.parse(catalog.assertion_lines(s, d)).filter("reason is null")
    return rows.groupBy(F.coalesce(F.array_join("sources", ","), F.lit("none")).alias("sources")).agg(F.count("*").alias("n"))


def filter_bundle(s: SparkSession, d: str) -> DataFrame:
    return assertions.report(catalog.assertion_lines(s, d), language="en", relations={"/r/AF", "RO"}, min_weight=5.0, datasets={"O", "F"}, sources={"/s/b", "/s/c"})


def guard(s: SparkSession, d: str) -> DataFrame:
    """Whether the automatic coupling is allowed: one component and no isolated node."""
    labels = components.components(_of(s, d, "fragments"))
    return labels.agg(F.count_distinct("root").alias("components")).withColumn("allowed", F.col("components") == 1)


# growth, pools and matching


def _degrees(s: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    e = materialize(_of(s, d, name).select("src", "dst").distinct(), "pairs")
    both = e.union(e.select("dst", "src"))
    return both.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("degree")), e


def pool(s: SparkSession, d: str) -> DataFrame:
    return iterative.degree_pool(*_degrees(s, d, "fragments"), 60)[0]


def growth(s: SparkSession, d: str) -> DataFrame:
    return iterative.best_first_growth(*_degrees(s, d, "directed"), 40, 100.0)


def free_matching(s: SparkSession, d: str) -> DataFrame:
    return iterative.greedy_matching(materialize(families.candidate_pairs(_of(s, d, "vectors")), "pairs"))


# spectra and dynamics


def basis_angles(s: SparkSession, d: str) -> DataFrame:
    """Principal angles between the slow bases of the graph with and without its weights."""
    q = _quotient(s, d)
    a, b = spectral.slow_coordinates(q, 3), spectral.slow_coordinates(q.withColumn("weight", F.log1p("weight")), 3)
    found, distance = spectral.angles(a, b)
    return s.createDataFrame([(i, round(float(x), 4), round(distance, 6)) for i, x in enumerate(found)], "k int, degrees double, distance double")


def laws(s: SparkSession, d: str) -> DataFrame:
    q = _quotient(s, d)
    nodes = q.select(F.col("src").alias("node")).union(q.select("dst")).distinct()
    return spectral.compare_laws(q, iterative.hierarchy(nodes, q, 0.4, 3), [60, 30])


# types and families


def metric_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Nearest type representatives by each of the feature metrics."""
    egos, relations = _egos(s, d), _relations(s, d)
    first = motifs.shaped(egos).groupBy("shape").agg(F.min("center").alias("center"))
    some = materialize(egos.join(first, "center", "left_semi"), "some")
    parts = [families.nearest_egos(some, relations, m, 3).select(F.lit(m).alias("metric"), "id", "rank", "nbr", "distance") for m in ("typed_wl", "graphlet", "relation_js")]
    return parts[0].union(parts[1]).union(parts[2])


def _types(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    egos = _egos(s, d)
    return egos, materialize(motifs.registry(motifs.shaped(egos), 1), "types")


def type_clusters(s: SparkSession, d: str) -> DataFrame:
    egos, types = _types(s, d)
    return families.type_clusters(egos, types, _relations(s, d))


def type_families(s: SparkSession, d: str) -> DataFrame:
    """Clusters of two densities resolved into lasting families, one level after the other."""
    egos, types = _types(s, d)
    known: dict[str, set[str]] = {}
    rows = []
    for level, k in enumerate((4, 6)):
        found = families.type_clusters(egos, types, _relations(s, d), k=k).filter("label >= 0").groupBy("label").agg(F.sort_array(F.collect_list("type")).alias("types")).orderBy("label").collect()
        names = families.resolve_families(known, [set(r["types"]) for r in found])
        rows += [(level, n, len(r["types"])) for n, r in zip(names, found, strict=True)]
    return s.createDataFrame(rows, "level int, family string, types int")


def selection(s: SparkSession, d: str) -> DataFrame:
    """Disjoint occurrences by description length, over all candidates."""
    egos = _egos(s, d)
    found = materialize(motifs.shaped(egos), "shaped")
    types = materialize(motifs.registry(found), "types")
    bits = coding.huffman_lengths({r["type"]: r["support"] for r in types.collect()})
    n = _strong(s, d).select("src").union(_strong(s, d).select("dst")).distinct().count()
    good = motifs.gains(found, types, n, len(_relations(s, d)), bits).filter("gain > 0")
    return motifs.select_disjoint(good.select("center", "density", "gain", "type", "nodes")).select("center", "type", F.round("gain", 6).alias("gain"))


def mined_in_two_runs(s: SparkSession, d: str) -> DataFrame:
    """Mining stopped after one level and taken up again from its store."""
    path = _folder(s, "mining")
    motifs.mine(_strong(s, d), max_levels=1, cap=6, store=path)
    return motifs.mine(_strong(s, d), max_levels=2, cap=6, store=path)[0]


def vector_families(s: SparkSession, d: str) -> DataFrame:
    v = _of(s, d, "vectors")
    return families.vector_families(v, v.filter("label <> 0"))


def connectors(s: SparkSession, d: str) -> DataFrame:
    labels = _of(s, d, "mapping").select(F.col("fine").alias("node"), F.col("coarse").alias("label"))
    return families.connectors(_typed(s, d), labels).select("label", *[F.round(c, 6).alias(c) for c in ("internal", "outgoing", "incoming")], "by_relation", F.round("exit", 6).alias("exit"))


def family_match(s: SparkSession, d: str) -> DataFrame:
    """The plan of the same name, with sets compared block by block in place of a join on their tokens."""
    rows = _of(s, d, "records").selectExpr("src as s", "relation as x", "dst % 20 as y").distinct()
    found = families.best_set_match(rows, "s % 10 = 0", "s % 10 <> 0")
    alike = F.round(F.col("both_n") / (F.col("left_n") + F.col("right_n") - F.col("both_n")), 6)
    return found.select("left_id", "right_id", alike.alias("jaccard")).filter("jaccard >= 0.1")


def clustering(s: SparkSession, d: str) -> DataFrame:
    """The plan of the same name, with triangles by blocks of edges in place of a join of wedges."""
    found = triangles.node_triangles(materialize(_of(s, d, "copurchase"), "copurchase"))
    share = F.expr("case when degree < 2 then 0D else 2D * triangles / (degree * (degree - 1)) end")
    return found.select("node", F.round(share, 6).alias("coefficient"))


def graphlets(s: SparkSession, d: str) -> DataFrame:
    """The plan of the same name: edges that meet in their smaller end, and how many of these are closed."""
    found = triangles.node_triangles(materialize(_of(s, d, "copurchase"), "copurchase"))
    total = found.selectExpr("sum(later * (later - 1)) div 2 as pairs", "sum(triangles) div 3 as closed")
    return total.selectExpr("stack(2, 'path', pairs - closed, 'triangle', closed) as (shape, n)").filter("n > 0")


# codecs


def relation_codes(s: SparkSession, d: str) -> DataFrame:
    return coding.code_table(_of(s, d, "records").groupBy("relation").agg(F.count("*").alias("n")), "relation")


def symbol_round_trip(s: SparkSession, d: str) -> DataFrame:
    rows = _of(s, d, "records").select("relation")
    codes = {r["relation"]: r["code"] for r in relation_codes(s, d).collect()}
    packed = materialize(coding.pack_symbols(rows, "relation", codes), "packed")
    back = coding.unpack_symbols(packed, "relation", codes)
    both = rows.groupBy("relation").agg(F.count("*").alias("a")).join(back.groupBy("relation").agg(F.count("*").alias("b")), "relation", "full")
    return both.agg(F.sum("b").alias("symbols"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)).alias("differing"))


def archive_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(s, 'archive')}.zip"
    rows = materialize(_of(s, d, "records").select("edge_id", "src", "dst", "relation", F.col("weight").cast("double").alias("weight")), "records")
    coding.write_archive(materialize(coding.encode_records(rows), "blocks"), path, {"records": rows.count()})
    blocks, manifest = coding.read_archive(s, path)
    back = materialize(coding.decode_records(blocks), "decoded")
    lost = rows.exceptAll(back).count() + back.exceptAll(rows).count()
    return s.createDataFrame([(manifest["records"], lost)], "records long, differing long")


# text


def descriptor(s: SparkSession, d: str) -> DataFrame:
    found = text.graphon_descriptor(_of(s, d, "both"))
    return s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(found)], "i int, x double")


def concept_search(s: SparkSession, d: str) -> DataFrame:
    index = text.ConceptIndex().fit(_of(s, d, "corpus"))
    return index.search(index.weights.agg(F.min("a")).first()[0] or "", 5)


# streams


def stream_report(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "lines")
    catalog.assertion_lines(s, d).select("value").repartition(4).write.text(path)
    stream = s.readStream.option("maxFilesPerTrigger", 2).text(path)
    return incremental.run_to_end(incremental.running_report(stream, language="en", relations={"AF", "RO"}, min_weight=10.0, datasets={"O"}))


def stream_upsert(s: SparkSession, d: str) -> DataFrame:
    path, out = _folder(s, "events"), _folder(s, "counts")
    s.read.parquet(f"{d}/events.parquet").select("event_type").repartition(4).write.parquet(path)
    incremental.upsert_counts(incremental.stream_table(s, path, 1), "event_type", out)
    return incremental.read_counts(s, out, "event_type")


FRAGMENT_POOL = """with recursive f as (select * from {fragments}), b as (select src, dst from f union all select dst, src from f), g as (select src as node, count(*) as degree from b group by src), p as (select * from g order by degree desc, node limit 60), e as (select distinct b.src, b.dst from b join p x on b.src = x.node join p y on b.dst = y.node), c as (select node, node as root from p union select e.dst, c.root from c join e on e.src = c.node), l as (select c.node, min(root) as root from c group by c.node), m as (select l.node, l.root, p.degree from l join p on l.node = p.node), q as (select root from m group by root order by count(*) desc, max(degree) desc, arg_min(node, -degree * 1e9 + node) limit 1) select node, degree from m where root in (select root from q)"""
COMPONENTS = """with recursive f as (select * from {fragments}), e as (select src, dst from f union select dst, src from f), c as (select src as node, src as root from e union select e.dst, c.root from c join e on e.src = c.node), l as (select node, min(root) as root from c group by node) select count(distinct root) as components, count(distinct root) = 1 as allowed from l"""
CONNECTORS = """with r as (select a.coarse as a, b.coarse as b, e.relation, sum(e.weight) as w from {directed} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine group by 1, 2, 3), s as (select a as label, relation, case when a = b then w else 0 end as i, case when a <> b then w else 0 end as o, 0 as n from r union all select b, relation, 0, 0, w from r where a <> b), t as (select label, relation, sum(i) as i, sum(o) as o, sum(n) as n from s group by 1, 2) select label, round(sum(i), 6) as internal, round(sum(o), 6) as outgoing, round(sum(n), 6) as incoming, coalesce(string_agg(case when o > 0 then relation || '=' || cast(cast(o as decimal(30, 4)) as varchar) end, ',' order by relation), '') as by_relation, round(sum(o) / nullif(sum(i) + sum(o), 0), 6) as exit from t group by label"""
RULES = "case when line = 5 then 'invalid' when line in (6, 7) then 'invalid_weight'"
REPORT = "select reason, count(*) as n from (select " + RULES + " when relation not in ('AF', 'RO') then 'relation' when weight < 10 then 'min_weight' when dataset <> 'O' then 'dataset' else 'accepted' end as reason from {assertions}) t group by reason"
BUNDLE = "select reason, count(*) as n from (select " + RULES + " when relation not in ('AF', 'RO') then 'relation' when weight < 5 then 'min_weight' when line in (1, 3) then 'source' else 'accepted' end as reason from {assertions}) t group by reason"
SOURCES = "select case line when 1 then '/s/a' when 2 then '/s/b' when 3 then 'none' else '/s/a,/s/c' end as sources, count(*) as n from {assertions} where line not in (5, 6, 7) group by 1"
WORDS = "select 'w' || label as word, round(arg_min(v[1]::double / sqrt(list_inner_product(v::double[], v::double[])), id), 4) as x1 from {vectors} where label <> 0 group by label"

J1_DENSE_INDEX = "with n as (select uri, row_number() over (order by uri) - 1 as id from (select start_uri as uri from {assertions} union select end_uri from {assertions}) t) select a.id as src, b.id as dst, round(sum(weight), 6) as weight from {assertions} e join n a on e.start_uri = a.uri join n b on e.end_uri = b.uri group by a.id, b.id"
T2_CANDIDATE_SORT = "select row_number() over (order by w, src, dst) as place, src, dst, round(w, 6) as distance from (select src, dst, 1 / sum(weight) as w from {sparse} group by src, dst) t"
G27_PARTITION_FINALISATION = "select fine, dense_rank() over (order by least_fine) - 1 as cluster from (select fine, min(fine) over (partition by coarse) as least_fine from {mapping}) t"
L4_GRAPHON_GRID = "with d as (select src as id, row_number() over (order by count(*) desc, src) - 1 as r, count(*) over () as n from {both} group by src) select floor(a.r * 16.0 / a.n) as gx, floor(b.r * 16.0 / b.n) as gy, round(sum(e.weight), 6) as w from {both} e join d a on a.id = e.src join d b on b.id = e.dst group by floor(a.r * 16.0 / a.n), floor(b.r * 16.0 / b.n)"

#: name: (query, SQL or None)
FOUND = {
    "j1_dense_index": (lambda s, d: indexing.indexed_edges(_of(s, d, "assertions")), J1_DENSE_INDEX),
    "t2_candidate_sort": (lambda s, d: indexing.sorted_candidates(_of(s, d, "sparse")), T2_CANDIDATE_SORT),
    "g27_partition_finalisation": (lambda s, d: indexing.finalised(_of(s, d, "mapping")), G27_PARTITION_FINALISATION),
    "l4_graphon_grid": (lambda s, d: indexing.graphon_grid(_of(s, d, "both")), L4_GRAPHON_GRID),
    "sc7_edge_records": (level_edges, "select row_number() over (order by relation, src, dst) - 1 as edge_id, relation, src, dst, weight from {directed}"),
    "sc6_sk1_stored_graph": (stored_graph, "select 'directed' as kind, count(*) as edges, round(sum(weight), 2) as weight from {directed}"),
    "sc1_sc3_row_limit": (row_limit, "select least(count(*), 1000) as n, 0 as first, least(count(*), 1000) - 1 as last from {assertions}"),
    "sc9_word_vectors": (word_scan, WORDS),
    "pf3_pf4_source_flattening": (flattened, SOURCES),
    "pf6_pf7_pf19_filter_bundle": (filter_bundle, BUNDLE),
    "pf18_connectivity_guard": (guard, COMPONENTS),
    "g5_pool_component": (pool, FRAGMENT_POOL),
    "g4_best_first_growth": (growth, None),
    "j4_g25_free_matching": (free_matching, None),
    "g18_g31_basis_angles": (basis_angles, None),
    "g19_g23_perturbations": (lambda s, d: spectral.perturbation_report(_quotient(s, d)), None),
    "g40_dynamics_comparison": (laws, None),
    "g45_g46_snapshot": (lambda s, d: samplers.snapshot(_of(s, d, "sparse").withColumn("weight", F.col("weight").cast("double"))), None),
    "m7_metric_neighbours": (metric_neighbours, None),
    "m11_signatures": (lambda s, d: families.signatures(_egos(s, d)), None),
    "m12_m26_isomorphisms": (lambda s, d: families.isomorphisms(_egos(s, d)), None),
    "m16_type_clusters": (type_clusters, None),
    "m17_type_families": (type_families, None),
    "m20_disjoint_selection": (selection, None),
    "sc11_sk11_st4_resumed_mining": (mined_in_two_runs, None),
    "m34_vector_families": (vector_families, None),
    "a14_connectors": (connectors, CONNECTORS),
    "a16_m38_code_table": (relation_codes, None),
    "m36_symbol_round_trip": (symbol_round_trip, "select count(*) as symbols, 0 as differing from {records}"),
    "m27_m29_archive_round_trip": (archive_round_trip, "select count(*) as records, 0 as differing from {records}"),
    "l5_graphon_descriptor": (descriptor, None),
    "l2_l8_concept_search": (concept_search, None),
    "st1_st2_stream_report": (stream_report, REPORT),
    "st3_st5_stream_upsert": (stream_upsert, "select event_type, count(*) as n from events group by event_type"),
}


#: Plans of ``OPERATORS`` whose joins grow with the square of a group; their SQL stays the oracle.
catalog.QUERIES |= {"g11_clustering_coefficient": clustering, "j16_family_match": family_match, "m2_graphlets": graphlets}


for _name, (_query, _sql) in FOUND.items():
    catalog.QUERIES[_name] = _query
    if _sql:
        catalog.ORACLES[_name] = catalog.oracle(_sql)
