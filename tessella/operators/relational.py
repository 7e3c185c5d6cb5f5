"""Relational operators of the graph engine, one declarative plan each.

``OPERATORS[name]`` is SQL over named inputs; ``apply(name, edges=df, ...)`` gives the
DataFrame. Sums and products are rounded to 6 digits where they are reported, so results
do not depend on the order of summation. Rankings end with an id and are total.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..plans.dialect import run_sql

OPERATORS: dict[str, str] = {
    # projections and filters
    "pf1_relation_name": "select relation_uri, split_part(relation_uri, '/', 3) as relation, count(*) as n from (select '/r/' || relation as relation_uri from {assertions}) t group by relation_uri",
    "pf2_uri_language": "select lang, count(*) as n from (select case when split_part(path, '/', 2) in ('en', 'fr', 'de', 'es') then split_part(path, '/', 2) else 'none' end as lang from (select '/' || split_part(url, '/', 4) as path from {pages}) t) s group by lang",
    "pf5_reject_cascade": "select reason, count(*) as n from (select case when split_part(start_uri, '/', 3) <> 'en' then 'language' when relation not in ('AF', 'RO', 'NO') then 'relation' when weight < 10 then 'min_weight' when dataset <> 'O' then 'dataset' else 'accepted' end as reason from {assertions}) t group by reason",
    "pf8_pf9_weight_transforms": "select relation, count(*) as n, round(sum(1.0), 6) as binary_w, round(sum(weight), 6) as raw_w, round(sum(ln(1 + weight)), 6) as log1p_w from {assertions} where start_uri <> end_uri group by relation",
    "pf10_extractor_eligibility": "select relation, count(*) as n from {assertions} where start_uri like '/c/en/%' and end_uri like '/c/en/%' and start_uri <> end_uri and relation in ('AF', 'RF', 'NO') and weight >= 1 group by relation",
    "pf11_binary_topology": "select src, count(*) as degree from (select distinct src, dst from {both} where weight <> 0 and src <> dst) t group by src",
    "pf13_text_normalise": "select doc_id, length(text) as before, length(regexp_replace(lower(text), 'https?://[^ ]+', '')) as after_chars from {corpus}",
    "pf14_support_filter": "select relation, src % 100 as shape, count(*) as support from {directed} group by relation, src % 100 having count(*) >= 20",
    "pf16_plateau_gate": "select level, {reasons} as reasons from {transitions}",
    "pf17_sweep_gate": "select level from {transitions} where reduction >= 0.10 and r_fine = r_coarse and subspace <= 0.25 and trajectory <= 0.25 and eigenvalue <= 0.05",
    # joins
    "j2_induced_subgraph": "select src, dst, relation, weight from {directed} where src in (select fine from {mapping} where coarse % 2 = 0) and dst in (select fine from {mapping} where coarse % 2 = 0)",
    "j3_edge_embedding_distance": "select e.src, e.dst, round(sqrt(greatest(@dot(a.v; a.v) + @dot(b.v; b.v) - 2 * @dot(a.v; b.v), 0)), 6) as distance from {sparse_pairs} e join {vectors} a on a.id = e.src % 499 join {vectors} b on b.id = e.dst % 499",
    "j5_quotient": "select a.coarse as src, b.coarse as dst, round(sum(e.weight), 6) as weight from {both} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine group by a.coarse, b.coarse",
    "j6_operator_scaling": "with d as (select src as id, sum(weight) as degree from {both} group by src) select e.src, e.dst, round(e.weight / sqrt(a.degree * b.degree), 9) as s from {both} e join d a on e.src = a.id join d b on e.dst = b.id",
    "j7_spmv": "select e.src as id, round(sum(e.weight * s.x), 6) as y from {both} e join {state} s on e.dst = s.id group by e.src",
    "j8_restrict_lift": "with m as (select coarse, avg(x) as mean_x from {state} s join {mapping} p on s.id = p.fine group by coarse) select s.id, p.coarse, round(m.mean_x, 6) as lifted, round(s.x - m.mean_x, 6) as residual from {state} s join {mapping} p on s.id = p.fine join m on m.coarse = p.coarse",
    "j11_cross_level_nesting": "select m.coarse, count(*) as members, count(distinct p.p_brand) as owners, count(distinct p.p_brand) = 1 as nested from {mapping} m join {part} p on m.fine = p.p_partkey group by m.coarse",
    "j12_missing_selected": "select c_custkey as id from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey)",
    "j13_figure_owner": "select r.edge_id, a.figure as src_figure, b.figure as dst_figure, case when a.figure = b.figure then 'inside' when a.figure is not null and b.figure is not null then 'between' when a.figure is null and b.figure is null then 'outside' else 'boundary' end as place from {records} r left join {figures} a on r.src = a.node left join {figures} b on r.dst = b.node",
    "j14_label_profiles": "select a.coarse as label, round(sum(case when a.coarse = b.coarse then e.weight else 0 end), 6) as internal, round(sum(case when a.coarse <> b.coarse then e.weight else 0 end), 6) as outside, count(distinct b.coarse) as partners from {both} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine group by a.coarse",
    "j16_family_match": "with w as (select distinct src as s, relation as x, dst % 20 as y from {records}), z as (select s, count(*) as n from w group by s), p as (select a.s as left_id, b.s as right_id, count(*) as both_n from w a join w b on a.x = b.x and a.y = b.y and a.s % 10 = 0 and b.s % 10 <> 0 group by a.s, b.s) select left_id, right_id, jaccard from (select left_id, right_id, round(both_n * 1.0 / (l.n + r.n - both_n), 6) as jaccard, row_number() over (partition by left_id order by round(both_n * 1.0 / (l.n + r.n - both_n), 9) desc, right_id) as k from p join z l on l.s = left_id join z r on r.s = right_id) q where k = 1 and jaccard >= 0.1",
    "j17_lineage_chain": "with c as (select c_nationkey % 9 as k2, c_nationkey as k3, c_mktsegment as k4, count(*) as n from {customer} group by c_nationkey % 9, c_nationkey, c_mktsegment), b as (select k2, k3, sum(n) as n, row_number() over (partition by k2 order by sum(n) desc, k3) as r from c group by k2, k3), d as (select k3, k4, row_number() over (partition by k3 order by sum(n) desc, k4) as r from c group by k3, k4) select b.k2, b.k3, d.k4, cast(b.n as bigint) as n from b join d on b.k3 = d.k3 where b.r = 1 and d.r = 1",
    # aggregations
    "a1_parallel_edges": "select src, dst, round(sum(w), 6) as weight from (select start_uri as src, end_uri as dst, ln(1 + weight) as w from {assertions} union all select end_uri, start_uri, ln(1 + weight) from {assertions} where start_uri <> end_uri) t group by src, dst",
    "a2_provenance": "select start_uri, end_uri, relation, dataset, count(*) as n, round(sum(ln(1 + weight)), 6) as contribution from {assertions} where weight >= 40 group by start_uri, end_uri, relation, dataset",
    "a3_relation_histogram": "select relation, count(*) as n from {assertions} where weight >= 25 group by relation",
    "a4_graph_report": "select count(distinct src) as nodes, sum(case when src < dst then 1 else 0 end) + sum(case when src = dst then 1 else 0 end) as edges, count(*) as nnz, sum(case when src = dst then 1 else 0 end) as loops from {both}",
    "a5_strength": "select src as id, round(sum(weight), 6) as strength, count(*) as degree from {both} group by src",
    "a6_log_degree": "select uri, round(sum(w), 6) as degree from (select start_uri as uri, ln(1 + weight) as w from {assertions} union all select end_uri, ln(1 + weight) from {assertions}) t group by uri",
    "a7_degree_moments": "select round(avg(k), 6) as k1, round(avg(k * k), 6) as k2, round(avg(k) / nullif(avg(k * k), 0), 9) as spreading, round(case when avg(k * k) > avg(k) then avg(k) / (avg(k * k) - avg(k)) end, 9) as percolation from (select src, count(*) * 1.0 as k from {both} where src <> dst group by src) t",
    "a8_stationary_mass": "select id, round(s / (select sum(weight) from {both}), 9) as mass from (select src as id, sum(weight) as s from {both} group by src) t",
    "a9_supernode_sizes": "select coarse, count(*) as size, round(count(*) * 1.0 / sum(count(*)) over (), 9) as mass from {mapping} group by coarse",
    "a10_mean_density": "with z as (select coarse, count(*) as n from {mapping} group by coarse) select a.coarse as src, b.coarse as dst, round(sum(e.weight) / (min(x.n) * min(y.n)), 9) as density from {both} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine join z x on x.coarse = a.coarse join z y on y.coarse = b.coarse group by a.coarse, b.coarse",
    "a11_cluster_transitions": "select a, b, relation, round(w, 6) as flow, round(w / sum(w) over (partition by a), 9) as exit_probability from (select m.coarse as a, n.coarse as b, e.relation, sum(e.weight) as w from {directed} e join {mapping} m on e.src = m.fine join {mapping} n on e.dst = n.fine where m.coarse <> n.coarse group by m.coarse, n.coarse, e.relation) t",
    "a12_relation_features": "select src as center, relation, round(sum(abs(weight)) / sum(sum(abs(weight))) over (partition by src), 9) as share from {directed} group by src, relation",
    "a13_block_model": "with l as (select coarse, count(*) as n, row_number() over (order by count(*) desc, coarse) as r from {mapping} group by coarse) select a, b, relation, n, intensity from (select x.coarse as a, y.coarse as b, e.relation, count(*) as n, round(count(*) * 1.0 / (min(x.n) * min(y.n)), 9) as intensity, row_number() over (order by count(*) desc, x.coarse, y.coarse, e.relation) as k from {directed} e join {mapping} m on e.src = m.fine join {mapping} o on e.dst = o.fine join l x on x.coarse = m.coarse and x.r <= 40 join l y on y.coarse = o.coarse and y.r <= 40 group by x.coarse, y.coarse, e.relation) t where k <= 100",
    "a15_type_entropy": "select round(-sum(p * log2(p)), 6) as bits, count(*) as kinds from (select count(*) * 1.0 / sum(count(*)) over () as p from {directed} group by relation, src % 50) t",
    "a18_dictionary_novelty": "with f as (select src % 200 as kind, min(cast(round(weight) as bigint) % 5) as first_level from {sparse} group by src % 200) select level, count(*) as observed, sum(case when first_level = level then 1 else 0 end) as new_kinds, sum(case when first_level < level then 1 else 0 end) as reused from (select distinct src % 200 as kind, cast(round(weight) as bigint) % 5 as level from {sparse}) o join f on f.kind = o.kind group by level",
    "a19_distance_summary": "select round(avg(weight), 6) as mean_w, round(@pct(weight; 0.5), 6) as median_w, round(@pct(weight; 0.95), 6) as p95 from {records}",
    "a20_a21_sweep_rollup": "select src % 7 as k, count(*) as runs, round(@pct(weight; 0.5), 6) as median_w, round(@pct(weight; 0.1), 6) as p10, round(avg(case when relation = 'view' then 1.0 else 0.0 end), 6) as noise from {records} group by src % 7",
    "a22_adjusted_rand": "with c as (select l_returnflag as a, l_linestatus as b, count(*) * 1.0 as n from {lineitem} group by l_returnflag, l_linestatus), t as (select sum(n) as n, sum(n * (n - 1) / 2) as s from c), ra as (select sum(x * (x - 1) / 2) as s from (select sum(n) as x from c group by a) q), rb as (select sum(x * (x - 1) / 2) as s from (select sum(n) as x from c group by b) q) select round((t.s - ra.s * rb.s / (t.n * (t.n - 1) / 2)) / ((ra.s + rb.s) / 2 - ra.s * rb.s / (t.n * (t.n - 1) / 2)), 9) as ari from t cross join ra cross join rb",
    "a22_mutual_information": "with c as (select l_returnflag as a, l_linestatus as b, count(*) * 1.0 / sum(count(*)) over () as p from {lineitem} group by l_returnflag, l_linestatus), x as (select a, sum(p) as p from c group by a), y as (select b, sum(p) as p from c group by b) select round(2 * sum(c.p * ln(c.p / (x.p * y.p))) / ((select -sum(p * ln(p)) from x) + (select -sum(p * ln(p)) from y)), 9) as nmi from c join x on x.a = c.a join y on y.b = c.b",
    "a23_contingency_persistence": "with c as (select c_nationkey as s, c_mktsegment as t, count(*) as n from {customer} group by c_nationkey, c_mktsegment), a as (select s, sum(n) as n from c group by s), b as (select t, sum(n) as n from c group by t), j as (select c.s, c.t, c.n, c.n * 1.0 / (a.n + b.n - c.n) as jac, c.n * 1.0 / a.n as p from c join a on a.s = c.s join b on b.t = c.t) select s, t as best, round(jac, 6) as jaccard, round(p, 6) as retention, round(h, 6) as split_entropy from (select s, t, jac, p, -sum(p * ln(p)) over (partition by s) / ln(count(*) over (partition by s)) as h, row_number() over (partition by s order by jac desc, n desc, t) as r from j) q where r = 1",
    "a24_cluster_geometry": "select label, max(c) as n, round(sqrt(sum(m * m)) / max(c), 6) as compactness from (select label, i, sum(x) as m, count(*) as c from {unit_elements} group by label, i) t group by label",
    "a25_youden": "with g as (select i * 0.05 as cut from @range(8)), r as (select t.level, g.cut, t.reduction >= g.cut as hit, t.level <= 3 as positive from {transitions} t cross join g) select cut, round(avg(case when positive then case when hit then 1.0 else 0.0 end end), 6) as sensitivity, round(avg(case when not positive then case when hit then 0.0 else 1.0 end end), 6) as specificity from r group by cut",
    "a26_failure_gates": "select relation, dataset, flag, count(*) as n, round(avg(case when weight < 10 then 1.0 else 0.0 end), 6) as failed from {assertions} group by grouping sets ((relation), (dataset), (flag))",
    "a27_part_counts": "select part, shape, count(*) as n from (select case when src % 5 = 0 then 'W' when dst % 2 = 0 then 'S' else 'R' end as part, relation as shape from {records}) t group by part, shape",
    "a28_vector_coverage": "select sum(case when found = total then 1 else 0 end) as full_n, sum(case when found > 0 and found < total then 1 else 0 end) as partial_n, sum(case when found = 0 then 1 else 0 end) as none_n from (select src, count(*) as total, sum(case when dst % 3 = 0 then 1 else 0 end) as found from (select distinct src, dst from {sparse}) e group by src) t",
    "a29_document_frequency": "with w as (select distinct doc_id, token from (select doc_id, @tokens(text) as token from {corpus}) t where length(token) > 2) select token, df, round(df * 1.0 / sum(df) over (), 9) as share from (select token, count(*) as df from w group by token) q order by df desc, token limit 200",
    "a30_entity_frequency": "select name, count(*) as n from (select @tokens(split_part(text, '.', 1)) as name, doc_id from {corpus}) t where length(name) > 4 group by name having count(*) >= 3",
    "a31_concept_max_merge": "select text, max(score) as score from (select p_brand as text, cast(max(p_size) as double) as score from {part} group by p_brand union all select p_type, cast(max(p_size) / 2 as double) from {part} group by p_type) t group by text order by score desc, text limit 40",
    "a33_hubness": "with c as (select i, sum(x) as total from {unit_elements} e group by i), s as (select e.id, sum(e.x * c.total) - sum(e.x * e.x) as t from {unit_elements} e join c on c.i = e.i group by e.id) select id, round(t / (select max(t) from s), 6) as hubness from s",
    "a34_grid_binning": "select gx, gy, round(avg(w), 6) as mean_w, count(*) as n from (select floor(src * 8.0 / 2001) as gx, floor((dst - 1000000) * 8.0 / 101) as gy, weight as w from {directed}) t group by gx, gy",
    "a35_mode_localisation": "select round(sum(pow(x, 4)) / pow(sum(x * x), 2), 9) as ipr, round(pow(sum(x * x), 2) / sum(pow(x, 4)), 6) as participation, round(corr(abs(x), d), 6) as degree_correlation from (select s.x, count(*) * 1.0 as d from {state} s join {both} e on e.src = s.id group by s.id, s.x) t",
    # windows
    "w1_plateau_runs": "select min(level) as first_level, max(level) as last_level, count(*) as length, round(max(subspace), 6) as worst from (select level, subspace, level - row_number() over (order by level) as island from {transitions} where reduction >= 0.10 and r_fine = r_coarse and subspace <= 0.25) t group by island having count(*) >= 2",
    "w2_adjacent_gap": "select k, round(abs(lam - lead(lam) over (order by lam desc, k)), 6) as gap from {spectrum}",
    "w3_argmax_gap": "select i + 1 as r from (select i, row_number() over (order by gap desc, i) as k from (select row_number() over (order by lam desc, k) - 1 as i, round(lam - lead(lam) over (order by lam desc, k), 9) as gap from {spectrum}) t where gap is not null) q where k = 1",
    "w4_top_target": "select src, dst, weight from (select src, dst, weight, row_number() over (partition by src order by weight desc, dst) as k from (select src, dst, sum(weight) as weight from {directed} group by src, dst) t) q where k = 1",
    "w6_sentence_context": "select l_orderkey, l_linenumber, l_partkey, count(*) over w as n, min(l_partkey) over w as low, max(l_partkey) over w as high from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from {lineitem} group by l_orderkey, l_linenumber) t window w as (partition by l_orderkey order by l_linenumber rows between 3 preceding and 3 following)",
    "w7_moving_mean": "select event_id, round(avg(value) over (partition by user_id order by event_id rows between 4 preceding and current row), 6) as eta from {events}",
    "w8_rank_paired_spectra": "with a as (select row_number() over (order by lam desc, k) as r, lam from {spectrum}), b as (select row_number() over (order by x desc, id) as r, x as lam from {state} where id >= 1000000) select a.r, round(abs(a.lam - b.lam), 6) as error from a join b on a.r = b.r where a.r > 1",
    # sort, limit, top-k
    "t1_uri_node_cap": "select start_uri as uri from (select distinct start_uri from {assertions}) t order by uri limit 500",
    "t3_degree_pool": "select id, round(s, 6) as degree from (select src as id, sum(ln(1 + weight)) as s from {both} group by src) t order by round(s, 6) desc, id limit 300",
    "t5_top_hubs": "select src as id, count(*) as degree from {both} group by src order by degree desc, id limit 25",
    "t6_vector_search": "select id, round(s, 6) as similarity from (select b.id, @dot(a.v; b.v) / sqrt(@dot(a.v; a.v) * @dot(b.v; b.v)) as s from {vectors} a join {vectors} b on a.id = 0) t order by round(s, 9) desc, id limit 10",
    "t7_density_order": "select kind, place from (select src % 300 as kind, row_number() over (order by round(sum(weight) / count(*), 6) desc, sum(weight) desc, src % 300) as place from {sparse} group by src % 300) t where place <= 50",
    "t9_nearest_level": "select target, level from (select g.target, t.level, row_number() over (partition by g.target order by abs(t.reduction - g.target), t.level) as k from {transitions} t cross join (select (i + 1) / 10.0 as target from @range(4)) g) q where k = 1",
    "t11_landmarks": "select id, place from (select src as id, row_number() over (order by count(*) desc, src) as place from {both} group by src) t where place <= 64",
    # set operations
    "u1_endpoint_union": "select uri from (select start_uri as uri from {assertions} union select end_uri from {assertions}) t",
    "u2_symmetrise": "select src, dst, round(sum(w) / 2, 6) as weight from (select src, dst, weight as w from {directed} union all select dst, src, weight from {directed}) t group by src, dst",
    "u3_set_difference": "select src from {directed} where weight > 100 except select src from {sparse}",
    "u4_jaccard": "with a as (select distinct relation, dst from {sparse}), b as (select relation, count(*) as n from a group by relation), c as (select x.relation as r1, y.relation as r2, count(*) as n from a x join a y on x.dst = y.dst and x.relation < y.relation group by x.relation, y.relation) select r1, r2, round(c.n * 1.0 / (p.n + q.n - c.n), 6) as jaccard from c join b p on p.relation = r1 join b q on q.relation = r2",
    "u5_multiset_equality": "select count(*) as differing from (select edge_id, src, dst from {records} except all (select edge_id, src, dst from {records} where src % 2 = 0 union all select edge_id, src, dst from {records} where src % 2 <> 0)) t",
    "u6_max_topology": "select src, dst, round(max(weight), 6) as weight from {both} group by src, dst",
    "u7_dedup_occurrences": "select kind, nodes, min(edge_id) as first_id, count(*) as n from (select relation as kind, cast(least(src, dst) as varchar(20)) || '-' || cast(greatest(src, dst) as varchar(20)) as nodes, edge_id from {records}) t group by kind, nodes",
    # graph structure
    "g6_ego_subgraph": "select center, count(*) as nodes from (select src as center, dst as node, row_number() over (partition by src order by dst) as k from (select distinct src, dst from {both}) t) q where k < 48 group by center having count(*) >= 2",
    "g7_boundary_signature": "select r.src as node, r.relation, count(*) as external from {records} r left join {figures} a on a.node = r.src left join {figures} b on b.node = r.dst where a.figure is not null and (b.figure is null or b.figure <> a.figure) group by r.src, r.relation",
    "g8_hash_sample": "select id from (select distinct src as id, md5('seed7|' || cast(src as varchar(20))) as h from {directed}) t order by h, id limit 100",
    "g11_clustering_coefficient": "with e as (select src as a, dst as b from {copurchase}), s as (select a as u, b as v from e union all select b, a from e), d as (select u, count(*) as k from s group by u), t as (select x.u, count(*) as n from s x join s y on x.u = y.u and x.v < y.v join e on e.a = x.v and e.b = y.v group by x.u) select d.u as node, round(case when k < 2 then 0.0 else 2.0 * coalesce(n, 0) / (k * (k - 1)) end, 6) as coefficient from d left join t on t.u = d.u",
    "g15_normalized_laplacian": "with d as (select src as id, sum(weight) as degree from {both} group by src) select e.src, e.dst, round(case when e.src = e.dst then 1.0 else 0.0 end - e.weight / sqrt(a.degree * b.degree), 9) as l from {both} e join d a on e.src = a.id join d b on e.dst = b.id where a.degree > 0 and b.degree > 0",
    "g28_symmetric_quotient": "select src, dst, round(sum(w) / 2, 6) as weight from (select a.coarse as src, b.coarse as dst, e.weight as w from {directed} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine union all select b.coarse, a.coarse, e.weight from {directed} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine) t group by src, dst having sum(w) <> 0",
    "g29_directed_quotient": "select e.relation, a.coarse as src, b.coarse as dst, round(sum(e.weight), 6) as weight from {directed} e join {mapping} a on e.src = a.fine join {mapping} b on e.dst = b.fine group by e.relation, a.coarse, b.coarse",
    "g33_trajectory_error": "select round(sqrt(sum((s.x - m.mean_x) * (s.x - m.mean_x))) / sqrt(sum(s.x * s.x)), 9) as relative_error from {state} s join {mapping} p on s.id = p.fine join (select coarse, avg(x) as mean_x from {state} s join {mapping} p on s.id = p.fine group by coarse) m on m.coarse = p.coarse",
    "g35_post_transient_error": "select round(sqrt(sum(value * value)) , 6) as energy, min(event_id) as start_id from (select value, event_id, event_id * 1.0 / (select max(event_id) from {events}) as t from {events}) q where t >= 0.5",
    "g39_membership_composition": "select o.r_name as root, @agg(n.n_name; '|') as members, count(*) as n from {nation} n join {region} o on n.n_regionkey = o.r_regionkey group by o.r_name",
    "g41_ring_of_rings": "select b * 10 + i as src, b * 10 + (i + d) % 10 as dst, 1.0 as weight from (select i as b from @range(8)) x cross join @range(10) y cross join (select i + 1 as d from @range(2)) z union all select b * 10, ((b + 1) % 8) * 10, 0.01 from (select i as b from @range(8)) x",
    "g42_circulant_control": "select i as src, (i + d) % 80 as dst, 1.0 as weight from @range(80) x cross join (select i + 1 as d from @range(2)) z union all select i, (i * 37 + 11) % 80, 1.0 from @range(80) x where i % 8 = 0",
    # motifs, records and description length
    "m1_wl_features": "with l as (select src as id, md5(cast(count(*) as varchar(20))) as label from (select distinct src, dst from {sparse} union select dst, src from {sparse}) t group by src) select label, count(*) as n from (select e.src, md5(@agg(l.label; '|')) as label from (select distinct src, dst from {sparse} union select dst, src from {sparse}) e join l on l.id = e.dst group by e.src) q group by label",
    "m2_graphlets": "with e as (select src as a, dst as b from {copurchase}), p as (select x.a as u, x.b as v, y.b as w from e x join e y on x.a = y.a and x.b < y.b) select case when e.a is null then 'path' else 'triangle' end as shape, count(*) as n from p left join e on e.a = p.v and e.b = p.w group by case when e.a is null then 'path' else 'triangle' end",
    "m13_type_registry": "select shape, dense_rank() over (order by first_id) as number from (select relation || ':' || cast(src % 9 as varchar(20)) as shape, min(edge_id) as first_id from {records} group by relation || ':' || cast(src % 9 as varchar(20))) t",
    "m14_frequency_bookkeeping": "select relation as kind, src % 4 as level, count(*) as n from {records} group by relation, src % 4",
    "m18_occurrence_cost": "select figure, e, n, round(e * (2 * greatest(log2(210.0), 1) + greatest(log2(6.0), 1)), 6) as raw_bits, round(n * greatest(log2(210.0), 1) + 8 + greatest(0, (e * (2 * greatest(log2(n * 1.0), 1) + greatest(log2(6.0), 1)) + n) / 12), 6) as encoded_bits from (select a.figure, count(*) as e, count(distinct r.src) + count(distinct r.dst) as n from {records} r join {figures} a on a.node = r.src join {figures} b on b.node = r.dst and a.figure = b.figure group by a.figure) t",
    "m21_occurrence_partition": "select node, coalesce(first_node, node) as coarse from (select i.node, min(f.node) over (partition by f.figure) as first_node from (select distinct src as node from {records}) i left join {figures} f on f.node = i.node) t",
    "m22_symbol_composition": "select n.node, coalesce('F' || cast(f.figure as varchar(20)), 'ATOM') as symbol from (select src as node from {records} union select dst from {records}) n left join {figures} f on f.node = n.node",
    "m24_edge_partition": "with nb as (select distinct src as u, dst as v from {records} where src <> dst union select distinct dst, src from {records} where src <> dst), dg as (select u, count(*) as k from nb group by u), lp as (select distinct src as u from {records} where src = dst) select r.edge_id, case when a.figure is not null and a.figure = b.figure then 'W' when r.src <> r.dst and ls.u is null and ld.u is null and x.k = 1 and y.k = 1 then 'I' when r.src <> r.dst and ls.u is null and ld.u is null and (x.k = 1 or y.k = 1) then 'S' else 'R' end as part from {records} r left join {figures} a on a.node = r.src left join {figures} b on b.node = r.dst left join dg x on x.u = r.src left join dg y on y.u = r.dst left join lp ls on ls.u = r.src left join lp ld on ld.u = r.dst",
    "m25_pair_shapes": "with p as (select least(src, dst) as a, greatest(src, dst) as b, @agg(case when src < dst then '>' else '<' end || relation; ',') as shape from {records} where src <> dst group by least(src, dst), greatest(src, dst)) select shape, count(*) as support from p group by shape having count(*) >= 3",
    "m31_boundary_connections": "select r.edge_id, r.src, r.dst from {records} r left join {figures} a on a.node = r.src left join {figures} b on b.node = r.dst where (a.figure is not null or b.figure is not null) and coalesce(a.figure, -1) <> coalesce(b.figure, -2)",
    "m32_stationary_variation": "select round(sum(abs(a.m - b.m)) / 2, 9) as tv from (select src, sum(weight) / (select sum(weight) from {both}) as m from {both} group by src) a join (select src, count(*) * 1.0 / (select count(*) from {both}) as m from {both} group by src) b on a.src = b.src",
    "m33_vector_alignment": "select label, i, round(avg(x), 6) as mean_x from {unit_elements} where i <= 4 group by label, i",
    "m35_relation_signature": "select src, dst, @agg(relation; '|') as signature from (select distinct src, dst, relation from {records}) t group by src, dst",
    # text
    "l1_sentence_tokens": "select doc_id, count(*) as tokens, count(distinct token) as kinds from (select doc_id, @tokens(text) as token from {corpus}) t where token not in ('the', 'of', 'and', 'to', 'in', 'is', 'a') group by doc_id",
}
#: Reasons of the plateau gate, in order; a missing metric fails.
REASONS = "case when r_fine <> r_coarse then 'r_instability;' else '' end || case when reduction < 0.10 - 1e-12 then 'insufficient_reduction;' else '' end || case when subspace is null or subspace > 0.25 then 'subspace;' else '' end || case when trajectory is null or trajectory > 0.25 then 'trajectory;' else '' end || case when eigenvalue is null or eigenvalue > 0.05 then 'eigenvalue;' else '' end"
OPERATORS["pf16_plateau_gate"] = OPERATORS["pf16_plateau_gate"].replace("{reasons}", REASONS)

# operators over the results of others
OPERATORS |= {
    "pf15_gain_filter": f"select figure, n, round(raw_bits - encoded_bits, 6) as gain from ({OPERATORS['m18_occurrence_cost']}) t where raw_bits - encoded_bits > 0 and n >= 3",
    "a17_description_totals": f"select count(*) as figures, sum(e) as covered_edges, round(sum(raw_bits), 4) as raw_bits, round(sum(encoded_bits), 4) as encoded_bits, round(sum(encoded_bits) / nullif(sum(raw_bits), 0), 6) as ratio from ({OPERATORS['m18_occurrence_cost']}) t",
    "t8_figure_cap": f"select figure, round(raw_bits - encoded_bits, 6) as gain from ({OPERATORS['m18_occurrence_cost']}) t order by raw_bits - encoded_bits desc, figure limit 8",
    "t10_best_detector": f"select cut, sensitivity, specificity, youden, place from (select cut, sensitivity, specificity, round(sensitivity + specificity - 1, 6) as youden, row_number() over (order by round(sensitivity + specificity - 1, 6) desc, sensitivity desc, specificity desc, cut) as place from ({OPERATORS['a25_youden']}) g) t where place <= 3",
    "t12_archive_choice": f"with f as (select raw_bits - encoded_bits as gain, row_number() over (order by raw_bits - encoded_bits desc, figure) as place from ({OPERATORS['m18_occurrence_cost']}) t), c as (select cap, round(sum(case when place <= cap then 64 - gain else 0 end), 4) as cost from f cross join (values (0), (4), (1024)) as v(cap) group by cap) select cap, cost from c order by cost, cap limit 1",
    "j15_type_buckets": f"select signature, count(*) as edges, min(src * 10000000 + dst) as first_edge from ({OPERATORS['m35_relation_signature']}) t group by signature",
    "j19_positional_pairs": "with p as (select part.p_brand as block, part.p_partkey as tok, row_number() over (partition by part.p_brand order by part.p_partkey) as pos from {part} part) select a.block, count(*) as pairs, sum(b.tok - a.tok) as spread from p a join p b on a.block = b.block and b.pos > a.pos and b.pos < a.pos + 4 group by a.block",
    "w9_rank_prefix": "select src, dst, place from (select src, dst, row_number() over (partition by src order by weight desc, dst) as place from {both}) t where place <= 3",
    "g32_eigenvalue_error": "with a as (select lam, row_number() over (order by lam desc, k) as place from {spectrum}), b as (select lam * 0.98 as lam, row_number() over (order by lam desc, k) as place from {spectrum} where k % 2 = 0) select count(*) as paired, round(max(abs(a.lam - b.lam)), 6) as error from a join b on a.place = b.place where a.place > 1",
    "g43_sweep_settings": "select b.i as bridge, r.i as reduction, s.i as seed, case when b.i = 0 then 'negative' else 'positive' end as control, row_number() over (order by b.i, r.i, s.i) as run from @range(4) b cross join @range(2) r cross join @range(2) s",
}

# decimal literals would make Spark and DuckDB differ in scale: all are doubles
OPERATORS = {name: re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"cast(\1 as double)", sql) for name, sql in OPERATORS.items()}


def apply(name: str, **inputs: DataFrame) -> DataFrame:
    """The operator's plan over the given inputs."""
    spark = next(iter(inputs.values())).sparkSession
    return run_sql(spark, OPERATORS[name], **inputs)
