"""The driver's tables as graph inputs: SQL that both engines read."""

from __future__ import annotations

# Inputs of the operators; {name} is a driver table or another input.
INPUTS = {
    "assertions": "select l_returnflag || l_linestatus as relation, '/c/en/part_' || cast(l_partkey as varchar(20)) as start_uri, '/c/en/supp_' || cast(l_suppkey as varchar(20)) as end_uri, l_quantity as weight, l_linestatus as dataset, l_returnflag as flag, l_linenumber as line from {lineitem}",
    "directed": "select l_partkey as src, 1000000 + l_suppkey as dst, l_returnflag || l_linestatus as relation, sum(l_quantity) as weight from {lineitem} group by l_partkey, l_suppkey, l_returnflag || l_linestatus",
    "sparse": "select l_partkey as src, 1000000 + l_suppkey as dst, l_returnflag || l_linestatus as relation, l_quantity as weight from {lineitem} where l_quantity >= 50",
    "fragments": "select o_custkey as src, 100000000 + o_orderkey as dst from {orders}",
    "copurchase": "select distinct a.l_partkey as src, b.l_partkey as dst from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey where a.l_partkey < b.l_partkey",
    "both": "select src, dst, sum(weight) as weight from (select src, dst, weight from {directed} union all select dst, src, weight from {directed}) t group by src, dst",
    "records": "select event_id as edge_id, user_id as src, 1000000 + @k(props) as dst, event_type as relation, value as weight from {events}",
    "mapping": "select p_partkey as fine, cast(5000000 + p_size as bigint) as coarse from {part} union all select 1000000 + s_suppkey, cast(6000000 + s_nationkey as bigint) from {supplier}",
    "state": "select p_partkey as id, p_retailprice / 1000 as x from {part} union all select 1000000 + s_suppkey, s_acctbal / 10000 from {supplier}",
    "figures": "select distinct user_id as node, user_id % 12 as figure from {events} where user_id % 5 <> 0 union select distinct 1000000 + @k(props), @k(props) % 12 from {events} where @k(props) % 2 = 0",
    "vectors": "select vec_id as id, embedding as v, label from {embeddings}",
    "corpus": "select doc_id, text, source from {documents} where lang = 'en'",
    "transitions": "select level, cast(reduction as double) as reduction, r_fine, r_coarse, cast(subspace as double) as subspace, cast(trajectory as double) as trajectory, cast(eigenvalue as double) as eigenvalue from (values (1, 0.42, 6, 6, 0.08, 0.05, 0.01), (2, 0.35, 6, 6, 0.12, 0.06, 0.02), (3, 0.30, 6, 6, 0.15, 0.07, 0.02), (4, 0.05, 6, 5, 0.20, 0.30, 0.05), (5, 0.28, 5, 5, 0.10, 0.09, 0.03), (6, 0.26, 5, 5, 0.11, 0.10, 0.02), (7, 0.22, 5, 5, null, 0.12, 0.04), (8, 0.20, 5, 4, 0.40, 0.35, 0.09)) as t(level, reduction, r_fine, r_coarse, subspace, trajectory, eigenvalue)",
    "spectrum": "select cast(l_suppkey as bigint) as k, sum(l_extendedprice * l_discount) / 1000000 as lam from {lineitem} group by l_suppkey",
    "sparse_pairs": "select distinct src, dst from {sparse}",
    "unit_elements": "{unit_elements}",
}
# one row per vector component, of unit length; explode and unnest differ between the engines
UNIT_SPARK = "select id, label, cast(pos + 1 as bigint) as i, cast(x as double) / norm as x from (select id, label, sqrt(aggregate(v, cast(0 as double), (s, y) -> s + cast(y as double) * cast(y as double))) as norm, posexplode(v) as (pos, x) from {vectors}) t"
UNIT_DUCK = "select id, label, i, v[i]::double / sqrt(list_inner_product(v::double[], v::double[])) as x from (select id, label, v, unnest(range(1, len(v) + 1)) as i from {vectors}) t"
