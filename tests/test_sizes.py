"""What only shows on larger tables: key ranges that meet, pools without edges, joins that grow with groups."""

import pytest

from tessella.operators import iterative
from tessella.plans import catalog
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


def replaced(folder, **tables: str) -> str:
    """A folder of the small tables, some of them replaced by the result of a query over them."""
    con = connect(SF)
    for (name,) in con.execute("select view_name from duckdb_views() where not internal").fetchall():
        con.execute(f"copy ({tables.get(name, f'select * from {name}')}) to '{folder}/{name}.parquet' (format parquet)")
    return str(folder)


def compare(spark, folder: str, name: str):
    return differences(spark, connect(folder), catalog.QUERIES[name], catalog.ORACLES[name], folder)


def test_quotient_of_parts_and_suppliers_with_the_same_numbers(spark, tmp_path):
    far = {"part": "select * replace (p_partkey + 1000000 as p_partkey) from part", "lineitem": "select * replace (l_partkey + 1000000 as l_partkey) from lineitem"}
    assert compare(spark, replaced(tmp_path, **far), "g30_label_quotient") is None


def test_quotient_keeps_nodes_without_a_label(spark, tmp_path):
    assert compare(spark, replaced(tmp_path, part="select * from part where p_partkey % 3 > 0"), "g30_label_quotient") is None


def test_quotient_contracts_components_within_labels(spark):
    """Blocks of parts and suppliers: fewer nodes than before, the same weight, and a block that edges both leave and enter."""
    con = connect(SF)
    weight, parts, suppliers = con.execute("select sum(l_quantity), count(distinct l_partkey), count(distinct l_suppkey) from lineitem").fetchone()
    rows = catalog.QUERIES["g30_label_quotient"](spark, SF).collect()
    left, entered = {r["src"] for r in rows}, {r["dst"] for r in rows}
    assert len(left | entered) < parts + suppliers and left & entered
    assert sum(r["weight"] for r in rows) == pytest.approx(float(weight))


def test_growth_widens_a_pool_without_edges(spark):
    """Hubs that meet only in nodes of low degree: the first pool is all hubs."""
    edges = spark.createDataFrame([(leaf, 1000 + hub) for hub in range(8) for leaf in range(hub, hub + 30)], "src long, dst long")
    ends = edges.union(edges.select("dst", "src")).toDF("node", "other")
    degrees = ends.groupBy("node").count().selectExpr("node", "cast(count as double) as degree")
    assert iterative.degree_pool(degrees, edges, 8)[0].count() == 1
    got = [r["node"] for r in iterative.best_first_growth(degrees, edges, 4, 2.0).orderBy("place").collect()]
    assert len(set(got)) == 4 and got[0] == 1000
    with pytest.raises(ValueError):
        iterative.best_first_growth(degrees, edges, 60, 0.1)


def test_family_match_over_blocks_ties_and_nulls(spark, tmp_path, monkeypatch):
    """Equal sets, sets in several blocks, ties, and events without a type or a key."""
    from tessella.operators import families

    events = "select events.* replace (user_id + i * 1001 as user_id, case when event_id % 7 = 0 then null else event_type end as event_type, case when event_id % 11 = 0 then '{}' else props end as props) from events, range(3) r(i)"
    folder = replaced(tmp_path, events=events)
    monkeypatch.setattr(families, "SET_COLUMNS", 7)
    monkeypatch.setattr(families.best_set_match, "__defaults__", (5,))
    assert compare(spark, folder, "j16_family_match") is None
    plan = catalog.QUERIES["j16_family_match"](spark, folder)._jdf.queryExecution().toString()
    assert "right_id" in plan and " y#" not in plan  # no join on tokens is left in the plan


@pytest.mark.parametrize("name", ["g11_clustering_coefficient", "m2_graphlets"])
def test_triangles_over_many_tasks(spark, monkeypatch, name):
    """Seven colours and steps of a few wedges; no join of wedges is left in the plan."""
    from tessella.operators import triangles

    monkeypatch.setattr(triangles, "TASK_EDGES", 1600)
    assert compare(spark, SF, name) is None
    assert "Join" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_triangles_of_a_random_graph():
    import numpy as np

    from tessella.operators import triangles

    random = np.random.default_rng(5)
    edges = np.unique(np.sort(random.integers(0, 60, (500, 2)), axis=1), axis=0)
    edges = edges[edges[:, 0] < edges[:, 1]]
    full = np.zeros((60, 60), np.int64)
    full[edges[:, 0], edges[:, 1]] = full[edges[:, 1], edges[:, 0]] = 1
    nodes, found = triangles.count_triangles(edges[:, 0], edges[:, 1])
    assert dict(zip(nodes.tolist(), found.tolist(), strict=True)) == {int(i): int(x) for i, x in enumerate(np.diag(full @ full @ full) // 2) if full[i].any()}


def test_ports_follow_a_count_by_hand(spark):
    """Egos with inner edges, parallel relations and edges both ways; no plan row for an ego and a node's edge."""
    import random
    from collections import Counter

    from tessella.operators import motifs

    draw = random.Random(3)
    rows = sorted({(draw.randrange(14), draw.randrange(14), draw.choice("ab")) for _ in range(90)})
    edges = spark.createDataFrame([(*r, 1.0) for r in rows], "src long, dst long, relation string, weight double")
    egos = motifs.ego_nodes(edges, 5)
    members: dict[int, set[int]] = {}
    for r in egos.collect():
        members.setdefault(r["center"], set()).add(r["node"])
    want: Counter = Counter()
    for center, nodes in members.items():
        for u, v, relation in rows:
            if u != v and u in nodes and v not in nodes:
                want[center, u, relation, "o"] += 1
            if u != v and v in nodes and u not in nodes:
                want[center, v, relation, "i"] += 1
    found = motifs.boundary_ports(edges, egos)
    got = [tuple(r) for r in found.select("center", "node", "relation", "direction", "n").collect()]
    assert len(got) == len(want) and {r[:4]: r[4] for r in got} == want
    assert "LeftAnti" not in found._jdf.queryExecution().toString()


def test_eigenpairs_on_the_driver_take_no_job_a_step(spark, monkeypatch):
    """Four equal circles, whose values lie close together and repeat: as dense ones, within the steps allowed."""
    import numpy as np

    from tessella.operators import spectral

    n = 150
    pairs = [(c * n + i, c * n + (i + 1) % n) for c in range(4) for i in range(n)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, weight double")
    exact, _ = spectral.top_eigenpairs(edges, 6)
    monkeypatch.setattr(spectral, "DENSE", 10)
    monkeypatch.setattr(spectral, "spmv", None)
    found, coords = spectral.top_eigenpairs(edges, 6)
    assert np.allclose(found, exact, atol=1e-6)
    assert coords.count() == 4 * n and len(coords.first()["coords"]) == 6


def test_eigenpairs_on_the_driver_need_no_setting(spark, monkeypatch):
    """A session of the driver's own, where Arrow is off unless it is asked for."""
    import numpy as np

    from tessella.operators import spectral

    pairs = [(i, (i + 1) % 40) for i in range(40)] + [(i, (i + 7) % 40) for i in range(0, 40, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, weight double")
    exact, _ = spectral.top_eigenpairs(edges, 3)
    monkeypatch.setattr(spectral, "DENSE", 10)
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        found, coords = spectral.top_eigenpairs(edges, 3)
        rows = {r["id"]: r["coords"] for r in coords.collect()}
    finally:
        spark.conf.set(setting, before)
    assert np.allclose(found, exact, atol=1e-6)
    held = np.array([rows[i] for i in range(40)])
    assert np.allclose(held.T @ held, np.eye(3), atol=1e-6)


def test_eigenvalues_of_a_graph_of_many_components():
    """Thirty circles: more values of one than the block has columns, so their gap is nothing."""
    import numpy as np
    import pyarrow as pa

    from tessella.operators import spectral

    n = 40
    a = np.concatenate([c * n + np.arange(n) for c in range(30)])
    b = np.concatenate([c * n + (np.arange(n) + 1) % n for c in range(30)])
    matrix = pa.table({"src": np.concatenate([a, b]), "dst": np.concatenate([b, a]), "w": np.full(2 * len(a), 0.5)})
    start = np.random.default_rng(1).uniform(-1, 1, (30 * n, 10))
    values, _ = spectral._subspace(matrix, np.arange(30 * n), start, 2, 200, 1e-8)
    assert np.abs(values[:2] - 1).max() < 1e-9
