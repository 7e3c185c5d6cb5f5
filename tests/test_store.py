import pytest
from pyspark.sql import functions as F

from tessella.operators import coding, motifs
from tessella.sources import store


def edges_of(spark):
    return spark.createDataFrame([(1, 2, "a", 1.5), (2, 3, "b", 2.0), (3, 1, "a", 0.5), (4, 5, "a", 1.0), (5, 6, "b", 1.0), (6, 4, "a", 3.0)], "src long, dst long, relation string, weight double")


def test_saved_graph_is_verified(spark, tmp_path):
    path = str(tmp_path / "graph")
    with pytest.raises(ValueError, match="completion"):
        store.load(spark, path)
    store.save({"edges": edges_of(spark)}, path, {"kind": "x"})
    tables, about = store.load(spark, path)
    assert about == {"kind": "x"} and tables["edges"].exceptAll(edges_of(spark)).count() == 0
    with pytest.raises(FileExistsError):
        store.save({"edges": edges_of(spark)}, path)
    edges_of(spark).limit(2).write.mode("append").parquet(f"{path}/edges")
    with pytest.raises(ValueError, match="rows"):
        store.load(spark, path)
    store.save({"edges": edges_of(spark).limit(0)}, path, overwrite=True)
    assert store.load(spark, path)[0]["edges"].count() == 0


def test_edge_records_number_in_order(spark):
    got = sorted(tuple(r) for r in store.edge_records(edges_of(spark).repartition(5)).collect())
    want = sorted((r, s, d, w) for s, d, r, w in [tuple(x) for x in edges_of(spark).collect()])
    assert got == [(i, *x) for i, x in enumerate(want)]
    assert store.edge_records(edges_of(spark).limit(0)).count() == 0
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="weight"):
            store.edge_records(edges_of(spark).withColumn("weight", F.lit(bad).cast("double")))


def test_members(spark):
    of = lambda rows: spark.createDataFrame(rows, "node long, uri string")
    assert store.check_members(of([(0, "a"), (1, "b"), (1, "c")])).count() == 3
    for rows in ([(0, "a"), (2, "b")], [(1, "a")], [(0, "a"), (1, None)]):
        with pytest.raises(ValueError, match="node"):
            store.check_members(of(rows))


def test_word_vectors_take_the_first_sound_line(spark):
    lines = ["a 1 x", "a 3 4", "a 1 0", "b 0 0", "c 1", "d 1 nan", "e 1 1"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r["word"]: [round(x, 6) for x in r["v"]] for r in store.word_vectors(df, spark.createDataFrame([(x,) for x in "abcd"], "word string"), 2).collect()}
    assert got == {"a": [0.6, 0.8]}


def test_mining_resumes_to_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "mining")
    star = [(10 * i, 10 * i + j, "ab"[j % 2], 1.0) for i in range(12) for j in range(1, 6)] + [(10 * i, 10 * i + 10, "c", 1.0) for i in range(11)]
    edges = spark.createDataFrame(star, "src long, dst long, relation string, weight double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = motifs.mine(edges, max_levels=3, cap=7)
    motifs.mine(edges, max_levels=1, cap=7, store=path)
    again = motifs.mine(edges, max_levels=3, cap=7, store=path)
    assert rows(whole[0]) == rows(again[0]) and rows(whole[1].select("node", "owner")) == rows(again[1].select("node", "owner"))
    with pytest.raises(ValueError, match="other inputs"):
        motifs.mine(edges, max_levels=2, cap=6, store=path)
    store.drop_levels(spark, path, 0)
    assert not store.exists(spark, f"{path}/level=0")


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(map(tuple, edges_of(spark).collect()))], "edge_id long, src long, dst long, relation string, weight double")
    path = str(tmp_path / "a.zip")
    coding.write_archive(coding.encode_records(rows), path, {"n": 6})
    blocks, manifest = coding.read_archive(spark, path)
    assert manifest == {"n": 6} and coding.decode_records(blocks).exceptAll(rows).count() == 0
