"""Stored graphs: Parquet tables under a manifest, levels of a hierarchy, reports, word vectors.

A folder is complete once ``manifest.json`` is there; it is written last and states rows
and a checksum for each table, so a half-written or changed folder is refused. All paths
go through Hadoop's file systems.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

MANIFEST = "manifest.json"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


class create:
    """A new file as a write-only stream, replacing an old one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        fs, p = _at(spark, path)
        self.out = fs.create(p, True)

    def __enter__(self) -> create:
        return self

    def __exit__(self, *_: object) -> None:
        self.out.close()

    def write(self, data: bytes) -> int:
        self.out.write(bytearray(data))
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    with create(spark, path) as f:
        f.write((json.dumps(value, sort_keys=True) + "\n").encode())


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): does not depend on the order of rows or files."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.pmod(row, F.lit(1_000_000_007))), F.lit(0))).first()
    return int(n), int(total)


def save(tables: dict[str, DataFrame], path: str, about: dict | None = None, overwrite: bool = False) -> dict:
    """Write ``tables`` under ``path`` and then the manifest, which it returns.

    A complete folder is kept unless ``overwrite``; its manifest goes first then, so that a
    broken rewrite is not taken for the old graph. Tables must not be read from ``path``.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, mark = _at(spark, f"{path}/{MANIFEST}")
    if fs.exists(mark):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(mark, False)
    stated = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows, total = checksum(spark.read.schema(df.schema).parquet(f"{path}/{name}"))
        stated[name] = {"rows": rows, "checksum": total}
    manifest = {"tables": stated, "about": about or {}}
    write_json(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def load(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables, about) of a complete folder; other rows than the manifest states raise."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        raise ValueError(f"{path} has no completion mark")
    manifest = read_json(spark, f"{path}/{MANIFEST}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, stated in manifest["tables"].items():
        if verify and checksum(tables[name]) != (stated["rows"], stated["checksum"]):
            raise ValueError(f"{path}/{name} does not hold the rows of its manifest")
    return tables, manifest["about"]


def save_level(tables: dict[str, DataFrame], path: str, level: int, about: dict | None = None) -> None:
    """One level of a run, as a folder of its own."""
    save(tables, f"{path}/level={level}", about, overwrite=True)


def newest_level(spark: SparkSession, path: str, about: dict) -> int | None:
    """The last level of an unbroken row of complete levels from 0; another identity raises."""
    level = None
    while exists(spark, f"{path}/level={0 if level is None else level + 1}/{MANIFEST}"):
        level = 0 if level is None else level + 1
        found = read_json(spark, f"{path}/level={level}/{MANIFEST}")["about"]
        if {k: found.get(k) for k in about} != about:
            raise ValueError(f"{path} holds a run of other inputs or settings")
    return level


def drop_levels(spark: SparkSession, path: str, first: int) -> None:
    """Delete the levels from ``first`` on, the last one first."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    for level in sorted((int(n[6:]) for n in names if n.startswith("level=")), reverse=True):
        if level >= first:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/level={level}"), True)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0, gapless) in the order of ``keys``, which must be unique.

    Rows are dealt by range and numbered within the range; the driver only sees the number
    of rows of each range, so no task gets them all.
    """
    ranged = materialize(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranged")
    at, starts = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        starts.append((r["_range"], at))
        at += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(table), "_range").withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_range", "_start", "_place")


def edge_records(edges: DataFrame) -> DataFrame:
    """(edge_id, relation, src, dst, weight) in (relation, src, dst) order; a weight below 0 or not finite raises."""
    bad = F.isnan("weight") | F.col("weight").isNull() | (F.col("weight") < 0) | (F.col("weight") == float("inf"))
    rows = edges.select("relation", "src", "dst", F.col("weight").cast("double").alias("weight"))
    if rows.filter(bad).limit(1).count():
        raise ValueError("a stored weight is negative or not finite")
    return numbered(rows, ["relation", "src", "dst"], "edge_id").select("edge_id", "relation", "src", "dst", "weight")


def check_members(members: DataFrame) -> DataFrame:
    """(node, uri) as given if nodes are 0 to n - 1 and each has a uri; else raises."""
    some = members.filter(F.col("uri").isNotNull())
    r = members.agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("node").alias("n")).first()
    named = some.agg(F.count_distinct("node")).first()[0]
    if r["n"] and (r["a"] != 0 or r["b"] + 1 != r["n"] or named != r["n"]):
        raise ValueError("node ids have a gap, or a node has no uri")
    return members


def write_report(rows: DataFrame, path: str) -> None:
    """A result table as one folder of JSON lines and one of CSV; nested columns go as JSON text."""
    rows.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_plain_archive(records: DataFrame, path: str) -> int:
    """Gzipped JSON lines of all records, to weigh codecs against; returns the bytes."""
    records.repartitionByRange("relation", "src", "dst").sortWithinPartitions("relation", "src", "dst").write.mode("overwrite").option("compression", "gzip").json(path)
    fs, p = _at(records.sparkSession, path)
    return int(fs.getContentSummary(p).getLength())


def word_vectors(lines: DataFrame, vocabulary: DataFrame, width: int) -> DataFrame:
    """(word, v): unit vectors of the wanted words from lines (line_no, value) of ``word x1 x2 ...``.

    The first sound line of a word counts; lines of another width, with a value that is no
    finite number, or of length zero are passed over.
    """
    parts = F.split("value", " ", -1)
    v = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    rows = lines.select("line_no", F.get(parts, F.lit(0)).alias("word"), v.alias("v")).join(vocabulary.select("word").distinct(), "word", "left_semi")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sound = rows.filter(F.size("v") == width).withColumn("norm", norm).filter("norm > 0 and not isnan(norm) and norm < double('infinity')")
    return sound.groupBy("word").agg(F.min_by(F.struct("v", "norm"), "line_no").alias("b")).select("word", F.transform("b.v", lambda x: x / F.col("b.norm")).alias("v"))
