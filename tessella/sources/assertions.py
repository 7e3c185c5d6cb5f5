"""Assertion records: text scan, parsing with reject reasons, filters, and the writers."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("assertion_uri", "relation_uri", "start_uri", "end_uri", "metadata")


def read_lines(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(line_no, value) of a text file: plain, gzip or bzip2, and xz through a binary read.

    ``max_rows`` counts physical lines from the top of the file. Zip archives hold several
    members and are refused as ambiguous.
    """
    if path.endswith(".zip"):
        raise ValueError("a zip archive is ambiguous: give one text file")
    if path.endswith(".xz"):
        return _limit(_read_xz(spark, path), max_rows)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    if max_rows is not None:
        # a prefix needs the order of lines: number within blocks, then add the blocks before
        blocks = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("first"))
        starts = {}
        at = 0
        for r in sorted(blocks.collect(), key=lambda r: (r["f"], r["b"])):
            starts[(r["f"], r["b"])] = (at, r["first"])
            at += r["n"]
        table = spark.createDataFrame([(f, b, s, m) for (f, b), (s, m) in starts.items()], "f string, b long, start long, first long")
        numbered = lines.join(F.broadcast(table), ["f", "b"]).select((F.col("start") + F.col("m") - F.col("first")).alias("line_no"), "value")
        return numbered.filter(F.col("line_no") < max_rows)
    return lines.select(F.col("m").alias("line_no"), "value")


def _limit(lines: DataFrame, max_rows: int | None) -> DataFrame:
    return lines if max_rows is None else lines.filter(F.col("line_no") < max_rows)


def _read_xz(spark: SparkSession, path: str) -> DataFrame:
    def unpack(batches):
        import io
        import lzma

        import pyarrow as pa

        for batch in batches:
            for blob in batch.column(0):
                with lzma.open(io.BytesIO(blob.as_py()), "rt", encoding="utf-8", newline="\n") as f:
                    rows, at = [], 0
                    for line in f:
                        rows.append(line.rstrip("\n"))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows)], ["line_no", "value"])
                            at, rows = at + len(rows), []
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.string())], ["line_no", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "line_no long, value string")


def language_of(uri: Column) -> Column:
    """The third part of ``/c/<language>/...``; null for any other URI."""
    return F.when(F.split_part(uri, F.lit("/"), F.lit(2)) == "c", F.nullif(F.split_part(uri, F.lit("/"), F.lit(3)), F.lit("")))


def relation_of(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def node_tokens(uri: Column) -> Column:
    """Word tokens of an English node; an empty array for other languages."""
    term = F.replace(F.url_decode(F.split_part(uri, F.lit("/"), F.lit(4))), F.lit("_"), F.lit(" "))
    tokens = F.regexp_extract_all(F.lower(term), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    return F.when(language_of(uri) == "en", tokens).otherwise(F.array().cast("array<string>"))


def _strings(values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def flat_sources(metadata: Column) -> Column:
    """Sources as an array: a string alone, the strings of a list, or the string values of an object; else null."""
    found = F.try_variant_get(metadata, "$.sources", "variant")
    kind = F.schema_of_variant(found)
    return (
        F.when(kind == "STRING", F.array(F.try_variant_get(metadata, "$.sources", "string")))
        .when(kind.startswith("ARRAY"), _strings(F.try_variant_get(metadata, "$.sources", "array<variant>")))
        .when(kind.startswith("OBJECT"), _strings(F.map_values(F.try_variant_get(metadata, "$.sources", "map<string,variant>"))))
    )


def parse(lines: DataFrame) -> DataFrame:
    """Fields of each line and ``reason``: null, ``invalid`` or ``invalid_weight``.

    A weight must be a finite JSON number (a boolean or a string is none); metadata that is
    not an object, or has no weight, is an invalid weight; unreadable JSON is invalid.
    """
    parts = F.split("value", "\t", -1)
    variant = F.try_parse_json(F.get(parts, F.lit(4)))
    kind = F.schema_of_variant(F.try_variant_get(variant, "$.weight", "variant"))
    numeric = kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    weight = F.when(numeric, F.try_variant_get(variant, "$.weight", "double"))
    rows = lines.select(
        "*", F.size(parts).alias("n"), *[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(FIELDS[:4])],
        variant.isNotNull().alias("json_ok"), weight.alias("weight"),
        F.try_variant_get(variant, "$.dataset", "string").alias("dataset"), flat_sources(variant).alias("sources"),
        F.try_variant_get(variant, "$.license", "string").alias("license"),
    )
    finite = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") < float("inf"))
    reason = F.when((F.col("n") != 5) | ~F.col("json_ok"), "invalid").when(~finite, "invalid_weight")
    return rows.withColumn("reason", reason).drop("n", "json_ok")


def reject_reason(language: str | None = None, relations: Collection[str] = (), min_weight: float | None = None, datasets: Collection[str] = (), sources: Collection[str] = ()) -> Column:
    """The first failing filter, in fixed order; null when a record passes.

    A relation is given by name or full URI; an empty collection or language accepts all.
    """
    out = F.when(F.col("reason").isNotNull(), F.col("reason"))
    if language:
        same = (language_of(F.col("start_uri")) == language) & (language_of(F.col("end_uri")) == language)
        out = out.when(~F.coalesce(same, F.lit(False)), "language")
    if relations:
        out = out.when(~(relation_of(F.col("relation_uri")).isin(*relations) | F.col("relation_uri").isin(*relations)), "relation")
    if min_weight is not None:
        out = out.when(F.col("weight") < min_weight, "min_weight")
    if datasets:
        out = out.when(~F.coalesce(F.col("dataset").isin(*datasets), F.lit(False)), "dataset")
    if sources:
        out = out.when(~F.coalesce(F.arrays_overlap("sources", F.array(*map(F.lit, sources))), F.lit(False)), "source")
    return out


def scan(lines: DataFrame, fail_fast: bool = False, **filters) -> DataFrame:
    """Accepted records; with ``fail_fast`` the first malformed line raises with its number."""
    rows = parse(lines)
    if fail_fast:
        bad = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("malformed assertion, line "), (F.col("line_no") + 1).cast("string"))))
        rows = rows.withColumn("reason", F.coalesce(bad.cast("string"), F.col("reason")))
    return rows.filter(reject_reason(**filters).isNull()).drop("value", "reason")


def report(lines: DataFrame, **filters) -> DataFrame:
    """(reason, n): ``accepted`` and each reject reason."""
    return parse(lines).select(F.coalesce(reject_reason(**filters), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Raw lines of a subset, as text."""
    lines.select("value").write.mode("overwrite").text(path)
