"""Structured Streaming: running counts that equal the batch answer on the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir


def stream_table(spark: SparkSession, path: str, max_files: int = 4) -> DataFrame:
    """A file-source stream of Parquet files; ``max_files`` a trigger is the back-pressure."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(path if not name.endswith(".parquet") or _is_dir(spark, path) else folder)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Event-time windows by type: count and sum, late rows dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run_to_end(df: DataFrame) -> DataFrame:
    """Process all there is and return the final state of the aggregate."""
    spark = df.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{scratch_dir(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def running_report(lines: DataFrame, **filters) -> DataFrame:
    """(reason, n) of a stream of assertion lines: the running form of ``assertions.report``."""
    from ..sources import assertions

    return assertions.report(lines.withColumn("line_no", F.lit(0).cast("long")), **filters)


def upsert_counts(stream: DataFrame, key: str, folder: str) -> None:
    """Keep counts of ``key`` for a stream in ``folder``, a Parquet part for each batch of files.

    A part is named after its batch and rewritten when the batch is run again, so a restart
    neither loses nor repeats rows. ``read_counts`` adds the parts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def read_counts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/parts").groupBy(key).agg(F.sum("n").alias("n"))
