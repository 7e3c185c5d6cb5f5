import time

from pyspark.sql import functions as F

from tessella.session import materialize


def test_materialize_leaves_no_shuffle_files(spark):
    """The shuffle files behind a written table go at once, without the driver's garbage collection."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = manager.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    out = materialize(df)
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 7 and df.count() == 7  # and the query can run again
