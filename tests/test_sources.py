import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from tessella.sources import assertions as A

META = '{"weight": %s, "dataset": "/d/garden", "sources": ["/s/notes", "/s/atlas"], "license": "own"}'
LINES = [
    "/row/10\t/r/GrowsIn\t/c/en/oak/n\t/c/en/clay_soil\t" + META % "4.5",
    "/row/11\t/r/GrowsIn\t/c/fr/vigne\t/c/fr/coteau\t" + META % "6.0",
    "/row/12\t/r/NeedsTool\t/c/en/hedge\t/c/en/shears\t" + META % "0.5",
    "/row/13\t/r/NeedsTool\t/c/en/lawn\t/c/en/mower\t" + META % "3.0",
    "/row/14\t/r/GrowsIn\t/c/en/heather\t/c/en/peat\t" + META % "0.25",
]


def of(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")


def counts(df):
    return {r["reason"]: r["n"] for r in df.collect()}


def test_filters_in_order(spark):
    rows = of(spark, LINES)
    assert counts(A.report(rows, language="en", relations={"GrowsIn"}, min_weight=1.0)) == {"accepted": 1, "language": 1, "relation": 2, "min_weight": 1}
    assert counts(A.report(rows, relations={"/r/NeedsTool", "Other"})) == {"accepted": 2, "relation": 3}
    assert counts(A.report(rows, datasets={"/d/kitchen"}, language="fr")) == {"dataset": 1, "language": 4}
    assert counts(A.report(rows, sources={"/s/atlas"}, min_weight=0.5)) == {"accepted": 4, "min_weight": 1}
    assert counts(A.report(rows, sources={"/s/none"})) == {"source": 5}


@pytest.mark.parametrize(("meta", "reason"), [('{"weight": true}', "invalid_weight"), ('{"weight": "1"}', "invalid_weight"), ('{"weight": 1e400}', "invalid_weight"), ("[]", "invalid_weight"), ("{}", "invalid_weight"), ("{", "invalid"), ('{"weight": 3}', "accepted")])
def test_weights(spark, meta, reason):
    assert counts(A.report(of(spark, ["/a\t/r/X\t/c/en/a\t/c/en/b\t" + meta]))) == {reason: 1}


def test_malformed(spark):
    rows = of(spark, [*LINES, "three\tfields\tonly"])
    assert A.scan(rows).count() == 5
    with pytest.raises(Exception, match="line 6"):
        A.scan(rows, fail_fast=True).collect()


@pytest.mark.parametrize(("suffix", "pack"), [("", bytes), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress)])
def test_codecs_and_row_limit(spark, tmp_path, suffix, pack):
    path = tmp_path / f"a.tsv{suffix}"
    path.write_bytes(pack("\n".join(LINES).encode() + b"\n"))
    lines = A.read_lines(spark, str(path))
    assert A.scan(lines, relations={"GrowsIn"}).count() == 3
    assert sorted(r["value"] for r in A.read_lines(spark, str(path), max_rows=2).collect()) == sorted(LINES[:2])


def test_zip_is_refused(spark):
    with pytest.raises(ValueError, match="ambiguous"):
        A.read_lines(spark, "a.zip")


def test_tokens(spark):
    df = spark.createDataFrame([("/c/en/new_york's%20cafe/n",), ("/c/es/perro",), (None,)], "uri string")
    got = [r[0] for r in df.select(F.array_join(A.node_tokens(F.col("uri")), " ")).collect()]
    assert got[:2] == ["new york's cafe", ""]
