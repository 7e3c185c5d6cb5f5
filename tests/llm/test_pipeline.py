"""The pipeline's stages, one after another, against their operators' brute-force versions."""

import collections

import corpus_pipeline as P
from tests.llm.cases import empty, hard
from tests.llm.test_operators import SF, near_groups_brute, quality_brute


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = P.quality_rules(spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    assert kept and not any(quality_brute(texts[d])[5] for d in kept)
    unique = P.near_dedup(spark, good, SF)
    assert {r["doc_id"] for r in unique.collect()} == set(near_groups_brute({d: texts[d] for d in kept}).values())
    clean = P.surrogates(spark, unique, SF)
    mixed = P.source_mix(spark, clean, SF)
    for df in (good, unique, clean, mixed):
        assert df.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    tokens = collections.Counter()
    for r in P.packed(spark, mixed, SF).collect():
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == set(copies)
    assert sum(r["length"] for r in P.run(spark, SF).collect()) == sum(tokens.values())


def test_hard_cases(spark):
    for docs in (hard(spark), empty(spark)):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == columns
        docs.collect()
