"""Candidates that the spanning trees of large buckets leave out."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import nearcopies


@pytest.mark.parametrize("tree", [2048, 5])
def test_pairs_outside_of_trees_follow(spark, monkeypatch, tree):
    """Twelve fingerprints of one bucket: trees and rest give all pairs, none once all are linked."""
    monkeypatch.setattr(nearcopies, "TREE", tree)
    random = np.random.default_rng(2)
    f0 = [int(sum(1 << int(b) for b in random.choice(62, 7, replace=False))) for _ in range(12)]
    classes = spark.createDataFrame([(i, f, 5, 9, 100) for i, f in enumerate(f0)], "id long, f0 long, f1 long, f2 long, n int")
    want = {(i, j) for i, j in itertools.combinations(range(12), 2) if (f0[i] ^ f0[j]).bit_count() <= nearcopies.FIRST_BITS}
    pairs = nearcopies.near_pairs(classes).cache()
    edges = nearcopies.candidates(classes, pairs).cache()
    first = {(r["a"], r["b"]) for r in edges.collect()}
    rest = nearcopies.remaining(classes, pairs, edges, None).collect()
    assert first < want and first | {(r["a"], r["b"]) for r in rest} == want
    linked = spark.createDataFrame([(0, i) for i in range(1, 12)], "a long, b long")
    assert nearcopies.remaining(classes, pairs, edges, linked).count() == 0


@pytest.mark.parametrize("tile", [512, 3])
def test_texts_without_links_make_no_row_for_a_pair(spark, monkeypatch, tile):
    """A group of texts that are near each other, of which few are alike: all links of the plain form, and few rows."""
    monkeypatch.setattr(nearcopies, "TILE", tile)
    random = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in range(100)).split() for _ in range(30)]
    for k, text in enumerate(texts):
        for at in random.choice(100, 3 + k % 4, replace=False):
            text[at] = f"x{k // 2}" if k % 2 else f"y{k}"
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    classes = nearcopies._classes(docs).cache()
    # one fingerprint, so that all pairs are candidates
    classes = classes.withColumns({f"f{i}": F.lit(7 + i).cast("long") for i in range(3)}).cache()
    ids = {r["id"]: r["least"]["doc_id"] for r in classes.collect()}
    pairs = nearcopies.near_pairs(classes).cache()
    sets = [nearcopies.shingle_set(" ".join(t))[1] for t in texts]
    alike = {(i, j) for i, j in itertools.combinations(range(30), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    got = [(ids[r["a"]], ids[r["b"]]) for r in nearcopies.remaining_links(docs, classes, pairs, None).collect()]
    assert {tuple(sorted(x)) for x in got} <= alike

    def groups(links):
        forest = nearcopies._Forest()
        for a, b in links:
            forest.join(a, b)
        return {frozenset(i for i in range(30) if forest.find(i) == r) for r in map(forest.find, range(30))}

    assert groups(got) == groups(alike) and 1 < len(groups(alike))
    edges = nearcopies.candidates(classes, pairs)
    plain = nearcopies.remaining(classes, pairs, edges, None).count()
    filed = classes.select("id", "f0", "f1", "f2", F.col("id").alias("root")).mapInArrow(nearcopies._file(4, True), "bucket int, blob binary")
    meeting = nearcopies._bucketed(filed, 4).mapInArrow(nearcopies._meeting, "ra long, rb long").distinct()
    assert plain > 300 and nearcopies.components(meeting, "ra", "rb").select("root").distinct().count() == 1


def _met(spark, rows, passes=1):
    rooted = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, root long")
    found = []
    for turn in range(passes):
        filed = rooted.mapInArrow(nearcopies._file(4, True, turn, passes), "bucket int, blob binary")
        found += nearcopies._bucketed(filed, 4).mapInArrow(nearcopies._meeting, "ra long, rb long").collect()
    return {tuple(sorted((r["ra"], r["rb"]))) for r in found}


@pytest.mark.parametrize("passes", [1, 7])
def test_texts_near_in_64_bits_only_meet_in_no_region(spark, passes):
    """Buckets filled by chance: of their members only those near in the whole fingerprint connect components."""
    random = np.random.default_rng(6)
    far = [tuple(int(x) for x in random.integers(-(1 << 62), 1 << 62, 2)) for _ in range(40)]
    rows = [(i, 5 ^ (1 << i % 40), *f, i) for i, f in enumerate(far)]
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if sum((a & (1 << 64) - 1 ^ b & (1 << 64) - 1).bit_count() for a, b in zip(rows[i][1:4], rows[j][1:4], strict=True)) <= nearcopies.ALL_BITS}
    assert not want and not _met(spark, rows, passes)
    near = [(40 + i, r[1], r[2] ^ 7, r[3], 40 + i) for i, r in enumerate(rows[:3])]
    assert _met(spark, rows + near, passes) == {(i, 40 + i) for i in range(3)}


def test_common_elements_in_parts(monkeypatch):
    monkeypatch.setattr(nearcopies, "COLUMNS", 7)
    random = np.random.default_rng(5)
    a, b = ([np.unique(random.integers(0, 60, random.integers(0, 50))).astype(np.uint64) for _ in range(n)] for n in (9, 5))
    assert nearcopies.common(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
