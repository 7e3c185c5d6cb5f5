"""What the training-data operators share: table access and Column helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: white space between words.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Seed and primes of Spark's xxhash64.
SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: an expression inside a lambda is else evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def count_chars(text: Column, keep: str) -> Column:
    """Number of code points outside the negated class ``keep`` (like ``[^0-9]+``)."""
    return F.length(F.regexp_replace(text, keep, ""))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    high = x << np.uint64(by)
    x >>= np.uint64(64 - by)
    x |= high
    return x


def _avalanche(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x


def xxhash_long(values: np.ndarray, seed: np.ndarray | int = SEED) -> np.ndarray:
    """Spark's xxhash64 of longs, as unsigned numbers; ``seed`` is the hash of the columns before."""
    x = values.astype(np.int64, copy=False).view(np.uint64) * _P2
    x = _rotated(x, 31)
    x *= _P1
    x ^= np.asarray(seed, np.uint64) + (_P5 + np.uint64(8))
    x = _rotated(x, 27)
    x *= _P1
    x += _P4
    return _avalanche(x)


def xxhash_int(values: np.ndarray, seed: np.ndarray | int = SEED) -> np.ndarray:
    """Spark's xxhash64 of ints, as ``xxhash_long``; ``values`` and ``seed`` may be broadcast."""
    x = (values.astype(np.int64) & 0xFFFFFFFF).view(np.uint64) * _P1
    x = x ^ (np.asarray(seed, np.uint64) + (_P5 + np.uint64(4)))
    x = _rotated(x, 23)
    x *= _P2
    x += _P3
    return _avalanche(x)
