"""Reproducible splitting, folds and class rebalancing.

Every random choice is the keyed md5 hash of (key, seed), so a result is the
same under any partitioning and is reproducible by any SQL engine.  Ranks
inside a class use the distributed ``rank_within`` (a class may hold a third
of all rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import in_test, keyed_hash
from .ranking import rank_within, top_k_per_group


def hash_split(df: DataFrame, key: str, seed: int = 0, test_pct: int = 20):
    """(train, test) split; a row is test when h(key:seed) % 100 < pct."""
    t = in_test(key, seed, test_pct)
    return df.where(~t), df.where(t)


def with_split(df: DataFrame, key: str, seed: int = 0, test_pct: int = 20,
               col: str = "is_test") -> DataFrame:
    return df.withColumn(col, in_test(key, seed, test_pct))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0,
                     col: str = "fold") -> DataFrame:
    """fold = (rank of h(key:seed) inside the class) mod k — every fold
    gets each class in equal shares (+-1)."""
    h = df.withColumn("_h", keyed_hash(F.col(key), seed))
    r = rank_within(h, [label], [F.col("_h"), F.col(key)], "_r")
    return r.withColumn(col, (F.col("_r") % k).cast("int")).drop("_h", "_r")


def undersample(df: DataFrame, key: str, label: str, targets: dict, seed: int = 0) -> DataFrame:
    """keep the n rows with the smallest h(key:seed) of each listed class;
    other classes are untouched; a class smaller than n is kept whole."""
    listed = df.where(F.col(label).isin(*targets.keys()))
    rest = df.where(~F.col(label).isin(*targets.keys()) | F.col(label).isNull())
    lim = F.create_map(*[x for c, n in targets.items() for x in (F.lit(c), F.lit(int(n)))])
    h = listed.withColumn("_h", keyed_hash(F.col(key), seed))
    most = max((int(n) for n in targets.values()), default=0)
    r = top_k_per_group(h, [label], [F.col("_h"), F.col(key)], most, "_r", salt_on=F.xxhash64(key))
    kept = r.where(F.col("_r") <= lim[F.col(label)]).drop("_h", "_r")
    return kept.unionByName(rest)
