"""Ranking that never puts a whole group into one task.

* ``top_k_per_group``: top-k rows per group.  Rows are first ranked inside
  (group, salt) sub-groups and cut to k, so a group holding a third of all rows
  is split over ``salt_buckets`` tasks; only k * salt_buckets rows per group
  reach the final ranking.
* ``rank_within`` / ``global_index``: dense 0-based index inside a group or
  in a global order (factorise codes, folds, vocabulary ids).  Range-partitions
  on (group, order), numbers rows inside each range by position, and adds the
  counts of the same group in earlier ranges.  No step sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import DEFAULT_BROADCAST_ROWS


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int,
                    rank_col: str = "rank", salt_buckets: int = 32,
                    salt_on: Column | None = None) -> DataFrame:
    """Keep the first ``k`` rows of each group in ``order_cols`` order (ties must be
    broken by the caller's order columns), numbered 1..k in ``rank_col``."""
    group = _cols(group_cols)
    order = _cols(order_cols)
    salt_src = salt_on if salt_on is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    salted = df.withColumn("_salt", F.pmod(salt_src, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, F.col("_salt")).orderBy(*order)
    local = salted.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (local.drop("_rn", "_salt")
            .withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= k))


def rank_within(df: DataFrame, group_cols, order_cols, index_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based index of each row inside its group (or globally when
    ``group_cols`` is empty), following ``order_cols`` (unique within a group).

    One range exchange on (group, order) with rows sorted inside each range;
    a row's position in its range comes from the row counter of
    ``monotonically_increasing_id`` (no window, so no second shuffle).  The
    ranged rows are written once to the shared checkpoint folder: the
    offsets must describe exactly the partitioning the rows got, and a
    re-executed range exchange may sample different bounds.  The offsets
    table -- per (range, group) the first position and the count of the
    group in earlier ranges -- has at most ranges + groups - 1 rows and is
    broadcast when that is proven, so no task ever holds a whole group."""
    from ..session import cut_lineage
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = _cols(group_cols or [])
    order = _cols(order_cols)
    gnames = list(group_cols or [])
    pid = F.spark_partition_id()
    ranged = (df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
              .withColumn("_rk_pid", pid)
              .withColumn("_rk_pos", F.monotonically_increasing_id()
                          - F.shiftleft(pid.cast("bigint"), 33)))
    ranged = cut_lineage(ranged, "rank")
    firsts = ranged.groupBy("_rk_pid", *gnames).agg(F.min("_rk_pos").alias("_rk_first"),
                                                  F.count(F.lit(1)).alias("_rk_n"))
    wo = (Window.partitionBy(*gnames) if gnames else Window.partitionBy()).orderBy("_rk_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.select(*[F.col(c).alias(f"_rk_g{i}") for i, c in enumerate(gnames)],
                            F.col("_rk_pid").alias("_rk_opid"), "_rk_first",
                            F.coalesce(F.sum("_rk_n").over(wo), F.lit(0)).alias("_rk_off"))
    if offsets.count() <= DEFAULT_BROADCAST_ROWS:   # one number per task, never rows
        offsets = F.broadcast(offsets)
    cond = F.col("_rk_pid") == F.col("_rk_opid")
    for i, c in enumerate(gnames):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_rk_g{i}"))   # null is a group too
    return (ranged.join(offsets, cond)
            .withColumn(index_col, F.col("_rk_off") + F.col("_rk_pos") - F.col("_rk_first"))
            .drop("_rk_pid", "_rk_pos", "_rk_opid", "_rk_first", "_rk_off", *[f"_rk_g{i}" for i in range(len(gnames))]))


def global_index(df: DataFrame, order_cols, index_col: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based index in a global order (``order_cols`` unique)."""
    return rank_within(df, [], order_cols, index_col, num_partitions)
