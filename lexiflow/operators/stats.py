"""Correlation analysis and feature selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unpivot(row_df: DataFrame, names: list[str], value: str) -> DataFrame:
    return row_df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"_{i}").alias(value))
        for i, n in enumerate(names)])).alias("e")).select("e.*")


def corr_with_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson correlation of every feature with the target, one pass."""
    r = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f"_{i}")
                 for i, f in enumerate(features)])
    return _unpivot(r, features, "corr")


def cov_with_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Sample covariance of every feature with the target, one pass."""
    r = df.agg(*[F.covar_samp(F.col(f).cast("double"), F.col(target).cast("double"))
                 .alias(f"_{i}") for i, f in enumerate(features)])
    return _unpivot(r, features, "cov")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Full correlation matrix in long form (a, b, corr).

    Rows with a null in any listed column are dropped (listwise, as MLlib's
    ``Correlation``).  Pass 1: column means.  Pass 2: n, sums and centred
    cross products of all pairs as plain sums in one aggregation (keeps
    whole-stage codegen).  The result row is bounded by the column count, so
    the matrix is assembled on the driver."""
    spark = df.sparkSession
    x = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).na.drop()
    k = len(cols)
    means = x.agg(*[F.avg(f"_{i}").alias(f"m{i}") for i in range(k)]).first()
    cen = x.select(*[(F.col(f"_{i}") - F.lit(means[f"m{i}"] or 0.0)).alias(f"_{i}")
                     for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = cen.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_{i}").alias(f"s{i}") for i in range(k)],
                *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = r["n"]

    def cov(i, j):
        a, b = (i, j) if i <= j else (j, i)
        return r[f"p{a}_{b}"] - r[f"s{i}"] * r[f"s{j}"] / n
    rows = []
    for i in range(k):
        for j in range(k):
            c = None
            if n:
                cxx, cyy = cov(i, i), cov(j, j)
                c = cov(i, j) / math.sqrt(cxx * cyy) if cxx > 0 and cyy > 0 else None
            rows.append((cols[i], cols[j], c))
    return spark.createDataFrame(rows, "a string, b string, corr double")


def top_n(scores: DataFrame, value: str, n: int, exclude: list[str] | None = None) -> DataFrame:
    """The n features with the largest score (ties by name)."""
    s = scores.where(~F.col("feature").isin(*(exclude or []))) if exclude else scores
    return s.orderBy(F.col(value).desc(), F.col("feature")).limit(n)


def above(scores: DataFrame, value: str, threshold: float,
          exclude: list[str] | None = None) -> DataFrame:
    """T4: features whose (signed) score exceeds a threshold."""
    s = scores.where(~F.col("feature").isin(*(exclude or []))) if exclude else scores
    return s.where(F.col(value) > threshold)


def cumulative(df: DataFrame, order_col: str, value: str, out: str = "cumulative",
               round_to: int | None = None) -> DataFrame:
    """Running sum in a stated order (one small table, e.g. explained variance)."""
    v = F.round(F.col(value), round_to) if round_to is not None else F.col(value)
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(v).over(w))
