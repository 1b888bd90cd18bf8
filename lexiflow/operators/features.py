"""Feature engineering (F1-F5, F9): factorise, scale, TF-IDF, assemble.

Fitted statistics are computed in one aggregation (R6) and collected only
when bounded by the number of columns or dimensions; code maps are tables
joined back (broadcast under a row bound).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import DEFAULT_BROADCAST_ROWS, UNPACKED, checked_broadcast, file_bytes
from .ranking import rank_within

MAX_DIMS = 100_000


# ------------------------------------------------------------------ F1 factorise

def fit_factorize(df: DataFrame, cols: list[str], order_cols) -> DataFrame:
    """Codes by first appearance for several columns in one pass:
    (column, value, code).  ``order_cols`` define "first" (file order is not a
    Spark notion).  Ties of first position are broken by the value.

    Firsts are found one order column after the other -- the least value of the first
    column, among those rows the least of the second -- so every step is a hash
    aggregation on (column, value) with map-side combine."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                     F.col(c).cast("string").alias("value")) for c in cols]))
    names = [f"_o{i}" for i in range(len(order))]
    each = (df.select(e.alias("e"), *[c.alias(n) for c, n in zip(order, names)]).select("e.*", *names)
            .where(F.col("value").isNotNull()))
    firsts = None
    for i, n in enumerate(names):
        seen = each
        if firsts is not None:
            firsts = cut_lineage(firsts, "firsts")            # read twice: here and for the result
            known = checked_broadcast(
                firsts.select(F.col("column").alias("_c"), F.col("value").alias("_v"),
                              *[F.col(x).alias(f"_f{x}") for x in names[:i]]),
                known_rows=firsts.count(), known_bytes=file_bytes(firsts) * UNPACKED)
            same = [F.col("column") == F.col("_c"), F.col("value") == F.col("_v")]
            same += [F.col(x).eqNullSafe(F.col(f"_f{x}")) for x in names[:i]]
            seen = each.join(known, reduce(lambda a, b: a & b, same), "left_semi")
        # no position at all comes first, as nulls do in an ascending order
        found = seen.groupBy("column", "value").agg(F.min(n).alias(n), F.max(F.col(n).isNull()).alias("_null"))
        found = found.select("column", "value", F.when(~F.col("_null"), F.col(n)).alias(n))
        firsts = found if firsts is None else firsts.join(found, ["column", "value"])
    coded = rank_within(firsts, ["column"], [*[F.col(n) for n in names], F.col("value")], "code")
    codes = cut_lineage(coded.select("column", "value", F.col("code").cast("bigint").alias("code")), "codes")
    return codes


def code_sizes(codes: DataFrame) -> dict:
    """column -> (codes, bytes), one job for all columns, remembered with the table."""
    if not hasattr(codes, "_code_sizes"):
        rows = codes.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 40).alias("b"))
        codes._code_sizes = {r["column"]: (r["n"], r["b"]) for r in rows.collect()}          # one row a column
    return codes._code_sizes


def apply_factorize(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "",
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Replace each column by its code; null and unseen values -> -1.  Columns whose codes
    are proven small meet them in the scan's pipeline, the others in a shuffle join."""
    out, sizes = df, code_sizes(codes)
    for c in cols:
        n, size = sizes.get(c, (0, 0))
        m = codes.where(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        m = checked_broadcast(m, max_broadcast_rows, known_rows=n, known_bytes=size)
        out = (out.join(m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
               .withColumn(c + suffix, F.coalesce(F.col(f"_c_{c}"), F.lit(-1).cast("bigint")))
               .drop(f"_v_{c}", f"_c_{c}"))
    return out


# ------------------------------------------------------------- F2 / F3 scalers

def fit_scaler(df: DataFrame, cols: list[str]) -> dict:
    """min, max, mean, population std of every column, one aggregation."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                 F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    row = df.agg(*aggs).first()
    return {c: {k: row[f"{c}__{k}"] for k in ("min", "max", "mean", "std")} for c in cols}


def minmax_expr(col, lo, hi) -> Column:
    """(x - min) / (max - min); 0 for a constant column."""
    c = F.col(col) if isinstance(col, str) else col
    if lo is None or hi is None or hi == lo:
        return F.when(c.isNull(), None).otherwise(F.lit(0.0))
    return (c - F.lit(lo)) / F.lit(hi - lo)


def standard_expr(col, mean, std) -> Column:
    """(x - mean) / std_pop; 0 when the deviation is 0."""
    c = F.col(col) if isinstance(col, str) else col
    if mean is None or not std:
        return F.when(c.isNull(), None).otherwise(F.lit(0.0))
    return (c - F.lit(mean)) / F.lit(std)


def minmax_scale(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    st = stats or fit_scaler(df, cols)
    return df.select(*[minmax_expr(c, st[c]["min"], st[c]["max"]).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    st = stats or fit_scaler(df, cols)
    return df.select(*[standard_expr(c, st[c]["mean"], st[c]["std"]).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def fit_array_scaler(df: DataFrame, col: str) -> DataFrame:
    """Per-dimension statistics of an array column: (dim, min, max, mean, std)."""
    return (df.select(F.posexplode(col).alias("dim", "x"))
            .groupBy("dim").agg(F.min("x").cast("double").alias("min"),
                                F.max("x").cast("double").alias("max"),
                                F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")))


def array_stats_literals(stats: DataFrame) -> dict:
    """Collect per-dimension statistics (bounded by the dimension count)."""
    rows = stats.orderBy("dim").limit(MAX_DIMS + 1).collect()
    if len(rows) > MAX_DIMS:
        raise ValueError("too many dimensions")
    return {k: [r[k] for r in rows] for k in ("min", "max", "mean", "std")}


def scale_array(col, stats: dict, kind: str = "minmax") -> Column:
    """Scale every element of an array column with per-dimension statistics."""
    c = F.col(col) if isinstance(col, str) else col
    if kind == "minmax":
        shift = [lo for lo in stats["min"]]
        div = [(hi - lo) for lo, hi in zip(stats["min"], stats["max"])]
    else:
        shift = list(stats["mean"])
        div = [s or 0.0 for s in stats["std"]]
    sh = F.array(*[F.lit(float(x)) for x in shift])
    dv = F.array(*[F.lit(float(x)) for x in div])
    return F.transform(c, lambda x, i: F.when(dv[i] == 0, F.lit(0.0))
                       .otherwise((x.cast("double") - sh[i]) / dv[i]))


# -------------------------------------------------------------------- F4 TF-IDF

def tfidf_long(df: DataFrame, id_col: str, tokens_col: str,
               max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(id, token, tf, weight): raw counts, smoothed idf ln((1+n)/(1+df)) + 1,
    rows L2-normalised.  The text is tokenised once, into a stored (id, token, tf)
    table; the idf table (one row per token) is broadcast only under a row bound."""
    tf = (df.select(id_col, F.explode_outer(tokens_col).alias("token")).where(F.col("token").isNotNull())
          .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf")))
    tf = cut_lineage(tf, "tf")
    n_docs = df.select(F.count(F.lit(1))).scalar()
    idf = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select(
        "token", (F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = tf.join(checked_broadcast(idf, max_broadcast_rows), "token").withColumn(
        "w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "token", "tf", (F.col("w") / norm).alias("weight"))


# ------------------------------------------------------------------ F9 assemble

def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """numeric columns into one ML vector column (MLlib input)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def array_to_vector(col) -> Column:
    from pyspark.ml.functions import array_to_vector as a2v
    return a2v(F.col(col) if isinstance(col, str) else col)
