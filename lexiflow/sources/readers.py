"""Scans with fixed schemas (no inference pass), JSON records with defaults,
bounded reads and sinks.

Column pruning and filters reach the file scan because every reader returns a
plain DataFrame; callers ``select`` the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FLOW, REVIEW, REVIEW_DEFAULTS

REVIEW_ID_COLUMNS = ["review_id", "user_id", "business_id", "date"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver test table (one parquet file per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_reviews(spark: SparkSession, path, schema: T.StructType = REVIEW,
                 drop_ids: bool = False) -> DataFrame:
    """Newline-delimited JSON reviews; files are split by Spark, so the
    chunked read of the original needs no code.  Malformed lines become nulls."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.drop(*REVIEW_ID_COLUMNS) if drop_ids else df


def read_json_array(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """S3: one JSON array document per file (not splittable; one task per file)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_flows(spark: SparkSession, path, schema: T.StructType = FLOW,
               trim_leading_blanks: bool = True) -> DataFrame:
    """Header CSV with a fixed schema; optional trimming after delimiters."""
    return (spark.read.schema(schema).option("header", True)
            .option("ignoreLeadingWhiteSpace", trim_leading_blanks)
            .option("mode", "PERMISSIVE").csv(path))


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    """First n rows in a stated order (TakeOrderedAndProject: each task
    keeps n rows, the driver merges n x tasks rows)."""
    cols = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return df.orderBy(*cols).limit(n)


def tail(df: DataFrame, n: int, seq_col: str, ties) -> DataFrame:
    """Last n rows by a sequence column, newest first; ``ties`` are the columns
    that order rows with equal sequence values, so the result is determined."""
    return df.orderBy(F.col(seq_col).desc(), *[F.col(c).desc() for c in ties]).limit(n)


def decode_with_defaults(json_col, schema: T.StructType = REVIEW,
                         defaults: dict = REVIEW_DEFAULTS) -> Column:
    """Decode a JSON object into a struct; missing fields take defaults."""
    parsed = F.from_json(F.col(json_col) if isinstance(json_col, str) else json_col, schema)
    return F.struct(*[F.coalesce(parsed[f.name], F.lit(defaults[f.name]).cast(f.dataType))
                      .alias(f.name) if f.name in defaults else parsed[f.name].alias(f.name)
                      for f in schema.fields])


def encode_sorted_json(df: DataFrame, cols: list[str] | None = None) -> Column:
    """A JSON object with keys in sorted order."""
    names = sorted(cols or df.columns)
    return F.to_json(F.struct(*[F.col(c) for c in names]))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S8 sink: newline-delimited JSON, one file per partition."""
    df.write.mode(mode).json(path)
