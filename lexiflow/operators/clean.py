"""Projection and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COUNT_BUCKETS


def select_by_position(df: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Columns by position (``stop=-2`` drops the two trailing targets)."""
    return df.select(*df.columns[start:stop])


def string_columns(df: DataFrame) -> list[str]:
    """P5: names of string-typed columns."""
    return [c for c, t in df.dtypes if t == "string"]


def strip(col) -> Column:
    """Python-style strip (all whitespace, including Unicode blanks)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def canonicalize(col, mapping: dict, null_value=None) -> Column:
    """P10: exact value replacements; nulls become ``null_value`` when given."""
    c = F.col(col) if isinstance(col, str) else col
    if mapping:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        c = F.coalesce(m[c], c)
    if null_value is not None:
        c = F.coalesce(c, F.lit(null_value))
    return c


def try_to(col, kind: str) -> Column:
    """Cast of a trimmed dirty string; NULL where it isn't of the type."""
    c = F.col(col) if isinstance(col, str) else col
    return strip(c.cast("string")).try_cast(kind)


def to_bool(col) -> Column:
    """Truthiness cast; NULL -> false, '0'/'false'/'' -> false."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.lower(strip(c.cast("string")))
    return F.when(c.isNull(), F.lit(False)).otherwise(
        ~s.isin("0", "false", "", "0.0", "f", "no"))


def count_bucket(col) -> Column:
    """{0} -> 0, {1} -> 1, [2,5) -> 2, [5,inf) -> 5; negatives and nulls -> null."""
    c = F.col(col) if isinstance(col, str) else col
    b0, b1, b2, b5 = COUNT_BUCKETS
    return (F.when(c == b0, b0).when(c == b1, b1).when((c >= b2) & (c < b5), b2)
            .when(c >= b5, b5))


def shift_label(col, by: int = -1) -> Column:
    """1-based to 0-based labels."""
    c = F.col(col) if isinstance(col, str) else col
    return c + by


def dedupe(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop duplicate rows (hash aggregation with map-side combine)."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    """P6."""
    return df.na.drop(subset=subset)


def fill_nulls(df: DataFrame, values) -> DataFrame:
    """A scalar for all compatible columns, or a per-column dict."""
    return df.na.fill(values)
