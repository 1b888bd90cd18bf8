"""Join helpers: broadcast only behind a size check, shuffle join otherwise.

A side is broadcast when its rows and its bytes are proven below a bound: by what the
caller knows, or by writing the side once to the shared checkpoint folder, where its
rows and bytes can be read off the files -- and from where the join reads it, so a
derived dictionary is computed once.  Otherwise the join is a shuffle join on the key,
where AQE's skew-join handling splits oversized partitions of the large side at
runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows and bytes of a lookup table we are willing to ship to every executor.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20
UNPACKED = 4        # bytes in memory for a byte of a compressed file


def file_bytes(table: DataFrame) -> int:
    """The bytes of a table that is read from files, as the planner knows them."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, known_rows: int | None = None,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES, known_bytes: int | None = None) -> DataFrame:
    """Return ``broadcast(df)`` when its size is proven small, else the table to join as it is."""
    if known_rows is None:
        from ..session import cut_lineage
        df = cut_lineage(df, "lookup")
        known_rows, known_bytes = df.count(), file_bytes(df) * UNPACKED
    return F.broadcast(df) if known_rows <= max_rows and (known_bytes or 0) <= max_bytes else df


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
                max_rows: int = DEFAULT_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """Join a large table to a lookup table (dictionary, code map, model)."""
    return big.join(checked_broadcast(small, max_rows, known_rows), on=on, how=how)
