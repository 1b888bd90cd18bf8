"""Keyed hash used for every reproducible random choice (split, folds,
sampling, SMOTE).  It depends only on the key text, so results do not change
with partitioning and can be recomputed by any SQL engine with ``md5``.

``h(s) = int(first 8 hex digits of md5(s))``, a value in [0, 2^32).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(*parts) -> Column:
    """h(concat of parts joined by ':'), as bigint."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    s = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def key_part(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def in_test(key, seed: int, test_pct: int) -> Column:
    """F6 hash split: a row is in the test part when h(key:seed) % 100 < pct."""
    return (keyed_hash(key_part(key), seed) % 100) < test_pct


def unit_interval(*parts) -> Column:
    """A reproducible number in [0, 1): h(...) / 2^32."""
    return keyed_hash(*parts) / F.lit(4294967296.0)
