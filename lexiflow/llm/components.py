"""Connected components of a link table by alternating large-star and
small-star steps: every step is a min-aggregation (combined map-side, so a hub
with a third of all links is one partial row per task) and an equi-join whose
skewed partitions adaptive execution splits.  Each step is written to the
shared checkpoint folder; nothing is collected but two numbers.  Tables of at
most ``FEW`` links (a few MB) are stepped as one partition, without exchanges,
and their result is small enough to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

FEW = 1 << 18


def _fingerprint(df: DataFrame):
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _both(df: DataFrame, other: str) -> DataFrame:
    """The rows (u, v) and (v, ``other``) of each link, in the partitions of the links."""
    return df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col(other).alias("v"))))
                     .alias("x")).select("x.u", "x.v")


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) -> (u, v): every linked node u with the smallest node v
    reachable from it (v itself included).  No links: an empty table."""
    cur = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    few = cur.limit(FEW + 1).count() <= FEW
    cur = scratch.cut((cur.coalesce(1) if few else cur).distinct(), "cc")
    seen = _fingerprint(cur)
    while seen[0]:
        both = _both(cur.coalesce(1) if few else cur, "u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        large = (large.coalesce(1) if few else large).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))))
        nxt = scratch.cut((small.coalesce(1) if few else small).distinct(), "cc")
        now = _fingerprint(nxt)
        scratch.drop(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    if few:
        return scratch.cut(_both(cur.coalesce(1), "v").distinct(), "comp").hint("broadcast")
    return _both(cur, "v").distinct()
