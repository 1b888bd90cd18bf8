"""Registered queries of the sources that look at files: last lines by position, and the
second output of a checked read.  The files are written by Spark from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import keyed_hash
from ..sources.checked import issue_counts, read_csv_checked, read_json_checked
from ..sources.line_tail import tail_lines
from ..sources.readers import read_table
from ..streaming.incremental_nb import scratch_folder
from .sqltext import keyed_hash as hash_sql

LAST = 300


def newest_lines(spark, sf):
    """S7 by file position: the last 300 lines of the events' files, newest first (the
    limit is the operator)."""
    path = scratch_folder(spark, "event-lines")
    ev = read_table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type"))
                                                .alias("value"))
    ev.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return tail_lines(spark, path, LAST).select("place", "value")


def newest_lines_sql():
    return f"""SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS place,
  '{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS value
FROM events QUALIFY place < {LAST}"""


ORDER = T.StructType([T.StructField("key", T.LongType()), T.StructField("total", T.DoubleType()),
                      T.StructField("day", T.DateType()), T.StructField("status", T.StringType())])


def _dirty(spark, sf):
    """Orders as text, some values and lines of it damaged by the hash of the key."""
    h = keyed_hash(F.col("o_orderkey"), "dirty") % 20
    return read_table(spark, sf, "orders").select(
        h.alias("h"), F.when(h == 1, F.lit("k?")).otherwise(F.col("o_orderkey").cast("string")).alias("key"),
        F.when(h == 2, F.lit("12,5")).when(h == 3, F.lit("")).otherwise(F.format_string("%.2f", F.col("o_totalprice").cast("double")))
        .alias("total"),
        F.when(h.isin(2, 4), F.lit("yesterday")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.concat(F.lit(" "), F.col("o_orderstatus")).alias("status"))


def read_issues(spark, sf):
    """S1 + S5 + P11: what didn't fit, by format, column and reason, and the rows that did."""
    root, d = scratch_folder(spark, "dirty"), _dirty(spark, sf)
    line = F.concat_ws(";", "key", "total", "day", "status")
    d.select(F.when(F.col("h") == 5, F.lit("cut;short")).otherwise(line)).write.text(f"{root}/csv")
    record = F.to_json(F.struct("key", "total", "day", "status"))
    d.select(F.when(F.col("h") == 5, F.lit('{"key": 1, "total')).otherwise(record)).write.text(f"{root}/json")
    out = None
    for kind, (rows, issues) in {"csv": read_csv_checked(spark, f"{root}/csv", ORDER, header=False, sep=";"),
                                 "json": read_json_checked(spark, f"{root}/json", ORDER)}.items():
        per_file = issue_counts(issues).groupBy("column", "reason").agg(F.sum("n").alias("n"))
        fit = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))
        part = per_file.withColumn("total", F.lit(None).cast("double")).unionByName(
            fit.select(F.lit(None).cast("string").alias("column"), F.lit("fits").alias("reason"), "n", "total"))
        part = part.withColumn("format", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select("format", "column", "reason", F.col("n").cast("bigint").alias("n"), "total")


def read_issues_sql():
    h = hash_sql("CAST(o_orderkey AS VARCHAR) || ':dirty'")
    return f"""WITH d AS (SELECT {h} % 20 AS h, o_totalprice::DOUBLE AS total FROM orders),
f AS (SELECT unnest(['csv', 'json']) AS format),
i AS (SELECT NULL::VARCHAR AS column, 'malformed' AS reason, count(*) FILTER (h = 5) AS n FROM d
  UNION ALL SELECT 'key', 'not a bigint', count(*) FILTER (h = 1) FROM d
  UNION ALL SELECT 'total', 'not a double', count(*) FILTER (h = 2) FROM d
  UNION ALL SELECT 'day', 'not a date', count(*) FILTER (h IN (2, 4)) FROM d)
SELECT format, "column", reason, n::BIGINT AS n, NULL::DOUBLE AS total FROM i, f WHERE n > 0
UNION ALL SELECT format, NULL, 'fits', count(*) FILTER (h <> 5)::BIGINT,
  round(sum(round(total, 2)) FILTER (h NOT IN (2, 3, 5)), 2) FROM d, f GROUP BY format"""


SQL = {"newest_lines": newest_lines_sql, "read_issues": read_issues_sql}
