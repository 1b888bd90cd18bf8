"""Reads that keep what doesn't fit: a second output for malformed rows and values
(S1, S5, P11).

The first output has the rows that fit the schema, cast.  The second, ``issues``, has
one row per problem: (file, column, reason, value).  A line that is no record at all has
the reason ``malformed`` and no column; a value that isn't of its column's type has the
reason ``not a <type>``, and stays null in the first output.  Both come from one plan
over the files; nothing is dropped unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import strip, try_to
from ..schemas import FLOW

CORRUPT = "_malformed"


def _as_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])


def _checked(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of a read whose columns are strings."""
    def quoted(f):
        return F.col(f"`{f.name}`")

    fits = F.col(CORRUPT).isNull()
    rows = raw.where(fits).select(*[quoted(f) if isinstance(f.dataType, T.StringType)
                                    else try_to(quoted(f), f.dataType.simpleString()).alias(f.name) for f in schema.fields])
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    found = [F.struct(F.lit(None).cast("string").alias("column"), F.lit("malformed").alias("reason"),
                      F.col(CORRUPT).alias("value"), ~fits)]
    for f in typed:
        kind = f.dataType.simpleString()
        bad = fits & (strip(quoted(f)) != "") & try_to(quoted(f), kind).isNull()
        found.append(F.struct(F.lit(f.name).alias("column"), F.lit(f"not a {kind}").alias("reason"),
                              quoted(f).alias("value"), F.coalesce(bad, F.lit(False))))
    each = F.explode(F.filter(F.array(*[s.cast("struct<column:string,reason:string,value:string,is:boolean>") for s in found]),
                              lambda x: x["is"]))
    issues = raw.select(F.col("_metadata.file_path").alias("file"), each.alias("e")).select(
        "file", "e.column", "e.reason", "e.value")
    return rows, issues


def read_json_checked(spark: SparkSession, path, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Newline-delimited JSON as (rows, issues).  Missing fields are null and no
    issue; nested values come as their JSON text."""
    raw = (spark.read.schema(_as_strings(schema)).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return _checked(raw, schema)


def read_csv_checked(spark: SparkSession, path, schema: T.StructType, header: bool = True,
                     sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """CSV as (rows, issues).  A line with more or fewer fields than the schema is
    malformed; blanks around a value are no issue, and an empty value is null."""
    raw = (spark.read.schema(_as_strings(schema)).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
           .option("ignoreLeadingWhiteSpace", True).option("columnPruning", False)    # else short lines pass
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return _checked(raw, schema)


def read_flows_checked(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Flow records as (rows, issues): dirty numbers are null in the rows and told apart
    from missing ones in the issues."""
    return read_csv_checked(spark, path, FLOW)


def issue_counts(issues: DataFrame) -> DataFrame:
    """(file, column, reason, n), one aggregation."""
    return issues.groupBy("file", "column", "reason").agg(F.count(F.lit(1)).alias("n"))
