"""Operator 13: a plain tree over lists, odd rows, hot groups, and tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from edge import TEXTS, documents
from lexiflow.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest("".join(row[i:i + 2])) for i in range(0, len(row), 2)])
    return levels


def path(levels, pos):
    out = []
    for row in levels[:-1]:
        out.append((pos & 1, row[pos ^ 1] if pos ^ 1 < len(row) else ""))
        pos >>= 1
    return out


def brute(rows):
    by = {}
    for r in rows:
        v = [r[c] for c in FIELDS]
        other = list(v)
        if None not in (v[0], v[3]) and zlib.crc32(str(v[0]).encode()) % 7 == 0:
            other[3] += 1
        by.setdefault(r["lang"], []).append((v[0] is not None, v[0] or 0, leaf_of(v), leaf_of(other), v[0]))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(by[n], key=lambda x: x[:3])]) for n in names]
    top = tree([t[-1][0] for t in trees])
    for i, n in enumerate(names):
        for pos, x in enumerate(sorted(by[n], key=lambda x: x[:3])):
            steps, h = path(trees[i], pos) + path(top, i), x[3]
            for slot, other in steps:
                h = digest(other + h if slot else h + other)
            yield (x[4], x[2], trees[i][-1][0], top[-1][0], digest("".join(s for _, s in steps)), h, h == top[-1][0])


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def run(spark, docs, tmp_dir):
    docs.write.mode("overwrite").parquet(f"{tmp_dir}/documents.parquet")
    return ordered(merkle.op13_lag_lead_merkle(spark, tmp_dir).collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    assert ordered(merkle.op13_lag_lead_merkle(spark, SF0001).collect()) == ordered(brute(docs))


def test_odd_rows_and_a_hot_repeated_row(spark, tmp_dir):
    odd = documents(spark).withColumn("n_chars", F.length("text").cast("bigint"))
    langs = F.when(F.col("doc_id") < 4, F.lit(None)).when(F.col("doc_id") < 6, "é").when(F.col("doc_id") < 9, "z")
    docs = odd.withColumn("lang", F.coalesce(langs, F.col("lang")))
    many = spark.range(700).select((F.col("id") * 0 + 3).alias("doc_id"), F.lit("same").alias("text"),
                                   F.lit("x").alias("lang"), F.lit(4).cast("bigint").alias("n_chars"))
    docs = docs.unionByName(many, allowMissingColumns=True)
    got = run(spark, docs, tmp_dir)
    assert got == ordered(brute(docs.collect())) and len(got) == len(TEXTS) + 700
    assert len({r[3] for r in got}) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 257])
def test_sizes(spark, tmp_dir, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                 F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    got = run(spark, docs, tmp_dir)
    assert got == ordered(brute(docs.collect()))
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest("")


def test_many_groups(spark, tmp_dir):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                   (F.col("id") % 300).cast("string").alias("lang"), F.lit("s").alias("source"),
                                   F.lit(1).cast("bigint").alias("n_chars"))
    assert run(spark, docs, tmp_dir) == ordered(brute(docs.collect()))


def test_paths_fold_to_the_root_and_the_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = merkle.manifest(docs)
    assert out.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert out.where(merkle.fold(F.sha2("leaf", 256), F.col("steps")) == F.col("root")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
