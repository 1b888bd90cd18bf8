"""F1-F4, F6, F7, F10, P14 and the ranking helpers."""

import math

from pyspark.sql import functions as F

from lexiflow.operators import features as FE
from lexiflow.operators.clean import count_bucket, canonicalize, strip, to_bool
from lexiflow.operators.ranking import rank_within, top_k_per_group
from lexiflow.operators.sampling import stratified_folds, undersample, with_split


def test_count_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 4, 5, 6, -1]], "v int")
    got = [r["b"] for r in df.select(count_bucket("v").alias("b")).collect()]
    assert got == [0, 1, 2, 2, 5, 5, None]


def test_strip_alias_null_and_bool(spark):
    df = spark.createDataFrame([(" Backdoor ", None), (None, "1"), ("Fuzzers", "0")],
                               "c string, b string")
    out = df.select(canonicalize(strip("c"), {"Backdoor": "Backdoors"}, "Benign").alias("c"),
                    to_bool("b").alias("b")).collect()
    assert [(r["c"], r["b"]) for r in out] == [("Backdoors", False), ("Benign", True),
                                               ("Fuzzers", False)]


def test_factorize_first_appearance_null_and_unseen(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "pos int, v string")
    codes = FE.fit_factorize(df, ["v"], ["pos"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"b": 0, "a": 1}
    new = spark.createDataFrame([(9, "a"), (8, "zz"), (7, None)], "pos int, v string")
    out = FE.apply_factorize(new, codes, ["v"], suffix="_code")
    assert {r["pos"]: r["v_code"] for r in out.collect()} == {9: 1, 8: -1, 7: -1}


def test_minmax_constant_column_and_standard(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    mm = FE.minmax_scale(df, ["x", "c"]).collect()
    assert [(r["x"], r["c"]) for r in mm] == [(0.0, 0.0), (1.0, 0.0)]
    st = FE.standard_scale(df, ["x"]).collect()
    assert [r["x"] for r in st] == [-1.0, 1.0]


def test_tfidf_long_by_hand(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"])], "id long, t array<string>")
    got = {(r["id"], r["token"]): r["weight"] for r in FE.tfidf_long(df, "id", "t").collect()}
    idf_a, idf_b = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    wa, wb = 2 * idf_a, idf_b
    n = math.sqrt(wa * wa + wb * wb)
    assert abs(got[(1, "a")] - wa / n) < 1e-12 and abs(got[(1, "b")] - wb / n) < 1e-12
    assert abs(got[(2, "b")] - 1.0) < 1e-12


def test_split_is_disjoint_complete_and_partition_free(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a = {r["k"]: r["is_test"] for r in with_split(df, "k", 42, 20).collect()}
    b = {r["k"]: r["is_test"] for r in with_split(df.repartition(7), "k", 42, 20).collect()}
    assert a == b and len(a) == 2000
    assert 300 < sum(a.values()) < 500


def test_rank_within_matches_row_number(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"),
                                     F.xxhash64("id").alias("o"))
    r = rank_within(df, ["g"], ["o"], "idx", num_partitions=11).collect()
    by = {}
    for row in r:
        by.setdefault(row["g"], []).append((row["o"], row["idx"]))
    for g, xs in by.items():
        xs.sort()
        assert [i for _, i in xs] == list(range(len(xs)))


def test_rank_within_hot_group_nulls_and_desc_order(spark):
    # one group holds a third of the rows, one group is NULL; descending order
    # on a non-unique column with a unique tie-breaker; many sampled ranges
    df = spark.range(0, 30000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 7 == 1, F.lit(None).cast("string"))
        .otherwise((F.col("id") % 5).cast("string")).alias("g"),
        (F.col("id") % 97).alias("c"))
    r = rank_within(df, ["g"], [F.col("c").desc(), F.col("id")], "idx", num_partitions=13)
    got = {row["id"]: row["idx"] for row in r.collect()}
    assert len(got) == 30000
    rows = [(x["g"], x["c"], x["id"]) for x in df.collect()]
    by = {}
    for g, c, i in rows:
        by.setdefault(g, []).append((-c, i))
    for g, xs in by.items():
        xs.sort()
        assert [got[i] for _, i in xs] == list(range(len(xs))), g


def test_global_index_dense(spark):
    from lexiflow.operators.ranking import global_index
    df = spark.range(0, 5000).select(F.xxhash64("id").alias("o"))
    got = sorted((row["o"], row["i"]) for row in global_index(df, ["o"], "i", 9).collect())
    assert [i for _, i in got] == list(range(5000))


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("x", "a", 3), ("x", "b", 3), ("x", "c", 1), ("y", "d", 2)],
                               "g string, t string, c long")
    out = top_k_per_group(df, ["g"], [F.col("c").desc(), F.col("t")], 2, salt_buckets=4)
    assert sorted((r["g"], r["rank"], r["t"]) for r in out.collect()) == [
        ("x", 1, "a"), ("x", 2, "b"), ("y", 1, "d")]


def test_folds_balanced_and_undersample(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 2).alias("y"))
    f = stratified_folds(df, "id", "y", 5)
    counts = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert set(counts.values()) == {100}
    u = undersample(df.withColumn("y", F.col("y").cast("string")), "id", "y", {"0": 10, "1": 9999})
    c = {r["y"]: r["count"] for r in u.groupBy("y").count().collect()}
    assert c == {"0": 10, "1": 500}
