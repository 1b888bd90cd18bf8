"""M7 and F8 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from lexiflow.operators.neighbors import knn, vote
from lexiflow.operators.smote import oversample, synthesize


def _data(spark, n=300, d=6, seed=1, groups=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[5] = x[6]     # an exact duplicate (distance 0, tie broken by id)
    rows = [(i, [float(v) for v in x[i]], i % groups) for i in range(n)]
    return x, spark.createDataFrame(rows, "id long, vec array<double>, g int")


def _brute(x, q_ids, t_ids, k, same=None, exclude_self=False):
    out = {}
    for q in q_ids:
        cands = []
        for t in t_ids:
            if exclude_self and t == q:
                continue
            if same is not None and same[t] != same[q]:
                continue
            cands.append((round(float(((x[q] - x[t]) ** 2).sum()), 9), t))
        out[q] = [t for _, t in sorted(cands)[:k]]
    return out


def test_knn_exact_with_small_blocks(spark):
    x, df = _data(spark)
    train = df.where(F.col("id") % 4 != 0)
    q = df.where(F.col("id") % 4 == 0).select(F.col("id").alias("qid"), "vec")
    got = {}
    for r in knn(train, q, 5, train_block=16, query_block=7).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    exp = _brute(x, [i for i in range(300) if i % 4 == 0], [i for i in range(300) if i % 4], 5)
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == exp


def test_knn_within_group_excluding_self(spark):
    x, df = _data(spark, n=200)
    q = df.select(F.col("id").alias("qid"), "vec", "g")
    got = {}
    for r in knn(df, q, 3, group_col="g", exclude_self=True, train_block=10, query_block=9).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    exp = _brute(x, list(range(200)), list(range(200)), 3, same={i: i % 3 for i in range(200)},
                 exclude_self=True)
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == exp


def test_weighted_vote_zero_distance_only(spark):
    nb = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 4.0), (1, 3, 12, 4.0)],
                               "qid long, rank int, id long, d2 double")
    lab = spark.createDataFrame([(10, 2), (11, 1), (12, 1)], "id long, label int")
    assert vote(nb, lab, weighted=True).first()["pred"] == 2
    assert vote(nb, lab, weighted=False).first()["pred"] == 1


def test_smote_balances_and_stays_on_segments(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4)], 0 if i < 30 else (1 if i < 40 else 2))
            for i in range(41)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    o = oversample(df, "id", "vec", "label")
    counts = {r["label"]: r["count"] for r in o.groupBy("label").count().collect()}
    assert counts == {0: 30, 1: 30, 2: 1}        # a class of one row gets no synthetic rows
    x = {r[0]: np.array(r[1]) for r in rows}
    for r in synthesize(df, "id", "vec", "label").collect():
        v = np.array(r["vec"])
        base = x[r["base_id"]]
        # on a segment from the base row to some other row of its class
        ok = any(np.allclose(v, base + lam * (x[j] - base), atol=1e-9)
                 for j in x if j != r["base_id"] and rows[j][2] == r["label"]
                 for lam in [float(np.dot(v - base, x[j] - base) / max(np.dot(x[j] - base, x[j] - base), 1e-12))]
                 if 0 <= lam < 1)
        assert ok


def test_smote_of_two_rows_against_many(spark):
    df = spark.range(60_000).select("id", F.array(F.col("id") * 1.0, F.lit(0.5)).alias("vec"),
                                    (F.col("id") < 2).cast("int").alias("label"))
    syn = synthesize(df, "id", "vec", "label", chunk=256)
    assert syn.count() == 59_996 and syn.select("base_id", "j").distinct().count() == 59_996


def test_knn_with_every_query_at_one_point(spark):
    train = spark.range(3000).select("id", F.array(F.col("id") % 7 * 1.0).alias("vec"))
    q = spark.range(900).select(F.col("id").alias("qid"), F.array(F.lit(3.0)).alias("vec"))
    got = knn(train, q, 4, train_block=256, query_block=64).collect()
    assert len(got) == 3600 and {(r["rank"], r["id"], r["d2"]) for r in got} == {
        (1, 3, 0.0), (2, 10, 0.0), (3, 17, 0.0), (4, 24, 0.0)}


def test_no_cartesian_product_is_planned(spark):
    from lexiflow.operators.neighbors import knn
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(50)], "id int, vec array<double>, g int")
    for group in (None, "g"):
        out = knn(df, df.withColumnRenamed("id", "qid"), 3, group_col=group)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, plan
