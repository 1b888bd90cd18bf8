"""Boosted trees against a plain version over lists: sparse and dense rows, negative
values, saving."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors

from lexiflow.operators.boosting import BoostedModel, BoostedRegressor


def plain(rows, trees, depth, step, least, reg=1.0):
    """Predictions of boosted trees grown over every threshold of every feature."""
    base = sum(y for _, y in rows) / len(rows)
    preds = [base] * len(rows)
    width = len(rows[0][0])

    def grow(members, level):
        g, h = sum(preds[i] - rows[i][1] for i in members), len(members)
        found = []
        for f in range(width) if level < depth else ():
            values = sorted({rows[i][0][f] for i in members})
            for t in values[:-1]:
                left = [i for i in members if rows[i][0][f] <= t]
                gl, hl = sum(preds[i] - rows[i][1] for i in left), len(left)
                gain = gl * gl / (hl + reg) + (g - gl) ** 2 / (h - hl + reg) - g * g / (h + reg)
                found.append((-round(gain, 9), f, t))
        if not found or -min(found)[0] < least:
            return {i: -step * g / (h + reg) for i in members}
        _, f, t = min(found)
        return (grow([i for i in members if rows[i][0][f] <= t], level + 1)
                | grow([i for i in members if rows[i][0][f] > t], level + 1))

    for _ in range(trees):
        add = grow(range(len(rows)), 0)
        preds = [p + add[i] for i, p in enumerate(preds)]
    return preds


def data(spark, seed, dense):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        x = [rng.choice([0, 0, 0, 1, 2.5, -1, -3]), rng.choice([0, 1]), float(rng.randint(-4, 4)), rng.choice([0, 0, 7])]
        rows.append((x, x[0] * 2 + (x[2] > 1) * 5 + x[1] * x[3] + rng.random()))
    vec = (lambda x: Vectors.dense(x)) if dense else (lambda x: Vectors.sparse(4, {i: v for i, v in enumerate(x) if v}))
    return rows, spark.createDataFrame([(i, vec(x), y) for i, (x, y) in enumerate(rows)], ["id", "features", "label"])


@pytest.mark.parametrize("dense,depth,least", [(False, 3, 0.85), (True, 2, 0.0), (False, 2, 40.0)])
def test_equals_the_plain_trees(spark, dense, depth, least):
    rows, df = data(spark, 3, dense)
    model = BoostedRegressor(maxIter=2, maxDepth=depth, stepSize=0.5, minSplitLoss=least).fit(df)
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert got == pytest.approx(plain(rows, 2, depth, 0.5, least))


def test_saving_and_odd_rows(spark, tmp_dir):
    rows, df = data(spark, 5, False)
    model = Pipeline(stages=[BoostedRegressor(maxIter=2, maxDepth=2, predictionCol="p")]).fit(df)
    model.write().overwrite().save(f"{tmp_dir}/b")
    again = PipelineModel.load(f"{tmp_dir}/b")
    assert isinstance(again.stages[0], BoostedModel)
    a, b = (m.transform(df).select("id", "p").collect() for m in (model, again))
    assert sorted(a) == sorted(b)
    empty = BoostedRegressor(maxIter=2).fit(df.where("false"))
    assert {r.prediction for r in empty.transform(df).collect()} == {0.0}
    same = BoostedRegressor(maxIter=2).fit(df.withColumn("label", df.label * 0 + 4))
    assert {r.prediction for r in same.transform(df).collect()} == {4.0}


def test_binning_in_place_equals_the_join(spark):
    """Few cuts are binned without a shuffle, as the join with the cuts bins them."""
    from pyspark.sql import functions as F
    from lexiflow.operators import boosting as B
    from lexiflow.session import Scratch
    rows, df = data(spark, 11, False)
    odd = spark.createDataFrame([(1000, Vectors.sparse(4, {}), 2.0), (1001, Vectors.dense([0, -9.5, 9.5, 0]), 3.0)], df.schema)
    raw = Scratch(spark).cut(B._arrays(df.unionByName(odd).withColumnRenamed("label", "y"), ["y"], "features")
                             .withColumn("row", F.monotonically_increasing_id()), "raw")
    entries = raw.select("row", F.inline(F.arrays_zip("index", "value")).alias("feature", "value"))
    cuts = B.fit_cuts(entries, 4)
    place = B._binned_in_place(raw, cuts)
    assert "Exchange" not in place._jdf.queryExecution().executedPlan().toString()

    def plain(d):
        return sorted((r.y, sorted(zip(r.features, r.bins))) for r in d.collect())
    assert plain(place) == plain(B._binned_by_join(raw, entries, cuts)) and len(plain(place)) == 122


def test_a_level_reads_its_rows_once(spark):
    """Totals are cells of the one aggregation, rows without entries in them."""
    from lexiflow.operators.boosting import _best_splits, _cells
    level = spark.createDataFrame([(0, -2.0, [0], [1]), (0, -2.0, [0], [1]), (0, 3.0, [], []), (0, 1.0, [], [])],
                                  "node int, g double, features array<int>, bins array<int>")
    cells = _cells(level)
    assert {(r.feature, r.bin, r.g, r.h) for r in cells.collect()} == {(-1, 0, 0.0, 4), (0, 1, -4.0, 2)}
    best = _best_splits(cells, 1.0).first()
    assert (best.feature, best.bin) == (0, 0) and best.gain == pytest.approx(2 * 16 / 3)
