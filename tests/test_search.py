"""Searches: scores per (parameters, fold) against one fit and one count at a time."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF0001
from lexiflow.operators import metrics as M
from lexiflow.operators import models as ML
from lexiflow.operators.sampling import stratified_folds
from lexiflow.operators.search import describe, grid_maps, random_maps, search


@pytest.fixture(scope="module")
def data(spark):
    e = spark.read.parquet(f"{SF0001}/embeddings.parquet").select(
        "vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].alias(f"x{i}") for i in range(4)])
    return VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(e).cache()


@pytest.mark.parametrize("metric", ["macro_f1", "accuracy"])
def test_scores_are_those_of_single_fits(spark, data, metric):
    est = ML.decision_tree()
    maps = grid_maps(est, {"maxDepth": [1, 3]})
    found = search(data, est, maps, "vec_id", "label", folds=2, metric=metric)
    got = {(r.params, r.fold): r.score for r in found.scores.collect()}
    assert len(got) == 4
    folded = stratified_folds(data, "vec_id", "label", 2, 0)
    for params in maps:
        for fold in range(2):
            p = est.fit(folded.where(F.col("fold") != fold), params).transform(folded.where(F.col("fold") == fold))
            one = M.macro_f1(p, "label", "prediction") if metric == "macro_f1" else \
                M.accuracy(p, "label", "prediction").select("accuracy")
            assert got[describe(params), fold] == pytest.approx(one.first()[0])
    means = [(r.params, r.score) for r in found.means.collect()]
    assert means[0][1] == max(s for _, s in means) and describe(found.best) == means[0][0]
    assert found.best_model.depth <= 3


def test_regression_and_draws(spark, data):
    est = ML.random_forest_regressor()
    maps = random_maps(est, {"maxDepth": [1, 2], "numTrees": [2, 3, 4]}, 3, seed=1)
    assert len(maps) == 3 and maps == random_maps(est, {"maxDepth": [1, 2], "numTrees": [2, 3, 4]}, 3, seed=1)
    assert len(random_maps(est, {"maxDepth": [1, 2]}, 100)) == 2
    found = search(data, est, maps[:2], "vec_id", "label", folds=2, metric="rmse", refit=False)
    scores = [r.score for r in found.means.collect()]
    assert scores == sorted(scores) and found.best_model is None
    with pytest.raises(ValueError):
        search(data, est, maps, "vec_id", "label", metric="auc")
