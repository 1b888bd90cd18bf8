"""Parameter searches with a score per (parameters, fold).

Folds are stratified hash folds, so every row's fold is reproducible and each fold
has each class in equal shares.  Per fold the models of all parameter maps are fitted
on the other folds and then scored together: one scan of the held-out rows carries a
prediction column per model, unpivots it to (model, truth, prediction), and one
aggregation keyed by model gives every model's confusion or error sums.  Nothing but
those sums -- classes^2 rows, or one row, a model -- leaves the executors."""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .sampling import stratified_folds

MODELS_PER_SCAN = 32
METRICS = {"accuracy": True, "macro_f1": True, "mae": False, "rmse": False, "mape": True}     # larger is better


@dataclass
class SearchResult:
    """``scores``: (map, params, fold, score); ``means``: (map, params, score), best first;
    ``best`` and ``best_model``: the best map and its model, refitted on all rows."""
    scores: DataFrame
    means: DataFrame
    best: dict
    best_model: object


def grid_maps(estimator, grid: dict) -> list[dict]:
    """Every combination of the parameter lists, names in order."""
    names = sorted(grid)
    return [{getattr(estimator, n): v for n, v in zip(names, values)}
            for values in itertools.product(*(grid[n] for n in names))]


def random_maps(estimator, space: dict, draws: int, seed: int = 42) -> list[dict]:
    """Seeded draws without repeats; all combinations when there are no more."""
    every = grid_maps(estimator, space)
    return random.Random(seed).sample(every, min(draws, len(every)))


def describe(params: dict) -> str:
    return ",".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name))


def _predictions(models: list[tuple[int, object]], rows: DataFrame, label: str) -> DataFrame:
    """(model, truth, prediction) of every row and model, from one scan of the rows."""
    out = rows
    for i, model in models:
        one = model.copy()
        one.set(one.predictionCol, f"_p{i}")
        for extra in ("rawPredictionCol", "probabilityCol"):
            if one.hasParam(extra):
                one.set(one.getParam(extra), "")
        out = one.transform(out)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, _ in models]))
    return out.select(F.col(label).cast("double").alias("truth"), each.alias("e")).select(
        "e.model", "truth", "e.prediction")


def _score(pred: DataFrame, metric: str) -> DataFrame:
    """(model, score), one aggregation keyed by model."""
    if metric in ("accuracy", "macro_f1"):
        cells = pred.groupBy("model", "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
        if metric == "accuracy":
            right = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
            return cells.groupBy("model").agg((F.sum(right) / F.sum("n")).alias("score"))
        hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
        sides = cells.select("model", F.explode(F.array(
            F.struct(F.col("truth").alias("c"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"), hit.alias("t")),
            F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"),
                     F.lit(0).cast("bigint").alias("t")))).alias("e")).select("model", "e.*")
        per = sides.groupBy("model", "c").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
        return per.groupBy("model").agg(F.avg(2.0 * F.col("t") / (F.col("s") + F.col("p"))).alias("score"))
    error: Column = F.col("prediction") - F.col("truth")
    value = {"mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)),
             "mape": 100.0 - 100.0 * F.avg(F.abs(error)) / F.avg("truth")}[metric]
    return pred.groupBy("model").agg(value.alias("score"))


def search(df: DataFrame, estimator, maps: list[dict], key: str, label: str, folds: int = 3, seed: int = 0,
           metric: str = "macro_f1", strata: str | None = None, refit: bool = True) -> SearchResult:
    """Cross-validate every map of ``maps``; ``key`` identifies rows, ``strata`` (by default
    the label) is what folds share equally.  Ties go to the earlier map."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    folded = scratch.cut(stratified_folds(df, key, strata or label, folds, seed), "search-folds")
    rows = []
    for fold in range(folds):
        train, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        fitted = sorted(estimator.fitMultiple(train, maps), key=lambda m: m[0])
        for at in range(0, len(fitted), MODELS_PER_SCAN):
            scored = _score(_predictions(fitted[at:at + MODELS_PER_SCAN], held, label), metric)
            rows += [(r["model"], describe(maps[r["model"]]), fold, r["score"]) for r in scored.collect()]   # a row a model
    scores = spark.createDataFrame(sorted(rows), "map int, params string, fold int, score double")
    means: dict[int, list] = {}
    for i, _, _, s in rows:
        means.setdefault(i, []).append(s)
    sign = -1 if METRICS[metric] else 1
    order = sorted((sign * sum(v) / len(v), i) for i, v in means.items())
    best = maps[order[0][1]] if order else {}
    table = spark.createDataFrame([(i, describe(maps[i]), sign * s) for s, i in order], "map int, params string, score double")
    model = estimator.fit(folded, best) if refit and order else None
    return SearchResult(scores, table, best, model)
