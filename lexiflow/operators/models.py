"""Model family (F5, M4-M6, M8-M12, M14, M15b, M18) on MLlib.

MLlib estimators train data-parallel (tree aggregation, distributed L-BFGS /
OWL-QN), so these are thin factories with the parameter translations the
original settings need, plus our own pieces MLlib lacks: a macro-F1
evaluator, per-fold scores and recursive feature elimination (searches: search.py).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .sampling import stratified_folds
from .softmax import SoftmaxRegression

MAX_DEPTH = 30   # MLlib's limit, and what "no limit given" means here
COEFFICIENT_BYTES = 2 << 20     # of one vector of coefficients that MLlib's search may hold in the driver


def tree_depth(depth) -> int:
    """The depth asked for; ``None`` is MLlib's largest.  A deeper tree is refused
    rather than cut without notice."""
    if depth is None:
        return MAX_DEPTH
    if not 0 <= int(depth) <= MAX_DEPTH:
        raise ValueError(f"tree depth {depth} is outside of 0..{MAX_DEPTH}")
    return int(depth)


# ------------------------------------------------------------------ estimators

def logistic_regression(n_rows: int, C: float = 1.0, penalty: str = "l2", max_iter: int = 100,
                        features: str = "features", label: str = "label") -> LogisticRegression:
    """M4: multinomial LR.  The library objective sums the losses with weight C;
    MLlib averages them, so regParam = 1 / (C * n)."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                              standardization=False, maxIter=max_iter,
                              regParam=1.0 / (C * max(n_rows, 1)),
                              elasticNetParam=1.0 if penalty == "l1" else 0.0)


def fit_text_classifier(rows: DataFrame, n_features: int, C: float = 1.0, penalty: str = "l2", max_iter: int = 100,
                        features: str = "features", label: str = "label", max_bytes: int = COEFFICIENT_BYTES):
    """M4 over a vocabulary: MLlib's fit while one vector of coefficients is within
    ``max_bytes``; beyond it the same search with its vectors in tables, so that the
    driver's share doesn't grow with the vocabulary.  (The l1 penalty is MLlib's alone.)"""
    labels = rows.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("most"), F.min(label).alias("least")).first()
    est = logistic_regression(labels["n"], C, penalty, max_iter, features, label)
    wide = 8 * (n_features + 1) * (int(labels["most"] or 0) + 1) > max_bytes
    if wide and penalty == "l2" and labels["most"] != labels["least"]:
        est = SoftmaxRegression(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=est.getRegParam())
    return est.fit(rows)


def random_forest(n_trees: int = 100, max_depth=None, min_leaf: int = 1, seed: int = 0,
                  subset: str = "sqrt", features: str = "features",
                  label: str = "label") -> RandomForestClassifier:
    """M5: entropy forest."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, impurity="entropy",
                                  numTrees=n_trees, maxDepth=tree_depth(max_depth),
                                  minInstancesPerNode=min_leaf, featureSubsetStrategy=subset,
                                  bootstrap=True, seed=seed)


def random_forest_regressor(n_trees: int = 100, max_depth=None, seed: int = 0,
                            features: str = "features", label: str = "label") -> RandomForestRegressor:
    """M6."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=n_trees,
                                 maxDepth=tree_depth(max_depth), seed=seed)


def decision_tree(max_depth=None, features: str = "features",
                  label: str = "label") -> DecisionTreeClassifier:
    """M8: entropy tree."""
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, impurity="entropy",
                                  maxDepth=tree_depth(max_depth))


def gbt(target: str, max_depth: int = 6, step: float = 0.1, max_iter: int = 100,
        min_gain: float = 0.0, features: str = "features") -> GBTRegressor:
    """M9: squared-error boosted trees for one target."""
    return GBTRegressor(featuresCol=features, labelCol=target, maxDepth=tree_depth(max_depth),
                        stepSize=step, maxIter=max_iter, minInfoGain=min_gain,
                        predictionCol=f"pred_{target}")


def fit_multi_target(train: DataFrame, targets: list[str], **kw):
    """M9: one boosted model per target on the same (cached) features."""
    return {t: gbt(t, **kw).fit(train) for t in targets}


def mlp(n_features: int, n_classes: int, hidden: int = 32, max_iter: int = 100, seed: int = 0,
        features: str = "features", label: str = "label") -> MultilayerPerceptronClassifier:
    """Feed-forward classifier over an embedding column."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, seed=seed,
                                          layers=[n_features, 2 * hidden, hidden, n_classes],
                                          maxIter=max_iter)


# ------------------------------------------------------------------- transforms

def pca_pipeline(k: int, input_col: str = "features", output_col: str = "pca") -> Pipeline:
    """centre (MLlib's PCA does not), then project on k components."""
    return Pipeline(stages=[
        StandardScaler(inputCol=input_col, outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol=output_col)])


def explained_variance(pca_model, round_to: int = 3) -> list[tuple[int, float]]:
    """F5 + N1 inputs: (component, ratio) pairs — k numbers."""
    ev = pca_model.explainedVariance.toArray()
    return [(i, float(v)) for i, v in enumerate(ev)]


def loadings(pca_model, names: list[str]) -> list[tuple[str, int, float]]:
    """(feature, component, loading) in long form (d x k numbers)."""
    pc = pca_model.pc.toArray()
    return [(names[i], j, float(pc[i, j])) for i in range(pc.shape[0]) for j in range(pc.shape[1])]


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """(feature, importance)."""
    imp = model.featureImportances.toArray()
    return [(n, float(imp[i])) for i, n in enumerate(names)]


# ------------------------------------------------------------------ evaluation

class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 (MLlib's "f1" is the weighted average)."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset):
        row = M.macro_f1(dataset, self.label, self.prediction).first()
        return float(row["macro_f1"]) if row and row["macro_f1"] is not None else 0.0

    def isLargerBetter(self):
        return True


def fold_scores(df: DataFrame, estimator, key: str, label: str, k: int = 5, seed: int = 0,
                metric: str = "accuracy", prediction: str = "prediction") -> list[tuple[int, float]]:
    """per-fold scores with stratified hash folds (one fit per fold)."""
    f = stratified_folds(df, key, label, k, seed).cache()
    out = []
    try:
        for i in range(k):
            model = estimator.fit(f.where(F.col("fold") != i))
            pred = model.transform(f.where(F.col("fold") == i))
            if metric == "accuracy":
                v = M.accuracy(pred, label, prediction).first()["accuracy"]
            else:
                v = M.macro_f1(pred, label, prediction).first()["macro_f1"]
            out.append((i, float(v or 0.0)))
    finally:
        f.unpersist()
    return out


def rfe(df: DataFrame, features: list[str], label: str, n: int, step: int = 10,
        n_trees: int = 10, max_depth: int = 10, seed: int = 0) -> list[list[str]]:
    """Fit a forest, drop the ``min(step, m - n)`` least important
    features, repeat until n remain.  Returns the feature list of each round.
    The input is materialised once (shared checkpoint folder) so the rounds
    do not recompute it."""
    from ..session import cut_lineage
    base = cut_lineage(df.select(*features, label))
    current = list(features)
    rounds = [list(current)]
    while len(current) > n:
        va = VectorAssembler(inputCols=current, outputCol="_f")
        model = random_forest(n_trees, max_depth, seed=seed, subset="all", features="_f",
                              label=label).fit(va.transform(base))
        imp = importances(model, current)
        drop = min(step, len(current) - n)
        worst = {f for f, _ in sorted(imp, key=lambda x: (x[1], x[0]))[:drop]}
        current = [f for f in current if f not in worst]
        rounds.append(list(current))
    return rounds
