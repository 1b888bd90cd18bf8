"""Registered model queries (rows-only checks: fitted models are not SQL).

Small result tables built from a fitted model (components, importances, one
score per fold or parameter map) are bounded by the number of features,
components or candidates, never by the data."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.hashing import in_test
from ..functions.text import word_tokens
from ..operators import metrics as M
from ..operators import models as ML
from ..operators.sampling import undersample
from ..operators.search import grid_maps, random_maps, search
from ..operators.smote import oversample
from ..operators.stats import cumulative
from ..operators.vectorizer import TfidfVectorizer
from ..session import cut_lineage
from ..sources.readers import read_table
from .table_queries import LINEITEM_FEATURES, _lineitem


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _emb(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
                    .alias("features"))


def _emb_split(spark, sf):
    e = _emb(spark, sf)
    t = in_test("vec_id", 0, 20)
    return e.where(~t), e.where(t)


def _report(pred, label="label", prediction="prediction"):
    rep = M.class_report(pred.select(F.col(label).cast("bigint").alias("t"),
                                     F.col(prediction).cast("bigint").alias("p")), "t", "p")
    return rep.select("class", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def pca_explained(spark, sf):
    """F5 + N1: explained variance ratio of 10 components and its running sum
    (each ratio rounded to 3 decimals before summing)."""
    e = _emb(spark, sf)
    model = ML.pca_pipeline(10).fit(e)
    ev = ML.explained_variance(model.stages[-1])
    t = spark.createDataFrame([(i, v) for i, v in ev], "pc int, ratio double")
    return cumulative(t, "pc", "ratio", "cumulative", round_to=3)


def pca_project(spark, sf):
    """every vector projected on 10 components (long form)."""
    e = _emb(spark, sf)
    out = ML.pca_pipeline(10).fit(e).transform(e)
    return out.select("vec_id", F.posexplode(vector_to_array("pca")).alias("pc", "value"))


def lr_fit_score(spark, sf):
    """M4 on the embeddings, class report on the held-out part."""
    train, test = _emb_split(spark, sf)
    n = train.count()
    model = ML.logistic_regression(n, C=1.0, max_iter=100).fit(train)
    return _report(model.transform(test))


def lr_tfidf(spark, sf):
    """E2 core: TF-IDF by vocabulary index -> multinomial LR on language."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", "lang", word_tokens("text").alias("tokens"))
    d = StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(d) \
        .transform(d)
    t = in_test("doc_id", 0, 20)
    train, test = d.where(~t), d.where(t)
    vectors = TfidfVectorizer().fit(train)
    rows = cut_lineage(vectors.transform(train).select("features", "label"), "lr-tfidf")
    model = ML.fit_text_classifier(rows, vectors.size()[0], C=1.0, max_iter=50)
    return _report(model.transform(vectors.transform(test)))


def _li_indexed(spark, sf):
    li = _lineitem(spark, sf)
    li = StringIndexer(inputCol="l_returnflag", outputCol="label",
                       stringOrderType="alphabetAsc").fit(li).transform(li)
    return VectorAssembler(inputCols=LINEITEM_FEATURES, outputCol="features").transform(li)


def rf_importance(spark, sf):
    """M5 + M12 + T2: top-10 feature importances of an entropy forest."""
    li = _li_indexed(spark, sf)
    model = ML.random_forest(n_trees=10, max_depth=8, seed=0).fit(li)
    imp = ML.importances(model, LINEITEM_FEATURES)
    t = spark.createDataFrame(imp, "feature string, importance double")
    return t.orderBy(F.col("importance").desc(), "feature").limit(10)


def rf_regress(spark, sf):
    """M6 on class codes + A10 + A12 on the held-out part."""
    train, test = _emb_split(spark, sf)
    model = ML.random_forest_regressor(n_trees=20, max_depth=8).fit(train)
    p = model.transform(test)
    m = M.regression_metrics(p, "label", "prediction")
    s = M.mape_score(p, "label", "prediction").first()["score"]
    return m.select("n", *[_r(c).alias(c) for c in ("mse", "rmse", "mae", "r2")],
                    F.round(F.lit(s), 6).alias("score"))


def tree_classify(spark, sf):
    """M8: entropy tree, accuracy on the held-out part."""
    train, test = _emb_split(spark, sf)
    model = ML.decision_tree(max_depth=8).fit(train)
    return M.accuracy(model.transform(test), "label", "prediction")


def gbt_multi(spark, sf):
    """M9: one boosted regressor per target (quantity, discount, tax)."""
    li = read_table(spark, sf, "lineitem")
    feats = ["l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey"]
    li = VectorAssembler(inputCols=feats, outputCol="features").transform(li)
    t = in_test("l_orderkey", 0, 20)
    train, test = li.where(~t).cache(), li.where(t)
    targets = ["l_quantity", "l_discount", "l_tax"]
    models = ML.fit_multi_target(train, targets, max_depth=4, max_iter=10)
    out = None
    for tg, mdl in models.items():
        m = M.regression_metrics(mdl.transform(test), tg, f"pred_{tg}").select(
            F.lit(tg).alias("target"), "n", _r("rmse").alias("rmse"))
        out = m if out is None else out.unionByName(m)
    train.unpersist()
    return out


def mlp_embed(spark, sf):
    """Feed-forward classifier on the embedding column."""
    train, test = _emb_split(spark, sf)
    model = ML.mlp(64, 10, hidden=16, max_iter=50).fit(train)
    return M.accuracy(model.transform(test), "label", "prediction")


def rfe_select(spark, sf):
    """Eliminate features two at a time down to five."""
    li = _li_indexed(spark, sf)
    rounds = ML.rfe(li, LINEITEM_FEATURES, "label", n=5, step=2, n_trees=5, max_depth=5)
    return spark.createDataFrame([(i, len(r), ",".join(r)) for i, r in enumerate(rounds)],
                                 "round int, n_features int, features string")


def grid_search(spark, sf):
    """M10 + A9: forest grid, macro-F1 of every point in every fold."""
    est = ML.random_forest(seed=0)
    maps = grid_maps(est, {"maxDepth": [3, 5], "numTrees": [5, 10]})
    return search(_emb(spark, sf), est, maps, "vec_id", "label", refit=False).scores


def random_search(spark, sf):
    """Four seeded draws from a forest parameter space, macro-F1 in every fold."""
    est = ML.random_forest(seed=0)
    maps = random_maps(est, {"maxDepth": [2, 4, 6, 8], "numTrees": [5, 10, 20]}, 4)
    return search(_emb(spark, sf), est, maps, "vec_id", "label", refit=False).scores


def cv_scores(spark, sf):
    """five stratified folds, accuracy of an entropy tree per fold."""
    e = _emb(spark, sf)
    rows = ML.fold_scores(e, ML.decision_tree(max_depth=6), "vec_id", "label", k=5)
    return spark.createDataFrame(rows, "fold int, accuracy double")


def sampling_experiment(spark, sf):
    """The same LR trained on plain, SMOTE and under-sampled training sets."""
    raw = read_table(spark, sf, "embeddings")
    t = in_test("vec_id", 0, 20)
    train_raw, test_raw = raw.where(~t), raw.where(t)

    def vec(df):
        return df.select(F.col("label").cast("double").alias("label"),
                         array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
                         .alias("features"))
    variants = {"none": vec(train_raw)}
    sm = oversample(train_raw, "vec_id", "embedding", "label", k=5)
    variants["smote"] = sm.select(F.col("label").cast("double").alias("label"),
                                  array_to_vector("vec").alias("features"))
    sizes = {r["label"]: r["count"] for r in train_raw.groupBy("label").count().collect()}   # one row per class
    us = undersample(train_raw, "vec_id", "label", {c: min(sizes.values()) for c in sizes})
    variants["undersample"] = vec(us)
    test = vec(test_raw)
    out = []
    for name, tr in variants.items():
        n = tr.count()
        model = ML.logistic_regression(n, max_iter=50).fit(tr)
        a = M.accuracy(model.transform(test), "label", "prediction").first()
        out.append((name, n, float(a["accuracy"])))
    return spark.createDataFrame(out, "variant string, train_rows long, accuracy double")
