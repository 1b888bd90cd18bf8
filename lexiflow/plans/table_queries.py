"""Registered queries over record tables: metrics (A4-A16), correlation and
selection (A13, A14, T2-T4), factorise and scaling (F1-F3), splitting and
sampling (F6, F7, F10), JSON records and bounded reads (S4, S6-S8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import in_test, keyed_hash
from ..operators import metrics as M
from ..operators import stats as S
from ..operators.features import (apply_factorize, array_stats_literals, fit_array_scaler,
                                  fit_factorize)
from ..operators.sampling import stratified_folds as folds_op, undersample as undersample_op
from ..sources.readers import decode_with_defaults, encode_sorted_json, head, read_table, tail
from . import bindings as B


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ------------------------------------------------- metrics over NB predictions

def _conv_pred(spark, sf):
    return B.nb_multi_predict(spark, sf)


def confusion(spark, sf):
    """A5 + N5: full role x role grid with counts and row shares."""
    p = _conv_pred(spark, sf).where(F.col("target") == "role")
    c = M.confusion(p, "truth", "pred")
    return c.select("true_label", "pred_label", "n", _r("share").alias("share"))


def class_report(spark, sf):
    """A6 over the role predictions."""
    p = _conv_pred(spark, sf).where(F.col("target") == "role")
    rep = M.class_report(p, "truth", "pred")
    return rep.select("class", *[_r(c).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def macro_micro_precision(spark, sf):
    """A8 over the role predictions."""
    p = _conv_pred(spark, sf).where(F.col("target") == "role")
    m = M.macro_micro_precision(p, "truth", "pred")
    return m.select(_r("macro_precision").alias("macro_precision"),
                    _r("micro_precision").alias("micro_precision"))


def accuracy_by_target(spark, sf):
    """A7 per target."""
    p = _conv_pred(spark, sf)
    return p.groupBy("target").agg(
        _r(F.avg((F.col("truth") == F.col("pred")).cast("double"))).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def off_by_histogram(spark, sf):
    """Percent of turns whose predicted bucket is off by k = 0..5."""
    p = _conv_pred(spark, sf).where(F.col("target") == "turn").select(
        F.col("truth").cast("int").alias("t"), F.col("pred").cast("int").alias("p"))
    h = M.off_by_histogram(p, "t", "p", max_k=5)
    return h.select(F.col("k").cast("bigint").alias("k"), _r("pct").alias("pct"))


def mae_by_target(spark, sf):
    """A11 (second half): mean |bucket representative - raw count|."""
    p = _conv_pred(spark, sf).where(F.col("target") == "turn")
    raw = F.split("key", ":").getItem(1).cast("int")
    p = p.select("target", raw.alias("t"), F.col("pred").cast("int").alias("p"))
    m = M.mean_abs_error_by(p, "target", "t", "p")
    return m.select("target", _r("mae").alias("mae"))


# ---------------------------------------------------------- lineitem regression

def _price_model(spark, sf):
    li = read_table(spark, sf, "lineitem")
    y = (F.col("l_extendedprice") / 1000.0)
    ratio = li.select(F.sum(F.col("l_extendedprice") / 1000.0) / F.sum("l_quantity")).scalar()
    return li.select("l_returnflag", y.alias("y"), (F.col("l_quantity") * ratio).alias("p"))


def regression_metrics(spark, sf):
    """A10 per return flag: price (thousands) against a one-parameter ratio model."""
    m = M.regression_metrics(_price_model(spark, sf), "y", "p", "l_returnflag")
    return m.select("l_returnflag", "n", *[_r(c).alias(c) for c in ("mse", "rmse", "mae", "r2")])


def mape_score(spark, sf):
    """A12 over the same predictions."""
    return M.mape_score(_price_model(spark, sf), "y", "p").select(_r("score").alias("score"))


LINEITEM_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey",
                     "l_suppkey", "l_orderkey", "l_net", "l_charge"]


def _lineitem(spark, sf):
    """lineitem with two derived money columns (net and charged price)."""
    li = read_table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.withColumn("l_net", net).withColumn("l_charge", net * (1 + F.col("l_tax")))


def feature_corr(spark, sf):
    """Correlation of each lineitem feature with the price."""
    li = _lineitem(spark, sf)
    c = S.corr_with_target(li, LINEITEM_FEATURES, "l_extendedprice")
    return c.select("feature", _r("corr").alias("corr"))


def feature_cov(spark, sf):
    """Sample covariance with the price in thousands."""
    li = _lineitem(spark, sf).withColumn("y", F.col("l_extendedprice") / 1000.0)
    c = S.cov_with_target(li, LINEITEM_FEATURES, "y")
    return c.select("feature", _r("cov", 4).alias("cov"))


def corr_matrix(spark, sf):
    """The full matrix in long form."""
    li = _lineitem(spark, sf)
    c = S.corr_matrix(li, LINEITEM_FEATURES + ["l_extendedprice"])
    return c.select("a", "b", _r("corr").alias("corr"))


def corr_top_n(spark, sf):
    """The three features most correlated with the price."""
    li = _lineitem(spark, sf)
    c = S.corr_with_target(li, LINEITEM_FEATURES, "l_extendedprice")
    return S.top_n(c, "corr", 3).select("feature", _r("corr").alias("corr"))


def corr_threshold(spark, sf):
    """T4: features with correlation above 0.3 (signed)."""
    li = _lineitem(spark, sf)
    c = S.corr_with_target(li, LINEITEM_FEATURES, "l_extendedprice")
    return S.above(c, "corr", 0.3).select("feature", _r("corr").alias("corr"))


# ------------------------------------------------------------- embeddings scores

def cross_entropy(spark, sf):
    """The whole embedding read as class scores."""
    e = read_table(spark, sf, "embeddings").select(F.col("embedding").alias("s"), "label")
    return M.cross_entropy(e, "s", "label").select(_r("cross_entropy").alias("cross_entropy"), "n")


def argmax_accuracy(spark, sf):
    """T6 + A7: arg-max of those scores against the label."""
    e = read_table(spark, sf, "embeddings").select(
        M.argmax_index("embedding").alias("pred"), "label")
    return M.accuracy(e, "label", "pred").select(_r("accuracy").alias("accuracy"), "n")


# ------------------------------------------------------------ factorise / scale

def factorize(spark, sf):
    """event_type and user_id coded by first appearance in (ts, event_id) order."""
    ev = read_table(spark, sf, "events")
    codes = fit_factorize(ev, ["event_type", "user_id"], ["ts", "event_id"])
    out = apply_factorize(ev.select("event_id", "event_type", "user_id"), codes,
                          ["event_type", "user_id"], suffix="_code")
    return out.select("event_id", "event_type_code", "user_id_code")


def factorize_codes(spark, sf):
    ev = read_table(spark, sf, "events")
    return fit_factorize(ev, ["event_type", "user_id"], ["ts", "event_id"])


def _scaled_long(spark, sf, kind):
    e = read_table(spark, sf, "embeddings")
    st = fit_array_scaler(e, "embedding")
    stats = F.broadcast(st)   # one row per dimension
    x = e.select("vec_id", F.posexplode("embedding").alias("dim", "x")).join(stats, "dim")
    if kind == "minmax":
        v = F.when(F.col("max") == F.col("min"), 0.0).otherwise(
            (F.col("x") - F.col("min")) / (F.col("max") - F.col("min")))
    else:
        v = F.when(F.col("std") == 0, 0.0).otherwise((F.col("x") - F.col("mean")) / F.col("std"))
    return x.select("vec_id", F.col("dim").cast("bigint").alias("dim"), _r(v).alias("value"))


def minmax_scale(spark, sf):
    """F2 per embedding dimension, long form."""
    return _scaled_long(spark, sf, "minmax")


def standard_scale(spark, sf):
    """F3 per embedding dimension (population std), long form."""
    return _scaled_long(spark, sf, "standard")


# ------------------------------------------------------- split / folds / sampling

def hash_split(spark, sf):
    """80/20 keyed split of events, seed 42."""
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", in_test("event_id", 42, 20).alias("is_test"))


def stratified_folds(spark, sf):
    """five folds stratified by label."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "label")
    return folds_op(e, "vec_id", "label", 5, seed=0).select(
        "vec_id", "label", F.col("fold").cast("bigint").alias("fold"))


def undersample(spark, sf):
    """'view' and 'click' cut to 300 rows each; other types untouched."""
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    return undersample_op(ev, "event_id", "event_type", {"view": 300, "click": 300}, seed=7)


def value_counts(spark, sf):
    """A4."""
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- records / reads

PROPS = T.StructType([T.StructField("k", T.LongType()), T.StructField("j", T.StringType())])


def json_decode_defaults(spark, sf):
    """Decode props with defaults for missing fields."""
    ev = read_table(spark, sf, "events")
    d = decode_with_defaults("props", PROPS, {"k": 0, "j": ""})
    return ev.select("event_id", d.alias("p")).select("event_id", "p.k", "p.j")


def json_encode(spark, sf):
    """Sorted-key JSON of selected fields."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return ev.select("event_id", encode_sorted_json(ev, ["value", "event_type", "user_id"]).alias("json"))


def tail_n(spark, sf):
    """Newest 50 events, newest first (the limit is the operator)."""
    ev = read_table(spark, sf, "events")
    return tail(ev, 50, "ts", ["event_id"]).select("event_id", "event_type", "value")


def head_n(spark, sf):
    """First 100 orders by key."""
    o = read_table(spark, sf, "orders")
    return head(o, 100, "o_orderkey").select("o_orderkey", "o_totalprice")


# ------------------------------------------------------------------- neighbours

def _emb_split(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    t = in_test("vec_id", 0, 20)
    return e.where(~t), e.where(t)


def knn_neighbors(spark, sf):
    """M7 search: the five nearest training vectors of every test vector."""
    from ..operators.neighbors import knn
    train, test = _emb_split(spark, sf)
    q = test.select(F.col("vec_id").alias("qid"), "embedding")
    nb = knn(train, q, 5, id_col="vec_id", vec_col="embedding", qid_col="qid")
    return nb.select(F.col("qid").alias("query_id"), F.col("rank").cast("bigint").alias("rank"),
                     F.col("vec_id").alias("train_id"), "d2")


def knn_tree_events(spark, sf):
    """M7 / E9 in few dimensions: the five nearest of all events for every hundredth one
    (a stated query set), by a space-partition tree."""
    from ..operators.kd_tree import knn_tree
    ev = read_table(spark, sf, "events").select("event_id", F.array(
        F.col("value").cast("double"), (F.col("user_id") / 100.0).cast("double"),
        (F.hour("ts") + F.minute("ts") / 60.0).cast("double")).alias("vec"))
    q = ev.where(F.col("event_id") % 100 == 0).select(F.col("event_id").alias("qid"), "vec")
    return knn_tree(ev, q, 5, id_col="event_id").select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "event_id", "d2")


def _knn_pred(spark, sf, weighted):
    from ..operators.neighbors import knn, vote
    train, test = _emb_split(spark, sf)
    q = test.select(F.col("vec_id").alias("qid"), "embedding")
    nb = knn(train, q, 5, id_col="vec_id", vec_col="embedding", qid_col="qid")
    p = vote(nb, train, qid_col="qid", id_col="vec_id", label_col="label", weighted=weighted)
    return p.join(test.select(F.col("vec_id").alias("qid"), F.col("label").alias("truth")), "qid") \
        .select(F.col("qid").alias("vec_id"), F.col("truth").cast("bigint").alias("truth"),
                F.col("pred").cast("bigint").alias("pred"))


def knn_classify(spark, sf):
    """M7 uniform vote, k = 5."""
    return _knn_pred(spark, sf, weighted=False)


def knn_classify_weighted(spark, sf):
    """M7 distance-weighted vote, k = 5."""
    return _knn_pred(spark, sf, weighted=True)


def smote(spark, sf):
    """F8: synthetic rows bringing every label to the largest class size (long form)."""
    from ..operators.smote import synthesize
    e = read_table(spark, sf, "embeddings")
    s = synthesize(e, "vec_id", "embedding", "label", k=5)
    return s.select(F.col("label").cast("bigint").alias("label"), "base_id", "j",
                    F.posexplode("vec").alias("dim", "v")).select(
        "label", "base_id", "j", F.col("dim").cast("bigint").alias("dim"), _r("v").alias("value"))


def smote_class_counts(spark, sf):
    """U2 invariant: class sizes after over-sampling (all equal)."""
    from ..operators.smote import oversample
    e = read_table(spark, sf, "embeddings")
    o = oversample(e, "vec_id", "embedding", "label", k=5)
    return o.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
