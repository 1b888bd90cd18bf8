"""Registered queries: the operators bound to the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables.  Doubles are rounded at the output only, so that an independent SQL
engine can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import in_test
from ..functions.text import normalize_tokens_a
from ..operators import metrics
from ..operators import naive_bayes as nb
from ..operators.clean import count_bucket
from ..sources.readers import read_table

SEED = 0
TEST_PCT = 20
ALPHA_S = 0.05
ALPHA_CUF = 1e-6


def _r(col, n=6):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, n)


# ---------------------------------------------------------------- documents x lang

def _lang_docs(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("label"), normalize_tokens_a("text").alias("tokens"))
    return d.withColumn("is_test", in_test("doc_id", SEED, TEST_PCT))


def _lang_model(spark, sf, drop=0):
    d = _lang_docs(spark, sf)
    train = d.where(~F.col("is_test"))
    model = nb.fit(train, "doc_id", "tokens", [nb.Target("lang", F.col("label"), ALPHA_S)],
                   drop=drop)
    return d, model


def nb_lang_predict(spark: SparkSession, sf: str) -> DataFrame:
    """M1 -> M3 -> N3 on a hash split of documents, class = lang."""
    d, model = _lang_model(spark, sf)
    test = d.where(F.col("is_test")).withColumnRenamed("label", "truth")
    pred = nb.predict(model, test, "doc_id", "tokens", carry=["truth"])
    return pred.select("doc_id", "target", "truth", "pred")


def nb_lang_scores(spark: SparkSession, sf: str) -> DataFrame:
    d, model = _lang_model(spark, sf)
    test = d.where(F.col("is_test"))
    s = nb.score(model, test, "doc_id", "tokens")
    return s.select("doc_id", "label", _r("score", 4).alias("score"))


def nb_lang_model(spark: SparkSession, sf: str) -> DataFrame:
    """Model priors table: (target, label, n_docs, log_prior, base)."""
    _, model = _lang_model(spark, sf)
    return model.priors.select("target", "label", "n_docs", _r("log_prior").alias("log_prior"),
                               _r("base").alias("base"))


def nb_lang_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: Naive Bayes by language, evaluated with a class report."""
    p = nb_lang_predict(spark, sf)
    rep = metrics.class_report(p, "truth", "pred")
    return rep.select("class", _r("precision").alias("precision"), _r("recall").alias("recall"),
                      _r("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


# ---------------------------------------------------------- conversations, 2 targets

def _conv_docs(spark, sf):
    c = read_table(spark, sf, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    d = c.select(key.alias("key"), "role", "turn",
                 count_bucket("turn").alias("turn_bucket"),
                 normalize_tokens_a("text").alias("tokens"))
    return d.withColumn("is_test", in_test("key", SEED, TEST_PCT))


def _conv_targets():
    return [nb.Target("role", F.col("role"), ALPHA_S),
            nb.Target("turn", F.col("turn_bucket"), ALPHA_CUF, missing_alpha=ALPHA_S)]


def _conv_predict(spark, sf, drop=0, ngram=1, key=None):
    d = _conv_docs(spark, sf)
    model = nb.fit(d.where(~F.col("is_test")), "key", "tokens", _conv_targets(),
                   drop=drop, ngram=ngram)
    test = d.where(F.col("is_test"))
    if key is not None:
        test = test.withColumn("key", key)
    pred = nb.predict(model, test, "key", "tokens", carry=["role", "turn_bucket"])
    truth = F.when(F.col("target") == "role", F.col("role")).otherwise(
        F.col("turn_bucket").cast("string"))
    return pred.select("key", "target", truth.alias("truth"), "pred")


def nb_multi_predict(spark, sf):
    """Two targets in one token pass: role (class) and bucketed turn (count)."""
    return _conv_predict(spark, sf)


def nb_duplicate_keys(spark, sf):
    """M3 where rows share their key (the conversation, without the turn): every
    turn keeps its own prediction."""
    return _conv_predict(spark, sf, key=F.split_part("key", F.lit(":"), F.lit(1)))


def nb_drop_top(spark, sf):
    """The 3 most frequent tokens of every label lose their counts."""
    return _conv_predict(spark, sf, drop=3)


def nb_bigram_predict(spark, sf):
    """NB over word bigrams (X10 feeding M1)."""
    return _conv_predict(spark, sf, ngram=2)


def token_counts(spark, sf):
    """A3 over the whole conversations table, both targets at once."""
    d = _conv_docs(spark, sf)
    return nb.token_counts(d, "tokens", _conv_targets())


def log_priors(spark, sf):
    """A1 over the whole conversations table."""
    d = _conv_docs(spark, sf)
    return nb.log_priors(d, _conv_targets()).select(
        "target", "label", "n_docs", _r("log_prior").alias("log_prior"))


def nb_top_tokens(spark, sf):
    """Top 5 tokens per (target, label), ties by token."""
    d = _conv_docs(spark, sf)
    c = nb.token_counts(d, "tokens", _conv_targets())
    return nb.top_tokens(c, 5).select("target", "label", "rank", "token", "cnt")
