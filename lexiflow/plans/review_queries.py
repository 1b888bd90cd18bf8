"""Registered queries of the review jobs: TF-IDF vectors from a saved vectoriser, and
saved review models validated on held-out records.  Conversation turns stand in for
reviews: stars and votes follow from the turn and the text by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators.vectorizer import TfidfModel, TfidfVectorizer, vector_entries
from ..sources.readers import read_table
from ..streaming.incremental_nb import scratch_folder
from . import jobs
from .sqltext import clean_tokens_b as clean_tokens_b_sql
from .sqltext import q
from .text_oracle import CONV_KEY, WORD2_RE


def _key():
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def tfidf_vectors(spark, sf):
    """F4 + S9: the entries of every turn's sparse vector, from a saved and loaded model."""
    c = read_table(spark, sf, "conversations").select(_key().alias("key"), word_tokens("text").alias("tokens"))
    path = scratch_folder(spark, "tfidf-model")
    TfidfVectorizer().fit(c).write().save(path)
    return vector_entries(TfidfModel.load(path).transform(c), ["key"]).select(
        "key", "index", F.round("value", 6).alias("weight"))


def tfidf_vectors_sql():
    return f"""WITH t AS (SELECT {CONV_KEY} AS key, regexp_extract_all(lower(text), {q(WORD2_RE)}) AS tokens FROM conversations),
tf AS (SELECT key, token, count(*) AS tf FROM (SELECT key, unnest(tokens) AS token FROM t) GROUP BY ALL),
voc AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS index,
        ln((1 + (SELECT count(*) FROM t)::DOUBLE) / (1 + count(DISTINCT key))) + 1 AS idf FROM tf GROUP BY token),
w AS (SELECT key, index, tf * idf AS w FROM tf JOIN voc USING (token))
SELECT key, index, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM w"""


def _as_reviews(spark, sf, path: str):
    """The turns as a review file (NDJSON)."""
    c = read_table(spark, sf, "conversations")
    (c.select(_key().alias("review_id"), (1 + F.col("turn") % 5).cast("int").alias("stars"),
              F.col("turn").cast("int").alias("useful"), (F.length("text") % 7).cast("int").alias("funny"),
              (F.col("conv_id") % 3).cast("int").alias("cool"), "text").write.json(path))


def review_models_validated(spark, sf):
    """E2 -> S9 -> E3: models fitted, saved, loaded, and the rows each predicts, by label."""
    root = scratch_folder(spark, "review-models")
    _as_reviews(spark, sf, f"{root}/reviews")
    jobs.tfidf_reviews(spark, f"{root}/reviews", gbt_iter=1, lr_iter=20, model_path=f"{root}/models")
    out = jobs.validate_reviews(spark, f"{root}/models", f"{root}/reviews")
    return out["classifier_report"].select(F.col("class").cast("string").alias("class"),
                                           F.col("support").cast("bigint").alias("support"))


def review_models_validated_sql():
    return f"""WITH r AS (SELECT DISTINCT {clean_tokens_b_sql('text', True)} AS tokens, 1 + turn % 5 AS stars, turn,
  length(text) % 7 AS funny, conv_id % 3 AS cool FROM conversations),
c AS (SELECT (stars - 1)::DOUBLE AS label, count(*) AS support FROM r GROUP BY 1)
SELECT label::VARCHAR AS class, support::BIGINT AS support FROM c UNION ALL
SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), sum(support)::BIGINT FROM c"""


def _sums_by_class():
    """A model without parameters: class j scores the sum of coordinates j, j + 10, ..."""
    import numpy as np
    return lambda x: np.stack([x[:, j::10].astype(np.float64).sum(axis=1) for j in range(10)], axis=1)


def _total():
    import numpy as np
    return lambda x: x.astype(np.float64).sum(axis=1)


def model_reports(spark, sf):
    """E4 + M15: a supplied model scored in Arrow batches, reported by target."""
    e = read_table(spark, sf, "embeddings").select("embedding", (F.col("label") + 1).alias("stars"), F.col("label").alias("cool"))
    c = jobs.evaluate_model(e, _sums_by_class, "embedding", "stars", 10)
    r = jobs.evaluate_model(e, _total, "embedding", "cool")["errors"]
    stack = "stack(4, 'mse', mse, 'rmse', rmse, 'mae', mae, 'r2', r2) AS (metric, value)"
    out = (c["accuracy"].selectExpr("'accuracy' AS metric", "accuracy AS value")
           .unionByName(c["loss"].selectExpr("'loss' AS metric", f"`{c['loss'].columns[0]}` AS value"))
           .unionByName(r.selectExpr(stack)))
    return out.select("metric", F.round("value", 4).alias("value"))


def model_reports_sql():
    scores = ", ".join(f"list_sum(list_transform([{', '.join(str(i + 1) for i in range(j, 64, 10))}], "
                       f"lambda i: embedding[i]::DOUBLE))" for j in range(10))
    return f"""WITH s AS (SELECT label, [{scores}] AS s, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS p
  FROM embeddings),
t AS (SELECT (list_position(s, list_max(s)) - 1 = label)::INT AS hit,
  ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) + list_max(s) - s[label + 1] AS loss,
  p - label AS e, label::DOUBLE AS y FROM s),
m AS (SELECT avg(hit) AS a, avg(loss) AS l, avg(e * e) AS mse, avg(abs(e)) AS mae,
  1 - sum(e * e) / (count(*) * var_pop(y)) AS r2 FROM t)
SELECT unnest(['accuracy', 'loss', 'mse', 'rmse', 'mae', 'r2']) AS metric,
  round(unnest([a, l, mse, sqrt(mse), mae, r2]), 4) AS value FROM m"""


SQL = {"model_reports": model_reports_sql, "tfidf_vectors": tfidf_vectors_sql, "review_models_validated": review_models_validated_sql}
