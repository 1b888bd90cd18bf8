"""Toxicity by class-conditional Kneser-Ney bigram models.

Two word bigram models, one of toxic and one of ordinary labelled text, read
every text; a document's margin is the difference of the two log-likelihoods
per token.  Both classes are smoothed through the same counts, pooled over the
classes: a pair's class counts are discounted towards what the pair's last word
predicts, a word's towards what the class sizes predict, by a number of standard
errors, so rare expressions fall back on the shared counts altogether.  Counts
are of distinct contexts (documents), as Kneser-Ney has it, not of occurrences.
An expression that says nothing about the class adds exactly 0 to the margin,
whatever its language or spelling.

Labels are learnt from a bounded sample of labelled rows: ids whose
``crc32(id) mod 3`` is 0 give the counts, those with 2 the calibration (a
logistic curve over the margin per token and the margin per root of tokens),
those with 1 nothing.  The model is bounded by that sample; scoring is one
narrow pass with the model broadcast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import LOWER, UPPER, crc_of_id, small_batches, table, utf8, words_of
from .quality import let, words

FOLDS, HELD_OUT, FIT, CALIBRATE = 3, 1, 0, 2


class ToxicModel:
    """Log-likelihood ratios by word and by word pair, and the calibration."""

    def __init__(self, unigram: dict, bigram: dict, curve=(0.0, 0.0, 0.0)):
        self.unigram, self.bigram, self.curve = unigram, bigram, curve

    def margin(self, text: bytes | None) -> tuple[float, int]:
        """(log-likelihood toxic minus ordinary, tokens)."""
        ws = words_of(text)
        uni, total = self.unigram.get, 0.0
        for w in ws:
            total += uni(w, 0.0)
        known, prev = self.bigram, b""
        for w in ws:
            row = known.get(prev)
            if row is not None and w in row:
                total += row[w] - uni(w, 0.0)
            prev = w
        return total, len(ws)

    def score(self, total: float, n: int) -> float:
        if not self.unigram:
            return 0.0
        x = self.curve[0]
        if n:
            x += self.curve[1] * total / n + self.curve[2] * total / math.sqrt(n)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fold: int,
              per_class: int) -> DataFrame:
    """Texts of a bounded number of labelled rows, chosen by the hash of their id:
    for the counts ``per_class`` toxic and four times as many ordinary ones, for
    the calibration ``2 * per_class`` rows as they come."""
    lab = (labels.select(F.col(id_col).alias("lid"), F.col("toxic").cast("int").alias("toxic"))
           .where("lid is not null and toxic in (0, 1)")
           .where(F.pmod(crc_of_id("lid"), F.lit(FOLDS)) == fold)
           .groupBy("lid").agg(F.max("toxic").alias("toxic")))
    order = (F.xxhash64("lid"), F.col("lid"))
    if fold == FIT:
        bad = lab.where("toxic = 1").orderBy(*order).limit(per_class)
        good = lab.where("toxic = 0").orderBy(*order).limit(4 * per_class)
        lab = bad.unionByName(good)
    else:
        lab = lab.orderBy(*order).limit(2 * per_class)
    return (docs.select(F.col(id_col).alias("lid2"), F.col(text_col).alias("text"))
            .join(F.broadcast(lab), F.col("lid2") == F.col("lid")).select("lid", "toxic", "text"))


def _one_per_group(sample: DataFrame) -> DataFrame:
    """One sampled text of those whose smallest hash of four neighbouring words is
    the same: copies and most near copies are not independent evidence."""
    def smallest(w):
        return F.array_min(F.transform(w, lambda x, i: F.xxhash64(
            x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3))))

    keyed = sample.withColumn("low", let(words(F.translate("text", UPPER, LOWER)), smallest))
    return (keyed.groupBy("low").agg(F.min("lid").alias("lid")).select("lid")
            .join(sample, "lid").dropDuplicates(["lid"]).select("toxic", "text"))


def _document_counts(sample: DataFrame) -> DataFrame:
    """Per expression (a word w, or a pair v w; v empty at the start of a text) the
    toxic and the ordinary documents that hold it.  Kneser-Ney counts contexts instead of
    occurrences; the context here is the document, so a word that one text
    repeats a thousand times weighs once."""
    def expressions(w):      # as strings: words hold no space
        pairs = F.transform(w, lambda x, i: F.concat_ws(" ", F.coalesce(F.get(w, i - 1), F.lit("")), x))
        return F.array_distinct(F.concat(w, pairs))

    counts = (sample.select("toxic", F.explode(let(words(F.translate("text", UPPER, LOWER)), expressions)).alias("e"))
              .groupBy("e").agg(F.sum("toxic").alias("nt"), F.sum(1 - F.col("toxic")).alias("no")))
    pair = F.instr("e", " ") > 0
    return counts.select(F.when(pair, F.substring_index("e", " ", 1)).otherwise("").alias("v"),
                         F.substring_index("e", " ", -1).alias("w"), pair.alias("pair"), "nt", "no")


def _discounted(nt: np.ndarray, no: np.ndarray, odds: np.ndarray, z: float) -> np.ndarray:
    """Log ratio of the class estimates against the backoff's.  The backoff expects
    the pooled count to fall to the classes by ``odds``; the deviation of the toxic
    count from that is discounted by ``z`` standard errors, and what is left moves
    mass between the classes.  Rare expressions keep the backoff's ratio exactly."""
    k = nt + no
    share = odds / (1 + odds)
    et, eo = k * share, k * (1 - share)
    dev = nt - et
    # the second term is Bernstein's, for the wider tails of small counts
    move = np.sign(dev) * np.maximum(np.abs(dev) - z * np.sqrt(k * share * (1 - share)) - z * z / 6, 0)
    return np.log1p(move / et) - np.log1p(-move / eo)


def _ratios(counts: DataFrame, n_toxic: int, n_ordinary: int, z: float, least: int) -> tuple[dict, dict]:
    """Class ratios of words, and of word pairs that say more than their last word."""
    if not n_toxic or not n_ordinary:
        return {}, {}
    uni = counts.where(~F.col("pair"))
    w = uni.where(F.col("nt") + F.col("no") >= least).toPandas()
    nt, no = w.nt.to_numpy(float), w.no.to_numpy(float)
    u = _discounted(nt, no, np.full(len(w), n_toxic / n_ordinary), z)
    ratio = {x.encode(): r for x, r in zip(w.w, u.tolist())}
    ctx = uni.select(F.col("w").alias("v"), F.col("nt").alias("ct"), F.col("no").alias("co"))
    kept = (counts.where(F.col("pair") & (F.col("nt") + F.col("no") >= least))
            .join(ctx, "v").where("ct > 0 and co > 0").toPandas())
    back = np.array([ratio.get(x.encode(), 0.0) for x in kept.w])
    odds = kept.ct.to_numpy(float) / kept.co.to_numpy(float) * np.exp(back) if len(kept) else back
    more = _discounted(kept.nt.to_numpy(float), kept.no.to_numpy(float), odds, z)
    bigram: dict = {}
    for v, x, b, m in zip(kept.v, kept.w, back.tolist(), more.tolist()):
        if m:
            bigram.setdefault(v.encode(), {})[x.encode()] = b + m
    return {x: r for x, r in ratio.items() if r}, bigram


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression on columns scaled to unit root mean square:
    Newton steps, halved until the objective falls."""
    scale = np.sqrt((x ** 2).mean(axis=0))
    scale[scale == 0] = 1.0
    a = np.column_stack([np.ones(len(x)), x / scale])
    pull = np.diag([1e-6] + [ridge] * x.shape[1])

    def cost(w):
        t = a @ w
        return np.sum(np.logaddexp(0, t) - y * t) + 0.5 * w @ pull @ w

    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - y) + pull @ w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, grad)
        size = 1.0
        while size > 1e-6 and cost(w - size * step) > cost(w):
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def _margins(model: ToxicModel, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("total double, n long, score double")
    def margins(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [m.margin(t) for t in text]
        return pd.DataFrame({"total": [r[0] for r in rows], "n": [r[1] for r in rows],
                             "score": [m.score(*r) for r in rows]},
                            index=text.index).astype({"total": float, "n": "int64", "score": float})

    return margins


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 per_class: int = 2000, z: float = 3.5, least: int = 5) -> ToxicModel:
    """Learn from at most ``5 * per_class`` labelled rows for the counts and
    ``2 * per_class`` for the calibration; ``z`` is the discount in standard errors, ``least``
    the fewest documents an expression must be in.  Without toxic rows the model
    scores 0 everywhere."""
    small_batches(docs)
    scratch = Scratch(docs.sparkSession)
    fit = scratch.cut(_one_per_group(scratch.cut(
        _labelled(docs, labels, id_col, text_col, FIT, per_class), "sample")), "fit")
    sizes = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    counts = scratch.cut(_document_counts(fit), "counts")
    model = ToxicModel(*_ratios(counts, sizes.get(1, 0), sizes.get(0, 0), z, least))
    scratch.release()
    cal = _labelled(docs, labels, id_col, text_col, CALIBRATE, per_class)
    got = cal.select("toxic", _margins(model, docs.sparkSession)(utf8("text")).alias("m")).select(
        "toxic", "m.total", "m.n").toPandas()
    if not model.unigram or got.toxic.nunique() < 2:
        return ToxicModel(model.unigram, model.bigram, (-2.0, 20.0, 1.0))
    n = np.maximum(got.n.to_numpy(float), 1)
    total = got.total.to_numpy()
    model.curve = tuple(_logistic(np.column_stack([total / n, total / np.sqrt(n)]), got.toxic.to_numpy(float)))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
             threshold: float = 0.7, per_class: int = 2000, model: ToxicModel | None = None) -> DataFrame:
    """The input rows with one more struct column ``toxicity`` (an input column of
    that name is replaced): score in 0..1 and predicted (1 from ``threshold`` up).

    A null or empty text scores as the prior; repeated rows score alike; only the
    text is read for a score."""
    model = model or fit_toxicity(docs, labels, id_col, text_col, per_class=per_class)
    score = _margins(model, docs.sparkSession)(utf8(text_col))["score"]
    out = docs.withColumn("toxicity", score)
    return out.withColumn("toxicity", F.struct(
        F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted")))


def op6_class_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", (F.pmod(crc_of_id("doc_id"), F.lit(FOLDS)) == HELD_OUT).alias("held_out"), "toxicity.*")


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  threshold: float = 0.7, per_class: int = 2000) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns only."""
    model = fit_toxicity(docs, labels, id_col, text_col, per_class=per_class)
    return docs.where(_margins(model, docs.sparkSession)(utf8(text_col))["score"] < threshold)
