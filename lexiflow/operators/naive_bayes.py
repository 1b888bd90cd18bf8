"""Multi-target Naive Bayes expressed as aggregations and joins.

Model (all long tables, never a map column):

* ``priors``  (target, label, label_rank, n_docs, n_tokens, log_prior, base)
* ``weights`` (token, ws): one row per vocabulary token with an array, by label
  position, of the difference between the token's log-probability and the label's
  baseline ``base = ln(alpha / den)`` (0 where the label lacks the token).

Scoring uses the sparse form (R1)::

    score(d, l) = log_prior(l) + n_known(d) * base(l) + sum_t tf(d, t) * delta(t, l)

which equals ``log_prior + sum_{t in d, t in V} ln((cnt(l, t) + alpha) / den(l))``
with unseen pairs scoring ``cnt = 0``.  ``den(l) = n_docs(l) + alpha * V`` by
default (document count, as the original model does) or ``n_tokens(l) + alpha * V``.

Physical plan of fit: explode tokens (no shuffle) -> unpivot targets in the
same row pipeline -> one hash aggregation on (target, label, token) with
map-side partial aggregation, so a token present in a third of all documents
costs one partial row per task.  Predict: number the rows -> explode -> join to
``weights`` on token (broadcast only under a row bound, else tf per (row, token)
and a shuffle join with AQE skew splitting) -> one aggregation per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams as ngram_expr
from ..session import cut_lineage
from .joins import DEFAULT_BROADCAST_BYTES, DEFAULT_BROADCAST_ROWS, checked_broadcast
from .ranking import top_k_per_group

MAX_LABELS = 100_000


@dataclass
class Target:
    """One prediction target: a label expression and its smoothing.

    ``missing_alpha`` is the numerator used for a token that was removed from
    the label's counts by ``drop`` (the original uses the class smoothing
    ``alpha_s`` there even for count targets)."""
    name: str
    label: Column
    alpha: float
    missing_alpha: float | None = None


@dataclass
class NBModel:
    priors: DataFrame
    weights: DataFrame
    labels: list = field(default_factory=list)   # collected (target, label, rank, log_prior, base)
    targets: list = field(default_factory=list)
    ngram: int = 1
    weight_rows: int | None = None
    counts: DataFrame | None = None


def _label_rank_table(priors_rows):
    """Order labels per target: numerically when every label is a number, else as text."""
    by_t = {}
    for r in priors_rows:
        by_t.setdefault(r["target"], []).append(r["label"])
    ranks = {}
    for t, labs in by_t.items():
        try:
            ordered = sorted(labs, key=lambda x: float(x))
        except (TypeError, ValueError):
            ordered = sorted(labs)
        for i, lab in enumerate(ordered):
            ranks[(t, lab)] = i
    return ranks


def doc_terms(df: DataFrame, id_col: str, tokens_col: str, ngram: int = 1,
              carry=()) -> DataFrame:
    """(id, *carry, token) rows, one per occurrence (X10 applied when ngram > 1)."""
    toks = F.col(tokens_col) if ngram == 1 else ngram_expr(F.col(tokens_col), ngram)
    return df.select(F.col(id_col), *carry, F.explode_outer(toks).alias("token")).where(
        F.col("token").isNotNull())


def label_stats(df: DataFrame, tokens_col: str, targets: list[Target], ngram: int = 1) -> DataFrame:
    """One aggregation over the text: (target, label, token, cnt) where the row
    with ``token`` NULL carries the label's document count.  Explode and unpivot
    run inside the scan's pipeline; the hash aggregation combines map-side."""
    lab = F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("target"), t.label.cast("string").alias("label"))
        for t in targets])).alias("tl")
    toks = F.col(tokens_col) if ngram == 1 else ngram_expr(F.col(tokens_col), ngram)
    with_doc = F.concat(toks, F.array(F.lit(None).cast("string")))
    return (df.select(with_doc.alias("_toks"), lab)
            .select("tl.target", "tl.label", F.explode_outer("_toks").alias("token"))
            .where(F.col("label").isNotNull())
            .groupBy("target", "label", "token").agg(F.count(F.lit(1)).alias("cnt")))


def fit(df: DataFrame, id_col: str, tokens_col: str, targets: list[Target], ngram: int = 1,
        drop: int = 0, denominator: str = "docs", materialize: bool = True) -> NBModel:
    """M1: fit priors and per-label token counts for several targets in one pass.

    The single aggregation over the training text is materialised once (a
    reliable checkpoint in the shared folder), so priors, vocabulary size and
    weights all read the small aggregated table, never the text again."""
    if denominator not in ("docs", "tokens"):
        raise ValueError("denominator must be 'docs' or 'tokens'")
    stats = label_stats(df, tokens_col, targets, ngram)
    if materialize:
        stats = cut_lineage(stats, "nb-stats")
    counts = stats.where(F.col("token").isNotNull())
    # A1 + A2 in ONE small job: per label (documents, tokens, distinct tokens)
    # plus one extra row holding the vocabulary size V; bounded by the label
    # count.  The number of weight rows follows from it, so no count job is
    # needed before choosing broadcast or shuffle for scoring.
    vocab = counts.select("token").distinct()
    per_label = stats.groupBy("target", "label").agg(
        F.sum(F.when(F.col("token").isNull(), F.col("cnt"))).cast("bigint").alias("n_docs"),
        F.coalesce(F.sum(F.when(F.col("token").isNotNull(), F.col("cnt"))), F.lit(0))
        .cast("bigint").alias("n_tokens"),
        F.count("token").alias("n_pairs"))
    v_row = vocab.agg(F.count(F.lit(1)).alias("n_pairs")).select(
        F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("bigint").alias("n_docs"), F.lit(None).cast("bigint").alias("n_tokens"),
        "n_pairs")
    collected = per_label.unionByName(v_row).limit(MAX_LABELS + 2).collect()
    rows = [r for r in collected if r["target"] is not None]
    if len(rows) > MAX_LABELS:
        raise ValueError("too many labels for a Naive Bayes target")
    V = next(r["n_pairs"] for r in collected if r["target"] is None)
    weight_rows = V
    alphas = {t.name: float(t.alpha) for t in targets}
    totals = {}
    for r in rows:
        totals[r["target"]] = totals.get(r["target"], 0) + r["n_docs"]

    def _base(r):
        size = r["n_docs"] if denominator == "docs" else r["n_tokens"]
        a_ = alphas[r["target"]]
        return math.log(a_ / (size + a_ * V))
    ranks = _label_rank_table(rows)
    prior_rows = [(r["target"], r["label"], ranks[(r["target"], r["label"])], r["n_docs"],
                   r["n_tokens"], math.log(r["n_docs"] / totals[r["target"]]), _base(r),
                   alphas[r["target"]]) for r in rows]
    spark = df.sparkSession
    # one row per label: a literal table of bounded size
    priors = spark.createDataFrame(
        prior_rows, "target string, label string, label_rank int, n_docs bigint, "
                    "n_tokens bigint, log_prior double, base double, alpha double")
    alpha = F.create_map(*[x for t in targets for x in (F.lit(t.name), F.lit(float(t.alpha)))])
    missing = F.create_map(*[x for t in targets for x in (
        F.lit(t.name), F.lit(float(t.missing_alpha if t.missing_alpha is not None else t.alpha)))])

    w = counts.withColumn("alpha", alpha[F.col("target")])
    w = w.withColumn("delta", F.ln(F.col("cnt") + F.col("alpha")) - F.ln(F.col("alpha")))
    if drop > 0:
        # The `drop` most frequent tokens of each (target, label) lose their
        # counts; their numerator becomes the target's missing-word smoothing.
        top = top_k_per_group(counts, ["target", "label"],
                              [F.col("cnt").desc(), F.col("token")], drop)
        top = top.select("target", "label", "token", F.lit(True).alias("_dropped"))
        w = (w.join(top, ["target", "label", "token"], "left")
             .withColumn("delta", F.when(F.col("_dropped"),
                                         F.ln(missing[F.col("target")]) - F.ln(F.col("alpha")))
                         .otherwise(F.col("delta"))))
    labels = sorted(((p[0], p[1], p[2], p[5], p[6]) for p in prior_rows),
                    key=lambda x: (x[0], x[2]))
    # one row per token: its weights by label position, 0 where the label lacks it
    place = spark.createDataFrame([(t, lab, i) for i, (t, lab, *_r) in enumerate(labels)],
                                  "target string, label string, place int")
    by_token = (w.join(place, ["target", "label"]).groupBy("token")
                .agg(F.map_from_entries(F.collect_list(F.struct("place", "delta"))).alias("m")))
    weights = by_token.select("token", F.transform(
        F.sequence(F.lit(0), F.lit(max(0, len(labels) - 1))),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("ws"))
    if materialize:
        weights = cut_lineage(weights, "nb-weights")
    return NBModel(priors=priors, weights=weights, labels=labels,
                   targets=[t.name for t in targets], ngram=ngram, counts=counts,
                   weight_rows=weight_rows)


def _weights_for_join(model: NBModel, max_rows: int):
    """(weights, broadcast?) -- broadcast only under a proven bound of rows and of bytes:
    a row holds a token and one double per label."""
    if model.weight_rows is None:
        model.weight_rows = model.weights.count()
    size = model.weight_rows * (8 * len(model.labels) + 64)
    small = model.weight_rows <= max_rows and size <= DEFAULT_BROADCAST_BYTES
    return checked_broadcast(model.weights, max_rows, known_rows=model.weight_rows, known_bytes=size), small


def score_wide(model: NBModel, df: DataFrame, id_col: str, tokens_col: str,
               max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, carry=()) -> DataFrame:
    """One row per input row (also when ids repeat), one score column per
    (target, label).

    Broadcast model: every token occurrence probes one weight row in the
    scan's pipeline and the per-document sum combines map-side (a document
    lives in one task), so the only shuffle carries one row per document.
    Shuffle model: the rows are stored with their number, and occurrences are
    folded to tf per (row, token) so the join on token moves each distinct pair once.

    ``carry`` names per-document columns (e.g. the true label) that ride
    along as extra grouping keys, so no join back to the documents is needed."""
    carry = list(carry)
    weights, small = _weights_for_join(model, max_broadcast_rows)
    toks = F.col(tokens_col) if model.ngram == 1 else ngram_expr(F.col(tokens_col), model.ngram)
    toks = F.coalesce(toks, F.array().cast("array<string>"))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), id_col, *carry, toks.alias("_toks"))
    keys = ["_row", id_col, *carry]
    if small:
        # the null token keeps rows without any known token (their scores are the priors)
        each = rows.select(*keys, F.explode(F.concat("_toks", F.array(F.lit(None).cast("string"))))
                           .alias("token"), F.lit(1).alias("tf"))
        contrib = each.join(weights, "token", "left").select(*keys, "tf", "ws")
    else:
        rows = cut_lineage(rows, "nb-rows")
        tf = (rows.select(*keys, F.explode("_toks").alias("token")).where(F.col("token").isNotNull())
              .groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf")))
        contrib = (tf.join(weights, "token").select(*keys, "tf", "ws")
                   .unionByName(rows.select(*keys, F.lit(1).cast("bigint").alias("tf"),
                                            F.lit(None).cast("array<double>").alias("ws"))))
    sums = contrib.groupBy(*keys).agg(
        F.sum(F.when(F.col("ws").isNotNull(), F.col("tf"))).alias("_s0"),
        *[F.sum(F.col("tf") * F.get("ws", F.lit(i - 1))).alias(f"_s{i}") for i in range(1, len(model.labels) + 1)])
    out = [F.col(id_col), *carry]
    n_known = F.coalesce(F.col("_s0"), F.lit(0.0))
    for i, (t, l, r, lp, base) in enumerate(model.labels, start=1):
        out.append((F.lit(lp) + n_known * F.lit(base) + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)))
                   .alias(f"s{i}"))
    return sums.select(*out)


def score(model: NBModel, df: DataFrame, id_col: str, tokens_col: str,
          max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """M2/M3 scores in long form: (id, target, label, score)."""
    wide = score_wide(model, df, id_col, tokens_col, max_broadcast_rows)
    entries = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(l).alias("label"),
                                 F.col(f"s{i}").alias("score"))
                        for i, (t, l, *_r) in enumerate(model.labels, start=1)])
    return wide.select(id_col, F.explode(entries).alias("e")).select(
        id_col, "e.target", "e.label", "e.score")


def predict(model: NBModel, df: DataFrame, id_col: str, tokens_col: str,
            max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, carry=()) -> DataFrame:
    """M3 + N3: (id, *carry, target, pred); highest score, lowest label on ties."""
    carry = list(carry)
    wide = score_wide(model, df, id_col, tokens_col, max_broadcast_rows, carry)
    per_target = []
    for t in model.targets:
        cands = [F.struct(F.col(f"s{i}").alias("s"), F.lit(-r).alias("nr"), F.lit(l).alias("label"))
                 for i, (tt, l, r, *_x) in enumerate(model.labels, start=1) if tt == t]
        best = F.greatest(*cands) if len(cands) > 1 else cands[0]
        per_target.append(F.struct(F.lit(t).alias("target"), best["label"].alias("pred")))
    return wide.select(id_col, *carry, F.explode(F.array(*per_target)).alias("p")).select(
        id_col, *carry, "p.target", "p.pred")


def top_tokens(model_counts: DataFrame, k: int) -> DataFrame:
    """Top-k tokens per (target, label) by count desc, token asc."""
    return top_k_per_group(model_counts, ["target", "label"],
                           [F.col("cnt").desc(), F.col("token")], k)


def token_counts(df: DataFrame, tokens_col: str, targets: list[Target], ngram: int = 1) -> DataFrame:
    """A3 on its own: (target, label, token, cnt)."""
    lab = F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("target"), t.label.cast("string").alias("label"))
        for t in targets])).alias("tl")
    toks = F.col(tokens_col) if ngram == 1 else ngram_expr(F.col(tokens_col), ngram)
    return (df.select(toks.alias("_toks"), lab)
            .select("tl.target", "tl.label", F.explode_outer("_toks").alias("token"))
            .where(F.col("label").isNotNull() & F.col("token").isNotNull())
            .groupBy("target", "label", "token").agg(F.count(F.lit(1)).alias("cnt")))


def log_priors(df: DataFrame, targets: list[Target]) -> DataFrame:
    """A1: (target, label, n_docs, log_prior)."""
    lab = F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("target"), t.label.cast("string").alias("label"))
        for t in targets])).alias("tl")
    c = (df.select(lab).select("tl.target", "tl.label").where(F.col("label").isNotNull())
         .groupBy("target", "label").agg(F.count(F.lit(1)).alias("n_docs")))
    return c.withColumn("log_prior", F.ln(F.col("n_docs") / F.sum("n_docs").over(
        Window.partitionBy("target"))))


# --------------------------------------------------------------------- S9 persistence

def save(model: NBModel, path: str) -> None:
    """Write the model as Parquet tables plus a one-row metadata table (all
    through Spark, so ``path`` may be any shared file system)."""
    import json
    spark = model.priors.sparkSession
    model.priors.write.mode("overwrite").parquet(f"{path}/priors")
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    meta = {"targets": model.targets, "ngram": model.ngram,
            "labels": [list(x) for x in model.labels], "weight_rows": model.weight_rows}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/meta")


def load(spark, path: str) -> NBModel:
    import json
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    return NBModel(priors=spark.read.parquet(f"{path}/priors"),
                   weights=spark.read.parquet(f"{path}/weights"),
                   labels=[tuple(x) for x in meta["labels"]], targets=meta["targets"],
                   ngram=meta["ngram"], weight_rows=meta.get("weight_rows"))
