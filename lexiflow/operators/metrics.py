"""Evaluation tables (A5-A12, A15, A16) as single aggregations.

Every metric is computed from one pass over the predictions; per-class tables
have one row per class (bounded by the class count), so the summary rows are
computed over that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 10_000


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0 (ANSI mode raises on division by zero)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def accuracy(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """One row (accuracy, n)."""
    return df.agg(F.avg((F.col(true_col) == F.col(pred_col)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Per class: support, predicted, tp — from one aggregation."""
    t = F.col(true_col).cast("string")
    p = F.col(pred_col).cast("string")
    e = F.explode(F.array(
        F.struct(t.alias("cls"), F.lit(1).alias("s"), F.lit(0).alias("p"),
                 (t == p).cast("int").alias("tp")),
        F.struct(p.alias("cls"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("tp"))))
    return (df.select(e.alias("e")).select("e.*")
            .groupBy("cls").agg(F.sum("s").cast("bigint").alias("support"),
                                F.sum("p").cast("bigint").alias("predicted"),
                                F.sum("tp").cast("bigint").alias("tp")))


def class_report(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """(class, precision, recall, f1, support) + accuracy / macro avg / weighted avg rows.

    One pipeline: the per-class table (one row per class) fans each class out
    into its own row and its share of the three summary rows, and a second
    aggregation over that small table finishes all of them -- the predictions
    are computed once, not once per output branch."""
    cc = class_counts(df, true_col, pred_col)
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    per = cc.select("cls", "support", "tp", prec.alias("p"), rec.alias("r"))
    per = per.withColumn("f", _safe_div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))

    def part(kind, name):
        return F.struct(F.lit(kind).alias("kind"), name.alias("class"), "p", "r", "f",
                        "support", "tp")
    fan = per.select(F.explode(F.array(
        part(0, F.col("cls")), part(1, F.lit("accuracy")), part(2, F.lit("macro avg")),
        part(3, F.lit("weighted avg")))).alias("e")).select("e.*")
    g = fan.groupBy("kind", "class").agg(
        F.count(F.lit(1)).alias("k"), F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.sum("p").alias("sp"), F.sum("r").alias("sr"), F.sum("f").alias("sf"),
        F.sum(F.col("p") * F.col("support")).alias("wp"),
        F.sum(F.col("r") * F.col("support")).alias("wr"),
        F.sum(F.col("f") * F.col("support")).alias("wf"))
    kind = F.col("kind")

    def pick(plain, weighted, acc):
        return (F.when(kind == 1, acc).when(kind == 3, weighted)
                .otherwise(_safe_div(plain, F.col("k"))))
    none = F.lit(None).cast("double")
    return g.select("class",
                    pick(F.col("sp"), _safe_div(F.col("wp"), F.col("n")), none).alias("precision"),
                    pick(F.col("sr"), _safe_div(F.col("wr"), F.col("n")), none).alias("recall"),
                    pick(F.col("sf"), _safe_div(F.col("wf"), F.col("n")),
                         _safe_div(F.col("tp"), F.col("n"))).alias("f1"),
                    F.col("n").alias("support"))


def macro_micro_precision(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Macro precision (mean over classes) and micro precision (= accuracy)."""
    cc = class_counts(df, true_col, pred_col)
    return cc.agg(F.avg(_safe_div(F.col("tp"), F.col("predicted"))).alias("macro_precision"),
                  _safe_div(F.sum("tp"), F.sum("predicted")).alias("micro_precision"))


def macro_f1(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Macro-averaged F1 (the search score)."""
    rep = class_report(df, true_col, pred_col)
    return rep.where(F.col("class") == "macro avg").select(F.col("f1").alias("macro_f1"))


def confusion(df: DataFrame, true_col: str, pred_col: str, classes: list | None = None) -> DataFrame:
    """A5: (true, pred, n) on the full class x class grid, zeros kept, plus
    ``share`` = n / row total (the row-normalised matrix, N5).

    The grid is built from the counts themselves: the sorted class list (one
    row, at most MAX_CLASSES names -- enforced) is exploded twice, so there is
    no cross join, no driver round trip and the predictions are aggregated
    once (both uses read the same aggregation)."""
    t = F.col(true_col).cast("string").alias("true_label")
    p = F.col(pred_col).cast("string").alias("pred_label")
    counts = df.groupBy(t, p).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        names = (counts.select(F.explode(F.array("true_label", "pred_label")).alias("c"))
                 .where(F.col("c").isNotNull())
                 .agg(F.array_sort(F.collect_set("c")).alias("cls")))
        names = names.select(F.when(F.size("cls") <= MAX_CLASSES, F.col("cls")).otherwise(
            F.raise_error(F.lit("too many classes for a confusion matrix"))).alias("cls"))
    else:
        names = df.sparkSession.range(1).select(
            F.array(*[F.lit(str(c)) for c in classes]).cast("array<string>").alias("cls"))
    grid = (names.select(F.explode("cls").alias("true_label"), "cls")
            .select("true_label", F.explode("cls").alias("pred_label")))
    full = grid.join(counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return full.withColumn("share", _safe_div(
        F.col("n"), F.sum("n").over(Window.partitionBy("true_label"))))


def confusion_wide(conf: DataFrame, classes: list) -> DataFrame:
    """Wide form of A5: one row per true label, one column per predicted label."""
    return conf.groupBy("true_label").pivot("pred_label", classes).agg(F.first("n"))


def off_by_histogram(df: DataFrame, true_col: str, pred_col: str, max_k: int = 4) -> DataFrame:
    """A11 (first half): for k = 0..max_k, percent of rows with |true - pred| = k.

    One aggregation over the predictions; zero rows for absent k and the
    total come from the small per-k table, so the input is read once."""
    d = F.abs(F.col(true_col) - F.col(pred_col)).cast("bigint")
    g = df.groupBy(d.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    zeros = df.sparkSession.range(0, max_k + 1).select(F.col("id").alias("k"),
                                                       F.lit(0).cast("bigint").alias("n"))
    u = g.unionByName(zeros).groupBy("k").agg(F.sum("n").alias("n"))
    u = u.withColumn("_total", F.sum("n").over(Window.partitionBy()))   # <= distinct k rows
    return u.where(F.col("k").between(0, max_k)).select(
        "k", (100.0 * _safe_div(F.col("n"), F.col("_total"))).alias("pct"))


def mean_abs_error_by(df: DataFrame, target_col: str, true_col: str, pred_col: str) -> DataFrame:
    """A11 (second half): mean |pred - true| per target."""
    return df.groupBy(target_col).agg(
        F.avg(F.abs(F.col(pred_col) - F.col(true_col))).alias("mae"))


def regression_metrics(df: DataFrame, true_col: str, pred_col: str,
                       group_col: str | None = None) -> DataFrame:
    """A10: mse, rmse, mae, r2 (r2 = 1 - SSE / (n * var_pop(y)))."""
    e = F.col(pred_col) - F.col(true_col)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
            F.sum(e * e).alias("_sse"), F.var_pop(F.col(true_col)).alias("_var")]
    g = df.groupBy(group_col) if group_col else df.groupBy()
    out = g.agg(*aggs)
    keep = [group_col] if group_col else []
    return out.select(*keep, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (1.0 - _safe_div(F.col("_sse"), F.col("n") * F.col("_var"))).alias("r2"))


def mape_score(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """100 - 100 * mean|err| / mean(label)."""
    return df.agg((100.0 - 100.0 * F.avg(F.abs(F.col(pred_col) - F.col(true_col)))
                   / F.avg(F.col(true_col))).alias("score"))


def improvement_pct(base: Column, new: Column) -> Column:
    """Relative improvement in percent."""
    return 100.0 * (new - base) / base


def cross_entropy(df: DataFrame, scores_col: str, label_col: str) -> DataFrame:
    """Mean of -log softmax(scores)[label] (label is 0-based), log-sum-exp stable."""
    s = F.transform(F.col(scores_col), lambda x: x.cast("double"))
    m = F.array_max(s)
    lse = m + F.ln(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    picked = F.element_at(s, F.col(label_col).cast("int") + 1)
    return df.agg(F.avg(lse - picked).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


def argmax_index(scores_col) -> Column:
    """0-based position of the largest score (first on ties)."""
    s = F.col(scores_col) if isinstance(scores_col, str) else scores_col
    return F.array_position(s, F.array_max(s)) - 1
