"""Quality rules in DataFrame functions only.

The method: a hashed n-gram log-likelihood ratio.  Every text is a bag of
hashed n-grams -- its words, and the pairs of neighbouring word endings -- in
``buckets`` buckets.  One multinomial is counted over trusted documents, one
over the whole corpus; a document's score is the mean over its n-grams of
``ln p_trusted(bucket) - ln p_raw(bucket)``, so long and short texts compare.
A fixed threshold on the score decides for every document.

Counting is one hash aggregation over the buckets (combined map-side; two
numbers per bucket leave a task), so the table that reaches the driver is
bounded by ``buckets`` whatever the corpus.  It goes back into the scoring
expression as one constant array: scoring is a narrow pass without a shuffle."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEP, table

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
POS_BITS = 24       # word positions of a packed window key; longer texts use the plain form


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, though it is used in lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, WORD_SEP))


def _same_window(w: Column, p: Column, q: Column, size: int) -> Column:
    out = F.get(w, p) == F.get(w, q)
    for k in range(1, size):
        out = out & (F.get(w, p + k) == F.get(w, q + k))
    return out


def _packed_repeats(w: Column, n: Column, size: int) -> Column:
    """Start positions of the windows found twice or more: keys of 40 hash bits
    and the position are sorted, and neighbours of equal hash compared in full."""
    mask = (1 << POS_BITS) - 1
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.shiftleft(
        F.xxhash64(*[F.get(w, i + k) for k in range(size)]), POS_BITS).bitwiseOR(i.cast("bigint"))))
    pos = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

    def same(x, y):
        return F.coalesce((F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS))
                          & _same_window(w, pos(x), pos(y), size), F.lit(False))

    return let(keys, lambda s: F.transform(
        F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1))), pos))


def _plain_repeats(w: Column, n: Column, size: int) -> Column:
    """The same for texts with more words than a packed position holds: windows
    sorted as strings with their positions."""
    keys = F.array_sort(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(
        F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]).alias("g"), i.alias("i"))))
    return let(keys, lambda s: F.transform(F.filter(s, lambda x, j: F.coalesce(
        x["g"] == F.get(s, j + 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, j - 1)["g"], F.lit(False))),
        lambda x: x["i"]))


def repeated_words(w: Column, size: int = 3, pos_bits: int = POS_BITS) -> Column:
    """Number of words that lie in a ``size``-word window found twice or more in
    the text, the first one included."""
    def count(w):
        n = F.size(w)
        starts = F.when(n < 1 << pos_bits, _packed_repeats(w, n, size)).otherwise(_plain_repeats(w, n, size))
        covered = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + size - 1)))
        return F.when(n <= size, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))

    return let(w, count).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                     lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint")


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Hashed n-grams of a text: each word, and each pair of neighbouring word endings."""
    def both(w):
        ends = F.transform(w, lambda x: F.substring(x, -3, 3))
        pairs = let(ends, lambda e: F.transform(e, lambda x, i: F.xxhash64(x, F.get(e, i + 1))))
        return F.transform(F.concat(F.transform(w, lambda x: F.xxhash64(x)), pairs),
                           lambda h: F.pmod(h, F.lit(buckets)).cast("int"))

    return let(w, both)


def trusted_ids(labels: DataFrame, id_col: str, sample: int) -> DataFrame:
    """At most ``sample`` trusted documents, chosen by the hash of their id."""
    return (labels.where(F.col("quality") == 1).where(F.col(id_col).isNotNull()).select(id_col).distinct()
            .orderBy(F.xxhash64(id_col), id_col).limit(sample))


def fit_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, *, buckets: int,
               sample: int) -> list[float]:
    """``ln p_trusted - ln p_raw`` of every bucket, add-one smoothed; the trusted
    rows are a bounded sample of labelled ids, the raw counts cover all rows."""
    good = trusted_ids(labels, id_col, sample).select(F.col(id_col).alias("_good"))
    grams = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(good), F.col("_id") == F.col("_good"), "left")
             .select(F.when(F.col("_good").isNotNull(), 1).otherwise(0).alias("t"),
                     F.explode(ngram_buckets(words(F.col("_text")), buckets)).alias("b")))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in counts:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    base = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(t) - math.log(r) + base, 6) for r, t in zip(raw, target)]


def _constant_array(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def quality_columns(text: Column, ratios: list[float], threshold: float) -> Column:
    """Struct of the measures, the score and the verdict of one text."""
    def measure(w):
        n = F.size(w).cast("bigint")
        grams = ngram_buckets(w, len(ratios))
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(_constant_array(ratios), b))
        plain = F.coalesce(text, F.lit(""))
        return F.struct(
            n.alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            (F.length(plain) - F.length(F.regexp_replace(plain, f"[{SYMBOLS}]", ""))).cast("bigint")
            .alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.when(n == 0, F.lit(0.0)).otherwise(total / (2 * n)).alias("score"))

    m = let(words(text), measure)

    def verdict(m):
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                  "n_repeat_words", "score")],
                        failed.alias("base_failed"), (~failed & (m["score"] >= threshold)).alias("kept"))

    return let(m, verdict)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  buckets: int = 1 << 14, sample: int = 20_000, threshold: float = -0.3,
                  ratios: list[float] | None = None) -> DataFrame:
    """The input rows with one more struct column ``quality`` (an input column of
    that name is replaced): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed, kept.

    A null or empty text has no words, so it fails the base rule.  Ties and
    repeated rows are judged alike; an empty table gives an empty result; with
    no trusted rows the ratio is that of an unseen document everywhere."""
    if ratios is None:
        ratios = fit_ratios(docs, labels, id_col, text_col, buckets=buckets, sample=sample)
    return docs.withColumn("quality", quality_columns(F.col(text_col), ratios, threshold))


def op3_hashed_ngram_llr(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (quality_rules(docs, table(spark, sf_dir, "labels"))
            .select("doc_id", "quality.*"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
              buckets: int = 1 << 14, sample: int = 20_000, threshold: float = -0.3) -> DataFrame:
    """The rows that are kept, with their own columns only."""
    ratios = fit_ratios(docs, labels, id_col, text_col, buckets=buckets, sample=sample)
    return docs.where(quality_columns(F.col(text_col), ratios, threshold)["kept"])
