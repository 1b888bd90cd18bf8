"""Lexicon sentiment with contextual rules (X9), on user-supplied tables.

A word's valence changes with the three words before it: boosters add their scalar,
less with distance; negations turn it; ``never so`` / ``never this`` strengthen it,
``without doubt`` leaves it.  Capitals among ordinary words, ``least``, ``but`` and
exclamation or question marks count, too.  The rules are those published for
rule-based social-media sentiment; the tables (valence, boosters, negations) are the
caller's.  ``lexicon.sentiment`` is the plain scoring.

Words meet the tables in one join and come together again by row; the rules are one
array expression over the row's words, with no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SENTIMENT_ALPHA
from .joins import DEFAULT_BROADCAST_ROWS, checked_broadcast

# fixed values of the published rules
CAPITALS, NEGATED, NEVER_SO = 0.733, -0.74, 1.25
FADE = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def words(text_col: str):
    """Cased words of a raw text: stretches without white space, outer punctuation cut
    off unless at most two characters would be left."""
    bare = f"regexp_replace(x, '^{PUNCTUATION}|{PUNCTUATION}$', '')".replace("\\", "\\\\")
    return F.expr(f"transform(filter(split(coalesce(`{text_col}`, ''), '\\\\s+'), x -> x != ''), "
                  f"x -> IF(length({bare}) <= 2, x, {bare}))")


def _context() -> str:
    """The score of word x at place i of the words w; d: whether only some are capitals."""
    p, one, two = "get(w, i - k)", "get(w, i - 1)", "get(w, i - 2)"
    step = (f"IF({p}.b IS NULL, 0D, (IF(v < 0, -{p}.b, {p}.b) + IF({p}.caps AND d, IF(v > 0, {CAPITALS}D, -{CAPITALS}D), 0D))"
            f" * element_at(array({', '.join(f'{f}D' for f in FADE)}), k))")
    so = "IN ('so', 'this')"
    negation = f"""CASE
      WHEN k = 2 AND {p}.t = 'never' AND {one}.t {so} THEN z * {NEVER_SO}D
      WHEN k = 3 AND {p}.t = 'never' AND ({two}.t {so} OR {one}.t {so}) THEN z * {NEVER_SO}D
      WHEN k = 2 AND {p}.t = 'without' AND {one}.t = 'doubt' THEN z
      WHEN k = 3 AND {p}.t = 'without' AND ({two}.t = 'doubt' OR {one}.t = 'doubt') THEN z
      WHEN {p}.n THEN z * {NEGATED}D ELSE z END"""
    first = f"x.v + IF(x.caps AND d, IF(x.v > 0, {CAPITALS}D, -{CAPITALS}D), 0D)"
    folded = (f"aggregate(array(1, 2, 3), {first}, (v, k) -> IF({p} IS NULL OR {p}.v IS NOT NULL, v, "
              f"get(transform(array(v + {step}), z -> {negation}), 0)))")
    least = f"{one}.t = 'least' AND {one}.v IS NULL AND (i = 1 OR {two}.t NOT IN ('at', 'very'))"
    return (f"IF(x.v IS NULL OR x.b IS NOT NULL, 0D, {folded} * IF(coalesce({least}, false), {NEGATED}D, 1D) * "
            f"CASE WHEN but IS NULL OR i = but THEN 1D WHEN i < but THEN {BEFORE_BUT}D ELSE {AFTER_BUT}D END)")


def lexicon_table(valence: DataFrame, boosters: DataFrame, negations: DataFrame) -> DataFrame:
    """One row per token: v (valence), b (booster scalar), n (whether it negates)."""
    empty = F.lit(None).cast("double")
    parts = [valence.select("token", F.col("valence").cast("double").alias("v"), empty.alias("b"), F.lit(False).alias("n")),
             boosters.select("token", empty.alias("v"), F.col("scalar").cast("double").alias("b"), F.lit(False).alias("n")),
             negations.select("token", empty.alias("v"), empty.alias("b"), F.lit(True).alias("n"))]
    return (parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.lower("token").alias("t"))
            .agg(F.max("v").alias("v"), F.max("b").alias("b"), F.max("n").alias("n")))


def contextual_sentiment(df: DataFrame, id_col: str, text_col: str, valence: DataFrame, boosters: DataFrame,
                         negations: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """One row per input row: the id, pos, neg, neu (shares) and compound.

    Tables: valence (token, valence), boosters (token, scalar), negations (token); a word
    with ``n't`` negates as well.  A null, empty or wordless text scores 0 everywhere.
    Of repeated table rows the largest value counts."""
    lex = checked_broadcast(lexicon_table(valence, boosters, negations), max_broadcast_rows)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words(text_col).alias("_w"),
                     *[F.length(F.regexp_replace(F.coalesce(text_col, F.lit("")), f"[^{c}]", "")).alias(n)
                       for c, n in (("!", "_bangs"), ("?", "_asks"))])
    # a last null word keeps rows without words
    each = rows.select("_row", "_id", "_bangs", "_asks", F.posexplode(
        F.concat("_w", F.array(F.lit(None).cast("string")))).alias("at", "word"))
    each = each.withColumns({"t": F.lower("word"), "caps": (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word"))})
    negates = F.coalesce("n", F.lit(False)) | F.col("t").contains("n't")
    met = each.join(lex, "t", "left").groupBy("_row", "_id", "_bangs", "_asks").agg(F.sort_array(F.collect_list(F.when(
        F.col("word").isNotNull(), F.struct("at", "t", "caps", "v", "b", negates.alias("n"))))).alias("w"))
    told = met.selectExpr("*", "exists(w, x -> x.caps) AND NOT forall(w, x -> x.caps) AS d",
                          "nullif(array_position(transform(w, x -> x.t), 'but') - 1, -1) AS but")
    scored = told.selectExpr("_id", "_bangs", "_asks", f"transform(w, (x, i) -> {_context()}) AS s")
    sums = scored.selectExpr(
        "_id", f"least(_bangs, {MOST_EXCLAMATIONS}) * {EXCLAMATION}D + "
               f"CASE WHEN _asks <= 1 THEN 0D WHEN _asks <= 3 THEN _asks * {QUESTION}D ELSE {MANY_QUESTIONS}D END AS marks",
        "aggregate(s, 0D, (a, x) -> a + x) AS total", "aggregate(s, 0D, (a, x) -> a + IF(x > 0, x + 1, 0D)) AS up",
        "aggregate(s, 0D, (a, x) -> a + IF(x < 0, 1 - x, 0D)) AS down",
        "CAST(size(filter(s, x -> x = 0)) AS DOUBLE) AS even")
    sums = sums.selectExpr("_id", "total + sign(total) * marks AS total", "up + IF(up > down, marks, 0D) AS up",
                           "down + IF(down > up, marks, 0D) AS down", "even")
    whole = "(up + down + even)"
    return sums.selectExpr(f"_id AS `{id_col}`", *[f"IF({whole} = 0, 0D, {c} / {whole}) AS {n}"
                                                   for c, n in (("up", "pos"), ("down", "neg"), ("even", "neu"))],
                           f"total / sqrt(total * total + {float(SENTIMENT_ALPHA)}D) AS compound")
