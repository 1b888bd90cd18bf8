"""Dictionary operators over token columns.

A lexicon is a user table ``(token, value)``.  Tokens are exploded with their
position, joined to the lexicon (broadcast only when its size is proven
small, else a shuffle join), and re-assembled per document in position order.
The regrouping shuffles by document id; each group is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SENTIMENT_ALPHA
from .joins import DEFAULT_BROADCAST_ROWS, checked_broadcast


def _positions(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode_outer(tokens_col).alias("pos", "token")).where(
        F.col("token").isNotNull())


def _regroup(df: DataFrame, id_col: str, value: Column, docs: DataFrame) -> DataFrame:
    """Collect values per document in position order; documents without tokens
    get an empty array (kept whole through a left join from the documents)."""
    g = df.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", value.alias("v"))))
                               .alias("_pv"))
    out = docs.select(id_col).join(g, id_col, "left")
    return out.select(id_col, F.coalesce(F.transform("_pv", lambda x: x["v"]),
                                         F.array().cast("array<string>")).alias("tokens"))


def rewrite(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame,
            key: str = "form", value: str = "lemma",
            max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Replace each token by its dictionary form when the lexicon has one."""
    lex = checked_broadcast(lexicon.select(F.col(key).alias("token"), F.col(value).alias("_new")),
                            max_broadcast_rows)
    j = _positions(df, id_col, tokens_col).join(lex, "token", "left")
    return _regroup(j, id_col, F.coalesce("_new", "token"), df)


def annotate(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame,
             key: str = "token", value: str = "tag", default: str = "NN", sep: str = "_",
             max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``token_TAG`` strings from a (token, tag) lexicon with a default tag."""
    lex = checked_broadcast(lexicon.select(F.col(key).alias("token"), F.col(value).alias("_tag")),
                            max_broadcast_rows)
    j = _positions(df, id_col, tokens_col).join(lex, "token", "left")
    return _regroup(j, id_col, F.concat_ws(sep, "token", F.coalesce("_tag", F.lit(default))), df)


def sentiment(df: DataFrame, id_col: str, tokens_col: str, valence: DataFrame,
              key: str = "token", value: str = "valence",
              max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Lexicon sentiment per document.

    Positive valence v adds v + 1 to the positive sum, negative adds v - 1 to
    the negative sum, every other token counts 1 as neutral; shares are taken
    over the total.  ``compound = s / sqrt(s^2 + 15)`` with s the valence sum.
    Documents with no tokens score 0 everywhere."""
    lex = checked_broadcast(valence.select(F.col(key).alias("token"),
                                           F.col(value).cast("double").alias("v")),
                            max_broadcast_rows)
    j = _positions(df, id_col, tokens_col).join(lex, "token", "left")
    v = F.coalesce(F.col("v"), F.lit(0.0))
    g = j.groupBy(id_col).agg(
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("_ps"),
        F.sum(F.when(v < 0, v - 1).otherwise(0.0)).alias("_ns"),
        F.sum(F.when(v == 0, 1.0).otherwise(0.0)).alias("_nu"),
        F.sum(v).alias("_s"))
    out = df.select(id_col).join(g, id_col, "left").na.fill(0.0, ["_ps", "_ns", "_nu", "_s"])
    total = F.col("_ps") + F.abs(F.col("_ns")) + F.col("_nu")

    def share(x):
        return F.when(total == 0, F.lit(0.0)).otherwise(F.abs(x) / total)
    return out.select(id_col, share(F.col("_ps")).alias("pos"), share(F.col("_ns")).alias("neg"),
                      share(F.col("_nu")).alias("neu"),
                      (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(SENTIMENT_ALPHA)))
                      .alias("compound"))


def adjust_label(s, neg, compound) -> tuple[Column, Column, Column, Column, Column]:
    """M13 on a 0-based 5-level label: three chained rules, each re-testing the
    already adjusted value; returns (s1, s2, s3, n_down, n_up)."""
    s = F.col(s) if isinstance(s, str) else s
    neg = F.col(neg) if isinstance(neg, str) else neg
    compound = F.col(compound) if isinstance(compound, str) else compound
    mid = (s > 0) & (s < 4)
    r1 = mid & (neg > 0.1)
    s1 = F.when(r1, s - 1).otherwise(s)
    r2 = mid & (s1 > 0) & (s1 < 4) & (compound < 0.25)
    s2 = F.when(r2, s1 - 1).otherwise(s1)
    r3 = mid & (s2 > 0) & (s2 < 4) & (neg < 0.01)
    s3 = F.when(r3, s2 + 1).otherwise(s2)
    down = r1.cast("int") + r2.cast("int")
    return s1, s2, s3, down, r3.cast("int")


def keep_known(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame) -> DataFrame:
    """(id, token) rows whose token is in the vocabulary (left semi join)."""
    return (df.select(id_col, F.explode_outer(tokens_col).alias("token"))
            .where(F.col("token").isNotNull()).join(vocab, "token", "left_semi"))


def drop_listed(df: DataFrame, id_col: str, tokens_col: str, stop: DataFrame) -> DataFrame:
    """J1 for lists too large for an expression: (id, token) rows not in ``stop``."""
    return (df.select(id_col, F.explode_outer(tokens_col).alias("token"))
            .where(F.col("token").isNotNull()).join(stop, "token", "left_anti"))


def count_unlisted(df: DataFrame, id_col: str, tokens_col: str, stop: DataFrame, out: str) -> DataFrame:
    """J1 counted: for every input row the number of its tokens that are not in
    ``stop`` (0 when all are, or there are none; repeated ids keep their rows)."""
    tokens = F.concat(F.coalesce(F.col(tokens_col), F.array().cast("array<string>")),
                      F.array(F.lit(None).cast("string")))       # the null keeps rows without tokens
    rows = df.select(F.monotonically_increasing_id().alias("_row"), id_col, tokens.alias("_toks"))
    each = (rows.select("_row", id_col, F.explode("_toks").alias("token"))
            .join(stop.select("token", F.lit(True).alias("_listed")).distinct(), "token", "left"))
    return (each.groupBy("_row", id_col)
            .agg(F.count(F.when(F.col("token").isNotNull() & F.col("_listed").isNull(), 1)).alias(out)).drop("_row"))
