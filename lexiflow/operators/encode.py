"""Vocabulary and fixed-length sequence encoding.

Ids are dense ranks of the vocabulary by (count desc, token asc), offset by
the reserved ids 0 (padding) and 1 (unknown).  Ranks come from the
distributed ``global_index``; the vocabulary is joined once per token
occurrence (broadcast when proven small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import DEFAULT_BROADCAST_ROWS, checked_broadcast
from .ranking import global_index

PAD_ID = 0
UNK_ID = 1


def build_vocabulary(df: DataFrame, tokens_col: str, min_count: int = 1) -> DataFrame:
    """(token, cnt, id) over all tokens of ``df``."""
    c = (df.select(F.explode_outer(tokens_col).alias("token")).where(F.col("token").isNotNull())
         .groupBy("token")
         .agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count))
    v = global_index(c, [F.col("cnt").desc(), F.col("token")], "idx")
    return v.select("token", "cnt", (F.col("idx") + 2).alias("id"))


def encode(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, max_len: int,
           max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(id, input_ids, attention_mask, n_tokens): the first ``max_len`` tokens as
    ids, right-padded with PAD_ID; n_tokens counts the whole sequence.  One row
    per input row: only the kept tokens are exploded, and a row's number, not its
    id, brings them together again."""
    lex = checked_broadcast(vocab.select("token", F.col("id").alias("tid")), max_broadcast_rows)
    toks = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), id_col,
                     F.size(F.filter(toks, lambda t: t.isNotNull())).alias("_n"),
                     F.slice(F.filter(toks, lambda t: t.isNotNull()), 1, max_len).alias("_toks"))
    # a last null token keeps rows without tokens; it meets no vocabulary row
    pos = rows.select("_row", id_col, "_n", F.posexplode(
        F.concat("_toks", F.array(F.lit(None).cast("string")))).alias("pos", "token"))
    g = pos.join(lex, "token", "left").groupBy("_row", id_col, "_n").agg(F.sort_array(F.collect_list(
        F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("tid", F.lit(UNK_ID)).alias("t")))))
        .alias("_pt"))
    n, kept = F.col("_n"), F.transform("_pt", lambda x: x["t"])
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    ids = F.concat(kept, F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(max_len))),
                    F.array_repeat(F.lit(0), pad))
    return g.select(id_col, ids.alias("input_ids"), mask.alias("attention_mask"),
                    n.cast("bigint").alias("n_tokens"))
