"""Tags that depend on context (X8): the best path of a first-order model.

User tables: emission (token, tag, score) and transition (prev, tag, score), scores
being logarithms; ``prev`` is null before the first token.  Missing entries score
``default``.  A path's score is the sum over its tokens of transition and emission; of
equal paths the one whose last tag -- then the one before, and so on -- comes first in
the order of the tags.

Tokens meet their emissions in one join and come together by row; a batch's rows are
decoded together, one position at a time, as array operations over rows x tags x tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import DEFAULT_BROADCAST_ROWS, checked_broadcast

MAX_TAGS = 256


def best_paths(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Tags of every token, rows end to end.  ``scores``: tokens x tags, ``start``: tags,
    ``move``: tags x tags (from, to)."""
    first = np.cumsum(lengths) - lengths
    back = np.zeros(scores.shape, np.int32)
    state = np.zeros((len(lengths), len(start)))
    for at in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > at)
        here = first[live] + at
        if at == 0:
            state[live] = start + scores[here]
        else:
            ways = state[live][:, :, None] + move[None]
            back[here] = ways.argmax(axis=1)                     # the first of equal ones
            state[live] = ways.max(axis=1) + scores[here]
    out = np.zeros(len(scores), np.int64)
    tag = state.argmax(axis=1) if len(state) else np.empty(0, np.int64)
    for at in range(int(lengths.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(lengths > at)
        here = first[live] + at
        out[here] = tag[live]
        tag[live] = back[here, tag[live]]
    return out


def decode_tags(df: DataFrame, id_col: str, tokens_col: str, emission: DataFrame, transition: DataFrame,
                default: float = -20.0, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """One row per input row: the id, tokens (without nulls) and tags.

    Rows without tokens have empty arrays; of repeated table rows the largest score
    counts; a token that the table lacks scores ``default`` with every tag."""
    tags = [r[0] for r in emission.select("tag").union(transition.select("tag")).where("tag IS NOT NULL").distinct()
            .orderBy("tag").limit(MAX_TAGS + 1).collect()]
    if not 0 < len(tags) <= MAX_TAGS:
        raise ValueError(f"{len(tags)} tags: the model needs 1 to {MAX_TAGS}")
    place = {t: i for i, t in enumerate(tags)}
    start, move = np.full(len(tags), default), np.full((len(tags), len(tags)), default)
    for r in (transition.where("tag IS NOT NULL").groupBy("prev", "tag").agg(F.max("score").alias("score"))
              .collect()):                                       # at most (tags + 1) x tags rows
        if r["prev"] is None:
            start[place[r["tag"]]] = r["score"]
        elif r["prev"] in place:
            move[place[r["prev"]], place[r["tag"]]] = r["score"]
    known = (emission.where("tag IS NOT NULL").groupBy("token", "tag").agg(F.max("score").cast("double").alias("score"))
             .groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("by")))
    known = known.select("token", F.transform(F.lit(tags), lambda t: F.coalesce(F.element_at("by", t), F.lit(default)))
                         .alias("e"))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                     F.filter(F.coalesce(tokens_col, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("_t"))
    each = rows.select("_row", "_id", F.posexplode(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("at", "token"))
    unknown = F.array_repeat(F.lit(float(default)), len(tags))
    met = (each.join(checked_broadcast(known, max_broadcast_rows), "token", "left").groupBy("_row", "_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct(
            "at", "token", F.coalesce("e", unknown).alias("e"))))).alias("w"))
        .select("_id", F.col("w.token").alias("tokens"), F.flatten("w.e").alias("e")))
    names = pa.array(tags)

    def run(batches):
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy()).astype(np.int64)
            scores = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, len(tags))
            path = best_paths(scores, lengths, start, move)
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            found = pa.ListArray.from_arrays(offsets, names.take(pa.array(path)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=[id_col, "tokens", "tags"])

    idt = df.schema[id_col].dataType.simpleString()
    return met.mapInArrow(run, f"`{id_col}` {idt}, tokens array<string>, tags array<string>")
