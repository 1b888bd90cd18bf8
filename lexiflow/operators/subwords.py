"""Sub-word pieces by greedy longest match first (X11).

The vocabulary is a table (piece, id); pieces that go on a word begin with the
continuation mark.  From the left, the longest piece that fits is taken; a word that
comes to a point where none fits, or longer than ``max_word``, is the unknown piece.
Sequences are opened and closed by their marks, cut and padded on pieces.

The vocabulary reaches every task behind a check of its bytes (a sub-word vocabulary is
bounded by design).  A task works on a slice of a batch at a time, in arrays, and keeps
the pieces of a bounded number of words, so its memory does not follow the batch's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_VOCABULARY_BYTES = 64 << 20
SLICE = 512             # rows of a batch worked on at a time
KEPT_WORDS = 100_000    # words whose pieces a task remembers


def split_word(word: str, ids: dict[str, int], longest: int, mark: str, unknown: int, max_word: int) -> list[int]:
    """Ids of the pieces of one word."""
    if len(word) > max_word:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for stop in range(min(len(word), at + longest), at, -1):
            found = ids.get(mark + word[at:stop] if at else word[at:stop])
            if found is not None:
                out.append(found)
                at = stop
                break
        else:
            return [unknown]
    return out


def encode_batches(batches, words: dict, max_len: int, front: list[int], back: list[int], pad: int, id_col: str):
    """Batches of (id, tokens) in slices, as (id, input_ids, attention_mask, n_pieces);
    ``words``: the arguments of ``split_word``."""
    room = max_len - len(front) - len(back)
    known: dict[str, list[int]] = {}
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            lists = part.column(1)
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            terms = pc.list_flatten(lists).dictionary_encode()
            if len(known) > KEPT_WORDS:
                known.clear()
            pieces = []
            for w in terms.dictionary.to_pylist():
                found = known.get(w)
                if found is None:
                    found = split_word(w, **words) if w else []
                    if len(w) <= words["max_word"]:
                        known[w] = found
                pieces.append(found)
            made = terms.indices.is_valid().to_numpy(zero_copy_only=False)
            codes, rows = terms.indices.drop_null().to_numpy(zero_copy_only=False), rows[made]
            count = np.array([len(p) for p in pieces], np.int64)
            first = np.cumsum(count) - count
            flat = np.fromiter((i for p in pieces for i in p), np.int64, int(count.sum()))
            n = count[codes]
            total = np.bincount(rows, n, part.num_rows).astype(np.int64)
            place = np.cumsum(n) - n - (np.cumsum(total) - total)[rows]     # in its row, of a word's first piece
            within = place < room
            n, place, codes, rows = (x[within] for x in (n, place, codes, rows))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            column, row = np.repeat(place, n) + step, np.repeat(rows, n)
            piece = flat[np.repeat(first[codes], n) + step]
            width = len(front) + np.minimum(total, room)
            out = np.full((part.num_rows, max_len), pad, np.int64)
            out[:, :len(front)] = front
            out[row[column < room], len(front) + column[column < room]] = piece[column < room]
            for i, mark_id in enumerate(back):
                out[np.arange(part.num_rows), width + i] = mark_id
            mask = (np.arange(max_len) < (width + len(back))[:, None]).astype(np.int32)
            offsets = pa.array(np.arange(part.num_rows + 1) * max_len, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel())),
                 pa.ListArray.from_arrays(offsets, pa.array(mask.ravel())), pa.array(total)],
                names=[id_col, "input_ids", "attention_mask", "n_pieces"])


def encode_pieces(df: DataFrame, id_col: str, tokens_col: str, vocabulary: DataFrame, max_len: int, *,
                  unknown: str = "[UNK]", opening: str | None = "[CLS]", closing: str | None = "[SEP]",
                  padding: str = "[PAD]", mark: str = "##", max_word: int = 100,
                  max_bytes: int = MAX_VOCABULARY_BYTES) -> DataFrame:
    """One row per input row: the id, input_ids (``max_len`` long), attention_mask and
    n_pieces (of the whole text, without the marks).

    Null and empty words have no pieces; a null or empty array gives the marks and
    padding alone.  Words are split as they are: lower-casing and punctuation are the
    caller's.  Raises if the vocabulary is larger than ``max_bytes`` or lacks a mark."""
    size = vocabulary.agg(F.sum(F.octet_length("piece") + 8)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the vocabulary has {size} bytes, more than {max_bytes}")
    known = vocabulary.select("piece", F.col("id").cast("bigint").alias("id")).toArrow()
    ids = dict(zip(known.column("piece").to_pylist(), known.column("id").to_pylist()))
    ends = [ids[x] for x in (opening, closing) if x is not None]
    room = max_len - len(ends)
    if room < 0:
        raise ValueError("max_len leaves no room for the marks")
    front, back, unk, pad = ends[:opening is not None], ends[opening is not None:], ids[unknown], ids[padding]
    shared = df.sparkSession.sparkContext.broadcast((ids, max(map(len, ids), default=1)))

    def run(batches):
        table, longest = shared.value
        words = {"ids": table, "longest": longest, "mark": mark, "unknown": unk, "max_word": max_word}
        return encode_batches(batches, words, max_len, front, back, pad, id_col)

    idt = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.coalesce(tokens_col, F.array().cast("array<string>")).alias("tokens")).mapInArrow(
        run, f"`{id_col}` {idt}, input_ids array<bigint>, attention_mask array<int>, n_pieces bigint")
