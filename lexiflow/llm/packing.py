"""Packing token ids into windows by minimum bin slack.

1. One pass over the texts tokenises each document and closes it with the end
   id.  Whole windows leave it as they are; the rest (shorter than a window)
   is one piece.  Every piece is numbered inside its (partition, length).
   The pieces -- a few numbers each, not the ids -- are written once to the
   shared checkpoint folder.
2. The lengths' counts (at most ``window`` numbers) reach the driver.  Again and
   again a bitset subset-sum over the multiset of remaining lengths gives the
   sums that can be reached together with the longest remaining piece; the one
   with the least padding is chosen, its counts are read back from the bitsets,
   and the filling is used as often as the counts allow.  The plan is bounded by
   the number of lengths, not by the documents.
3. A piece's rank inside its length (its number plus the counts of earlier
   partitions) falls into one use of the plan: an equi-join on (partition,
   length) and a narrow pass give sequence and offset."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import vocab
from .common import WIDE_SPACE, in_parts, small_batches, table, utf8
from .word_ids import Pool, Ragged

_STRETCH = re.compile(rb"[\x09-\x0d\x20]+[^\x09-\x0d\x20]*|[^\x09-\x0d\x20]+").findall
_WHITE = frozenset(b" \t\n\v\f\r")
_RUNS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\v", b"\f", b"\r")


class ByteBpe:
    """Ids of texts, in batches.  The pattern never joins across the beginning of white
    space, so texts are cut there; the distinct new stretches of a batch are encoded in
    one call and kept in a bounded pool."""

    def __init__(self, path: str):
        import tiktoken
        d = vocab.load(path)
        chars = {c: b for b, c in vocab.byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in d["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding(
            "file", mergeable_ranks=ranks, special_tokens={},
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.lengths = np.zeros(1 + max(ranks.values()), np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.odd = re.compile(b"|".join(re.escape(t.encode()) for t in self.special)).search
        self.pool = Pool()

    @staticmethod
    def stretches(text: bytes) -> list[bytes]:
        if not text:
            return []
        if not text.isascii() and WIDE_SPACE(text):       # white space that isn't cut at: the text as it is
            return [text]
        if text[0] not in _WHITE and text[-1] not in _WHITE and not any(x in text for x in _RUNS):
            first, *rest = text.replace(b"\n", b" \n").split(b" ")
            return [first, *[r if r[0] == 10 else b" " + r for r in rest]]
        return _STRETCH(text)

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def _learn(self, new: list[bytes]) -> None:
        # white space alone would run into the next stretch, a special token is cut out: one by one
        alone = [i for i, s in enumerate(new) if s[-1] in _WHITE or self.odd(s) or not s.isascii() and WIDE_SPACE(s)]
        together = np.setdiff1d(np.arange(len(new)), alone)
        found, parts = Ragged(), [new[i] for i in together]
        # a stretch that begins a text has no white space before it: a line feed keeps it apart
        loose = np.array([p[0] not in _WHITE for p in parts], np.int64)
        flat = self._plain(b"".join([b"\n" + p if x else p for p, x in zip(parts, loose)]).decode("utf-8", "replace"))
        upto = np.cumsum(self.lengths[flat])
        ends = np.searchsorted(upto, np.cumsum(np.array([len(p) for p in parts], np.int64) + loose)) + 1
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        flat = np.delete(flat, begins[loose == 1])
        found.add(flat, ends - np.cumsum(loose))
        for i in alone:
            pieces = [p for p in self.cut(new[i].decode("utf-8", "replace")) if p]
            ids = [np.array([self.special[p]]) if p in self.special else self._plain(p) for p in pieces]
            found.add(np.concatenate(ids), [sum(map(len, ids))])
        place = np.argsort(np.concatenate([together, np.array(alone, np.int64)]))
        self.pool.columns[0].add(found.gather(place), np.cumsum(found.lengths(place)))

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        cut = [self.stretches(t) for t in texts]
        numbers = self.pool.numbers(cut)
        if self.pool.new:
            self._learn(self.pool.new)
        ids = self.pool.columns[0]
        upto = np.append(0, np.cumsum(ids.lengths(numbers)))
        return ids.gather(numbers), np.diff(upto[np.cumsum([len(c) for c in cut], dtype=np.int64)], prepend=0)


_MODELS: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def _pieces(docs: DataFrame, id_col: str, text_col: str, window: int, path: str, with_ids: bool) -> DataFrame:
    idt = docs.schema[id_col].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""

    def run(batches):
        model = byte_bpe(path)
        part = TaskContext.get().partitionId()
        used = np.zeros(window + 1, np.int64)
        for b in in_parts(batches):
            row, start, length, crc, total, local, ids = [], [], [], [], [], [], []
            found, counts = model.batch(b.column(1).to_pylist())
            stops = np.cumsum(counts)
            blob = memoryview(np.insert(found, stops, 0).astype("<u4")).cast("B")      # the closing id
            base = 0
            for i, m in enumerate((counts + 1).tolist()):
                for s in range(0, m, window):
                    n = min(window, m - s)
                    cut = blob[4 * (base + s):4 * (base + s + n)]
                    row.append(i), start.append(s), length.append(n), crc.append(zlib.crc32(cut))
                    total.append(m), local.append(used[n])
                    used[n] += 1
                    if with_ids:
                        ids.append(bytes(cut))
                base += m
            cols = [b.column(0).take(pa.array(row, pa.int64()))]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc, total, [part] * len(row), local)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col), utf8(text_col)).mapInArrow(
        run, f"doc_id {idt}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
             f"part bigint, local bigint{extra}")


def _padding(total: int, window: int) -> int:
    return 0 if total & (total - 1) == 0 else window - total


def fill_window(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of remaining lengths, the longest one in it, with the least
    padding (then the largest sum): bitset subset-sum with bounded counts."""
    first = max(counts)
    room = window - first
    steps, reach = [], 1
    for n in sorted(counts, reverse=True):
        left, k = min(counts[n] - (n == first), room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & ((1 << (room + 1)) - 1)
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    sums = [s for s in range(room + 1) if reach >> s & 1]
    left = min(sums, key=lambda s: (_padding(first + s, window), -s))
    chosen = {first: 1}
    for n, k, before in reversed(steps):
        if not before >> left & 1:
            chosen[n] = chosen.get(n, 0) + k
            left -= n * k
    return chosen


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used; together they take every piece once."""
    counts, out = {n: c for n, c in histogram.items() if c > 0}, []
    while counts:
        chosen = fill_window(counts, window)
        times = min(counts[n] // k for n, k in chosen.items())
        out.append((chosen, times))
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def _places(plan, window: int):
    """Per length: rank bounds of its uses, and for each use the copies a window
    takes, the first sequence and the offset of the first copy."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    seq = 0
    for chosen, times in plan:
        offset = 0
        for n in sorted(chosen, reverse=True):
            k = chosen[n]
            out.setdefault(n, []).append((taken.get(n, 0), k, seq, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        seq += times
    return {n: np.array(v, np.int64).T for n, v in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 1024,
         tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, little-endian 32-bit, on demand).

    A document is its text's ids and the closing id 0; a null or empty text is
    the closing id alone.  Rows are taken one by one, so repeated rows and
    repeated or null ids are each packed; an empty table packs to nothing.
    Other columns are not read.  Sequences are filled to ``window`` or to a power
    of two where the remaining lengths allow it."""
    small_batches(docs)
    path = tokenizer or vocab.default_path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.cut(_pieces(docs, id_col, text_col, window, path, with_ids), "pieces")
    counts = scratch.cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(_places(plan_windows(histogram, window), window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = pieces.join(before, ["part", "length"]).select(
        *keep, (F.col("before") + F.col("local")).alias("rank"))

    def place(batches):
        by_length = places.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, copies, base, offset = by_length[int(n)]
                use = np.searchsorted(first, rank[rows], "right") - 1
                q = rank[rows] - first[use]
                seq[rows] = base[use] + q // copies[use]
                off[rows] = offset[use] + q % copies[use] * n
            cols = [b.column(c) for c in keep] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def op10_minimum_bin_slack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
