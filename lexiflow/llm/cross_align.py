"""Alignment of two tokenizers' ids by divide and conquer at shared cuts.

A document's tokens of both sides cover the same bytes, so a byte offset where
tokens of both sides end cuts the document.  ``align`` locates, for an interval, a
common end near its middle: the middle token's end is bisected in the other side's
ends, then ends farther out on both sides, in windows of doubling width; the
nearest hit splits the interval and both halves go on; an interval without an
inner hit is a leaf, a group.  All intervals of a batch that have the same depth
take their step together, as arrays.

Inside a group a link is a pair of tokens that overlap: the token of the other side
that holds a token's last byte (a group's last byte counts once).

1. One pass over the texts tokenises (distinct stretches between white space once,
   in a bounded pool), aligns, and writes per document the counts, the digest of
   the groups and its distinct id pairs with their link counts.
2. A pair's documents are counted by one aggregation of per-task sums; an id's best
   count by a second one, over the pairs.
3. The hottest pairs, a fixed number whatever the corpus, are broadcast and looked
   up in arrays; a document's other pairs meet their counts in an equi-join."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..session import Scratch
from . import vocab
from .common import WIDE_SPACE, in_parts, small_batches, table, utf8
from .word_ids import Pool, Ragged

HOT_PAIRS = 1 << 20
FLUSH = 1 << 22
# white space and what follows; some pieces end in a carriage return, so there is no cut before one
_STRETCH = re.compile(rb"[\x09-\x0c\x20][\x09-\x0d\x20]*(?:[^\x09-\x0d\x20]+|\x0d[\x09-\x0d\x20]*)*").findall
_RUNS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\v", b"\f", b"\r")
_WHITE = frozenset(b" \t\n\v\f\r")


def align(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The groups between shared cuts, as rows (a_from, a_to, b_from, b_to) in order.
    ``bounds`` has a row of the same form for every document; the ends ascend over
    all documents and agree at the documents' ends."""
    work, leaves = np.asarray(bounds, np.int64).reshape(-1, 4), []
    while len(work):
        whole = (work[:, 1] - work[:, 0] <= 1) | (work[:, 3] - work[:, 2] <= 1)
        leaves.append(work[whole])
        work = work[~whole]
        cut = _near_middle(ends_a, ends_b, work[:, 0], work[:, 1] - 1)
        leaves.append(work[cut < 0])
        work, cut = work[cut >= 0], cut[cut >= 0]
        other = np.searchsorted(ends_b, ends_a[cut]) + 1
        left, right = work.copy(), work.copy()
        left[:, 1], left[:, 3] = cut + 1, other
        right[:, 0], right[:, 2] = cut + 1, other
        work = np.stack([left, right], 1).reshape(-1, 4)        # in order, so the next bisections run along
    out = np.concatenate(leaves) if leaves else np.empty((0, 4), np.int64)
    return out[np.argsort(out[:, 0], kind="stable")]


def _near_middle(ends_a, ends_b, low, high) -> np.ndarray:
    """Per interval the token from low up to, not including, high whose end is common
    and that is nearest to the middle; -1 if none is."""
    found = np.full(len(low), -1, np.int64)
    middle, todo, inner, outer = (low + high) // 2, np.arange(len(low)), 0, 1
    while len(todo):
        lo, hi, mid = low[todo], high[todo], middle[todo]
        # the windows mid - outer < i <= mid - inner and mid + inner <= i < mid + outer
        for first, last, nearest in ((np.maximum(lo, mid - outer + 1), np.minimum(hi, mid - inner + 1), 1),
                                     (np.maximum(lo, mid + inner), np.minimum(hi, mid + outer), -1)):
            n = np.maximum(0, last - first)
            owner = np.repeat(np.arange(len(todo)), n)
            i = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(owner))
            hit = ends_b[np.searchsorted(ends_b, ends_a[i])] == ends_a[i]
            i, owner = i[hit][::nearest], owner[hit][::nearest]      # the nearest one is written last
            best = np.full(len(todo), -1, np.int64)
            best[owner] = i
            old = found[todo]
            closer = (best >= 0) & ((old < 0) | (np.abs(best - mid) < np.abs(old - mid)))
            found[todo[closer]] = best[closer]
        todo = todo[(found[todo] < 0) & ((mid - outer >= lo) | (mid + outer < hi))]
        inner, outer = outer, 2 * outer
    return found


class Pair:
    """Two tokenizers: byte-level merges (A) and sentence pieces (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        d = vocab.load(path_a)
        back = {c: b for b, c in vocab.byte_symbols().items()}
        special = {t["content"] for t in d["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in d["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding(
            "file", mergeable_ranks=ranks, special_tokens={},
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.size_a = max(ranks.values()) + 1
        self.length_a = np.zeros(self.size_a, np.int64)
        self.length_a[list(ranks.values())] = [len(t) for t in ranks]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        # a cut before white space is a cut of both only if no piece goes on over it
        if any(re.search("[^▁]▁|[\x09-\x0c].|.[\x09-\x0c]", p, re.S) for p in pieces):
            raise ValueError("the pieces join words")
        raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in enumerate(pieces)]
        self.bytes_b = Ragged(np.uint8)
        self.bytes_b.add(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]))
        self.length_b = np.array([len(x) for x in raw], np.int64)
        self.blank = self.b.piece_to_id("▁")
        # decimal ids, closed by a comma or by the mark that ends a side of a group
        self.names = [b"%d%s" % (i, c) for i in range(self.size_a) for c in (b",", b"|")]
        self.names += [b"%d%s" % (i, c) for i in range(self.size_b) for c in (b",", b";")]
        self.pool = Pool(np.uint32, np.uint32, np.uint8)      # ids of A, ids of B, whether they give the bytes

    @staticmethod
    def keys(text: bytes) -> list[bytes]:
        """Stretches of white space and what follows, of a blank and the text; without
        their blank where it is one blank before another character."""
        if not text.isascii() and WIDE_SPACE(text):       # white space that isn't cut at: the text as it is
            return [b" " + text if text[0] in _WHITE else text]
        if text[0] not in _WHITE and text[-1] not in _WHITE and not any(x in text for x in _RUNS):
            return text.replace(b"\n", b" \n").split(b" ")
        return [s[1:] if s[0] == 32 and len(s) > 1 and s[1] not in _WHITE else s for s in _STRETCH(b" " + text)]

    def _learn(self, keys: list[bytes]) -> None:
        raw = [k if k[0] in _WHITE else b" " + k for k in keys]
        # white space at a stretch's end would run into the next one: such stretches go one by one
        blank = [i for i, s in enumerate(raw) if s[-1] in _WHITE or not s.isascii() and WIDE_SPACE(s)]
        full = np.setdiff1d(np.arange(len(raw)), blank)
        found = Ragged()
        flat = self.a.encode_to_numpy(b"".join([raw[i] for i in full] if blank else raw).decode("utf-8", "replace"),
                                      disallowed_special=())
        ends = np.cumsum([len(raw[i]) for i in full], dtype=np.int64)
        found.add(flat, np.searchsorted(np.cumsum(self.length_a[flat]), ends) + 1)
        for i in blank:
            ids = self.a.encode_to_numpy(raw[i].decode("utf-8", "replace"), disallowed_special=())
            found.add(ids, [len(ids)])
        place = np.argsort(np.concatenate([full, np.array(blank, np.int64)]))
        # the library puts a blank before every text: it stands for the one cut off, or goes again
        texts = [s.decode("utf-8", "replace") for s in raw]
        lists_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        lists_b = [b if t[0] == " " else b[1:] for t, b in zip(texts, lists_b)]
        for i in blank:
            if texts[i] == " ":
                lists_b[i] = [self.blank]
        sizes = [len(b) for b in lists_b]
        flat_b = np.fromiter(chain.from_iterable(lists_b), np.int64, sum(sizes))
        agrees = self.bytes_b.gather(flat_b).tobytes() == b"".join(raw)
        good = [agrees or self.bytes_b.gather(np.array(b, np.int64)).tobytes() == s for b, s in zip(lists_b, raw)]
        ids_a, ids_b, sound = self.pool.columns
        ids_a.add(found.gather(place), np.cumsum(found.lengths(place)))
        ids_b.add(flat_b, np.cumsum(sizes))
        sound.add(np.array(good, np.uint8), np.arange(1, len(raw) + 1))

    def batch(self, texts: list[bytes], with_ids: bool = False) -> list[tuple]:
        """Per text: tokens of A, of B, groups, links, the groups' digest, the distinct
        pairs (A id * size of B + B id) and their links; on demand ids and group ends."""
        cut = [self.keys(t) if t else [] for t in texts]
        numbers = self.pool.numbers(cut)
        if self.pool.new:
            self._learn(self.pool.new)
        ids_a, ids_b, sound = self.pool.columns
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        bad = np.unique(owner[sound.values[numbers] == 0])
        keep = ~np.isin(owner, bad)
        numbers, owner = numbers[keep], owner[keep]
        per = [np.bincount(owner, w, len(cut)).astype(np.int64) for w in (ids_a.lengths(numbers), ids_b.lengths(numbers))]
        a, b = ids_a.gather(numbers).astype(np.int64), ids_b.gather(numbers).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        to_a, to_b = np.cumsum(per[0]), np.cumsum(per[1])
        docs = np.flatnonzero(per[0])
        bounds = np.column_stack([to_a - per[0], to_a, to_b - per[1], to_b])[docs]
        groups = align(ends_a, ends_b, bounds)
        a0, a1, b0, b1 = groups.T
        # the groups as text
        in_a, in_b = np.repeat(np.arange(len(groups)), a1 - a0), np.repeat(np.arange(len(groups)), b1 - b0)
        index_a, index_b = np.arange(len(a)), np.arange(len(b))
        closes_b = index_b == b1[in_b] - 1
        line = np.empty(len(a) + len(b), np.int64)
        line[index_a + b0[in_a]] = 2 * a + (index_a == a1[in_a] - 1)
        line[index_b + a1[in_b]] = 2 * self.size_a + 2 * b + closes_b
        # links: who holds the last byte of each token
        inner = index_b[~closes_b]
        left = np.concatenate([a, a[np.searchsorted(ends_a, ends_b[inner])]])
        right = np.concatenate([b[np.searchsorted(ends_b, ends_a)], b[inner]])
        of = np.concatenate([np.repeat(np.arange(len(cut)), per[0]),
                             np.repeat(np.arange(len(cut)), per[1])[~closes_b]])
        span = self.size_a * self.size_b
        codes, times = np.unique(of * span + left * self.size_b + right, return_counts=True)
        upto = np.searchsorted(codes, np.arange(len(cut) + 1) * span)
        first_group = np.searchsorted(a0, np.append(0, to_a))
        n_links = np.bincount(of, minlength=len(cut)) if len(of) else np.zeros(len(cut), np.int64)
        out, names = [], self.names
        for d in range(len(cut)):
            la, ha, lb, hb = to_a[d] - per[0][d], to_a[d], to_b[d] - per[1][d], to_b[d]
            words = b"".join([names[k] for k in line[la + lb:ha + hb].tolist()])[:-1]
            pairs = slice(upto[d], upto[d + 1])
            row = (int(ha - la), int(hb - lb), int(first_group[d + 1] - first_group[d]), int(n_links[d]),
                   hashlib.sha256(words).hexdigest() if words else "", (codes[pairs] - d * span).astype("<i8").tobytes(),
                   times[pairs].astype("<u4").tobytes())
            if with_ids:
                g = slice(first_group[d], first_group[d + 1])
                row += (a[la:ha], b[lb:hb], a1[g] - la, b1[g] - lb)
            out.append(row)
        return out


_MODELS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _MODELS:
        _MODELS[path_a, path_b] = Pair(path_a, path_b)
    return _MODELS[path_a, path_b]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
TYPES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, links binary"
LISTS = ["a_ids", "b_ids", "a_ends", "b_ends"]


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path_a: str | None = None,
               path_b: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: the id, n_a and n_b (tokens), n_groups, n_links,
    groups_sha256, pairs (distinct A id * size of B + B id, 64-bit) and links (how often
    each is linked, 32-bit); on demand a_ids, b_ids, a_ends and b_ends (tokens of each
    side up to a group's end).

    A null or empty text, and one whose tokens don't give back a blank and the text
    (it holds U+2581), has no tokens, zeros and an empty digest.  Rows are taken one by
    one, so repeated rows and null ids keep theirs; an empty table has no rows.  Other
    columns are not read."""
    small_batches(docs)
    path_a, path_b = path_a or vocab.default_path("byte_bpe_50k.json"), path_b or vocab.default_path("piece_bpe_32k.model")

    def run(batches):
        pair = pair_of(path_a, path_b)
        for batch in in_parts(batches):
            rows = pair.batch(batch.column(1).to_pylist(), with_ids)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * 4 * with_ids
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *FIELDS, *LISTS * with_ids])

    lists = "".join(f", {c} array<bigint>" for c in LISTS * with_ids)
    idt = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), utf8(text_col))
            .mapInArrow(run, f"id {idt}, {TYPES}{lists}").withColumnRenamed("id", id_col))


def _sums(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """pair, n (rows that hold it) and best (whether no pair of its A id has more)."""

    def partial(batches):
        codes, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pair", "n"])

        held = []
        for b in batches:
            held += [np.frombuffer(x, "<i8") for x in b.column(0).to_pylist()]
            if sum(map(len, held)) >= FLUSH // 4:
                met = np.concatenate(held)
                codes, n = _sums(np.concatenate([codes, met]), np.concatenate([n, np.ones(len(met), np.int64)]))
                held = []
                if len(codes) >= FLUSH:
                    yield from in_parts([rows()], 1 << 16)
                    codes, n = codes[:0], n[:0]
        if held:
            met = np.concatenate(held)
            codes, n = _sums(np.concatenate([codes, met]), np.concatenate([n, np.ones(len(met), np.int64)]))
        if len(codes):
            yield from in_parts([rows()], 1 << 16)

    counts = Scratch(aligned.sparkSession).cut(
        aligned.select("pairs").mapInArrow(partial, "pair bigint, n bigint")
        .groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    top = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("most"))
    return (counts.join(checked_broadcast(top, known_rows=size_a), F.expr(f"pair div {size_b}") == F.col("a"))
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _hottest(counts: DataFrame, limit: int):
    """The least size class (a quarter of a power of two) that at most ``limit`` pairs
    reach, and whether that takes in all pairs."""
    level = F.floor(F.log2("n") * 4)
    sizes = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, taken = None, 0
    for k in sorted(sizes, reverse=True):
        if taken + sizes[k] > limit:
            break
        least, taken = k, taken + sizes[k]
    hot = level >= least if least is not None else F.lit(False)
    return hot, taken == sum(sizes.values())


def cross_align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path_a: str | None = None,
                path_b: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per input row: the id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair is in as many rows as any pair of its A id), count_sum (over links, the rows
    that hold the pair) and groups_sha256.  ``hot_pairs`` bounds what is broadcast and
    changes no result.  Odd rows as in ``alignments``."""
    spark = docs.sparkSession
    path_a, path_b = path_a or vocab.default_path("byte_bpe_50k.json"), path_b or vocab.default_path("piece_bpe_32k.model")
    scratch = Scratch(spark)
    aligned = scratch.cut(alignments(docs, id_col, text_col, path_a=path_a, path_b=path_b)
                          .withColumnRenamed(id_col, "id").withColumn("row", F.monotonically_increasing_id()), "aligned")
    pair = pair_of(path_a, path_b)
    counts = scratch.cut(pair_counts(aligned, pair.size_a, pair.size_b), "pair_best")
    is_hot, all_hot = _hottest(counts, hot_pairs)
    hot = counts.where(is_hot).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    names = ["row", "id", *FIELDS[:5]]

    def look_up(batches):
        known, n, best = shared.value
        known, n, best = np.append(known, np.iinfo(np.int64).max), np.append(n, 0), np.append(best, False)
        for b in batches:
            pairs = [np.frombuffer(x, "<i8") for x in b.column("pairs").to_pylist()]
            links = [np.frombuffer(x, "<u4") for x in b.column("links").to_pylist()]
            stop = np.cumsum([len(p) for p in pairs], dtype=np.int64)
            flat = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
            times = np.concatenate(links).astype(np.int64) if links else flat
            at = np.searchsorted(known, flat)
            hit = known[at] == flat
            sums = []
            for value in (np.where(hit, times * best[at], 0), np.where(hit, times * n[at], 0)):
                upto = np.append(0, np.cumsum(value))
                sums.append(pa.array(np.diff(upto[stop], prepend=0)))
            cols = [b.column(c) for c in names] + sums
            if not all_hot:
                parts = [(flat[s:e][~hit[s:e]], times[s:e][~hit[s:e]]) for s, e in zip(np.append(0, stop[:-1]), stop)]
                cols += [pa.array([x[k].tolist() for x in parts], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "hot_best", "hot_sum", *["rare", "times"] * (not all_hot)])

    idt = aligned.schema["id"].dataType.simpleString()
    schema = (f"row bigint, id {idt}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "hot_best bigint, hot_sum bigint" + ", rare array<bigint>, times array<bigint>" * (not all_hot))
    scored = aligned.select(*names, "pairs", "links").mapInArrow(look_up, schema)
    if all_hot:
        scored = scored.withColumns({"n_best": F.col("hot_best"), "count_sum": F.col("hot_sum")})
    else:
        scored = scratch.cut(scored, "scored")
        rare = scored.select("row", F.inline(F.arrays_zip("rare", "times")).alias("pair", "k"))
        more = (rare.join(counts.where(~is_hot), "pair").groupBy("row")
                .agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"),
                     F.sum(F.col("k") * F.col("n")).alias("more_sum")))
        scored = scored.join(more, "row", "left").withColumns({
            "n_best": F.col("hot_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("hot_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select(F.col("id").alias(id_col), *FIELDS[:4], "n_best", "count_sum", "groups_sha256")


def op12_divide_at_cuts(spark, sf_dir: str) -> DataFrame:
    return cross_align(table(spark, sf_dir, "documents"))
