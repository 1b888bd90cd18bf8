"""Language-model scoring with a weighted backoff automaton.

Counts.  Every training text is counted in full.  Words that occur twice or more are
symbols of their own; the others share the symbol TAIL, inside which each keeps its
own probability from its own count.  Sequences of k symbols that occur twice or more
are stored, however large the corpus is (``word_share`` and ``gram_share`` can ask for
more).

Smoothing is interpolated absolute discounting: a stored sequence has its
discounted share and the backoff's; what is discounted or not stored goes to the
shorter context.  Word probabilities are discounted too, and the mass of that is
the probability of an unknown word, so the probabilities of all words, the
unknown word and the end sum to one in every context.

Scoring.  The automaton's states are the stored sequences, the failure arc of a
state leads to its longest proper suffix and costs the backoff weight.  ``fit`` builds
it in one piece, for a corpus that fits in memory.  ``lm_scores`` holds it in parts:

1. Texts are tokenised once, into chunks of word numbers; words meet their counts in
   the whole corpus by the parts of their 64-bit hashes.
2. Every step of every text (a symbol and those before it) goes to the part of the
   symbol it leaves, where all states that end in it are.  A symbol with more than
   ``piece`` occurrences is dealt by the symbol before it; what follows it is counted
   beforehand and goes to all its parts.
3. A part counts its learnt steps, stores its sequences and their backoff weights, and
   takes all its steps, distinct ones once.  What they give is summed by text.

Steps, words and sums travel as compressed arrays of integers."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import constant_array, crc_of_id, in_parts, mix64, small_batches, table, utf8, word_hashes, words_of

TAIL, END, FIRST = 0, 1, 2      # symbols; END also begins a text; head words from FIRST on
FLUSH = 1_000_000
CHUNK_BYTES = 12 << 20      # of text in a chunk of rows, and one text
BUCKET, SLICE = 1 << 21, 1 << 21      # words or pairs that one group counts; steps in arrays at once
DEALT = "bucket bigint, chunk bigint, n bigint, others bigint, steps binary, hashes binary, counts binary"
SUMS = "chunk bigint, n bigint, docs binary, sums binary"
UNIT = 1e8                  # what a text's steps add up to is summed in whole hundred-millionths
_STEP, _STATE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)
_FIXED = np.array([1, 2, 3], np.uint64)      # hashes of NONE, TAIL and END, codes 0, 1 + TAIL and 1 + END


class Automaton:
    """Sorted codes of the stored sequences of each length, their log10
    probabilities and the log10 backoff weights of those that are contexts."""

    def __init__(self, head: dict[bytes, int], logp: np.ndarray, head_plus_one: np.ndarray):
        self.head, self.n_symbols = head, len(logp)
        self.head_plus_one = head_plus_one         # log10(c + 1) by symbol, for the base score
        self.logp = [logp]                         # by length: of the last symbol given the others
        self.codes: list[np.ndarray] = [np.arange(len(logp), dtype=np.int64)]
        self.backoff = [np.zeros(len(logp))]       # by length: weight of the failure arc

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The symbols of a text and its end."""
        get = self.head.get
        return np.array([get(w, TAIL) for w in words] + [END], np.int64)

    def find(self, k: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places of (state of length k - 1, symbol) among the stored sequences of
        length k; -1 if it is none or the state is."""
        codes = self.codes[k - 1]
        if not len(codes):
            return np.full(len(symbol), -1)
        want = state * self.n_symbols + symbol
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        return np.where((state >= 0) & (codes[at] == want), at, -1)

    def contexts(self, symbols: np.ndarray, k: int) -> np.ndarray:
        """For every place the stored sequence of length k that ends just before it
        and inside the text (of length 1: the symbol before, END at a start)."""
        state = np.concatenate([[END], symbols[:-1]])
        for j in range(2, k + 1):
            before = np.concatenate([[-1], self.contexts(symbols, j - 1)[:-1]])
            last = np.concatenate([[END], symbols[:-1]])
            state = np.where(last == END, -1, self.find(j, before, last))
        return state

    def steps(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of texts written one after the other."""
        out = self.logp[0][symbols]
        for k in range(2, len(self.codes) + 1):
            state = self.contexts(symbols, k - 1)
            at = self.find(k, state, symbols)
            fail = out + np.where(state >= 0, self.backoff[k - 2][state], 0.0)
            out = np.where(at >= 0, self.logp[k - 1][at] if len(self.codes[k - 1]) else 0.0, fail)
        return out

    def add(self, codes: np.ndarray, counts: np.ndarray, totals: np.ndarray, discount: float) -> None:
        """Store the sequences of the next length.  ``totals[s]``: how often state s
        of the current length is followed by anything."""
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        state, symbol = codes // self.n_symbols, codes % self.n_symbols
        own = (counts - discount) / totals[state]
        left = np.ones(len(totals))
        np.subtract.at(left, state, own)
        left = np.maximum(left, 1e-12)
        # the backoff's probability of the last symbol after the state's suffix
        lower = self.logp[0][symbol]
        if len(self.codes) > 1:
            suffix = self.codes[-1][state] % self.n_symbols
            at = self.find(2, suffix, symbol)
            lower = np.where(at >= 0, self.logp[1][at], self.backoff[0][suffix] + lower)
        self.backoff[-1] = np.log10(left)
        self.codes.append(codes)
        self.logp.append(np.log10(own + left[state] * 10 ** lower))
        self.backoff.append(np.zeros(len(codes)))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words; the empty word is the end of a text."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in in_parts(batches):
            for text in b.column(0).to_pylist():
                seen.update(words_of(text))
                seen[b""] += 1
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
        yield rows()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _gram_counts(texts: DataFrame, shared, k: int) -> DataFrame:
    """(code, c): stored state of length k - 1 and next symbol, with the count."""

    def run(batches):
        m, held, size = shared.value, [], 0

        def rows():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "c"])

        for b in in_parts(batches):
            symbols = [m.symbols(words_of(t)) for t in b.column(0).to_pylist()]
            if not symbols:
                continue
            s = np.concatenate(symbols)
            state = m.contexts(s, k - 1)
            good = state >= 0
            if k > 2:       # the sequence without its first symbol is stored, too
                good &= m.find(k - 1, m.contexts(s, k - 2), s) >= 0
            held.append((state * m.n_symbols + s)[good])
            size += len(held[-1])
            if size > 4 * FLUSH:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return texts.mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c"))


def fit(texts: DataFrame, scratch: Scratch, *, order: int, word_share: float, gram_share: float,
        discount: float):
    """(automaton, word counts, facts about them) from the column of training texts."""
    spark = texts.sparkSession
    counts = scratch.cut(_word_counts(texts), "words")
    f = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                   F.sum((F.col("c") == 1).cast("long")).alias("n1"),
                   F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    n, v = f["n"] or 0, f["v"]
    if not n:
        return None, counts, None
    d = min(0.9, max(0.1, f["n1"] / (f["n1"] + 2 * f["n2"]) if f["n1"] else 0.5))
    least = max(2, word_share * n)
    top = counts.where((F.col("c") >= least) | (F.col("word") == F.lit(b""))).toPandas()
    c_end = int(top[top.word == b""].c.iloc[0])
    top = top[top.word != b""].sort_values(["c", "word"], ascending=[False, True])
    head = {bytes(w): FIRST + i for i, w in enumerate(top.word)}
    c = np.concatenate([[0, c_end], top.c.to_numpy(float)]).astype(float)
    n_tail = n - c.sum()
    p = np.maximum(c - d, 0) / n
    p[TAIL] = 1 - p.sum()               # seen TAIL words and the unknown word
    plus = np.log10(c + 1)
    plus[TAIL] = 0.0
    m = Automaton(head, np.log10(p), plus)
    totals = c.copy()
    totals[TAIL] = max(n_tail, 1)
    for k in range(2, order + 1):
        shared = spark.sparkContext.broadcast(m)
        grams = (_gram_counts(texts, shared, k).where(F.col("c") >= max(2, gram_share * n))).toPandas()
        shared.destroy()
        m.add(grams.code.to_numpy(np.int64), grams.c.to_numpy(), totals, discount)
        totals = grams.sort_values("code").c.to_numpy(float)
        if not len(grams):
            break
    return m, counts, {"n": n, "v": v, "d": d, "least": least, "p_tail": p[TAIL]}


def _packed(values: np.ndarray, kind=np.int32) -> bytes:
    """Numbers as compressed byte planes."""
    a = np.ascontiguousarray(values, kind)
    return pa.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), "zstd", asbytes=True) if len(a) else b""


def _unpacked(blob: bytes, n: int, kind=np.int32) -> np.ndarray:
    """The ``n`` numbers of a blob of ``_packed``."""
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _chunks(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (id, text, held) as word numbers of a chunk of rows, and for every
    word of the chunk its hash and its count in the training rows; number 0 is a text's end."""
    from pyspark.sql.pandas.types import to_arrow_type
    idt = docs.schema["id"].dataType

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, held, lengths, parts, numbers, size = [], [], [], [], _Numbers({b"": 0}), 0

        def row():
            seq, n = np.concatenate(parts), len(numbers)
            often = np.bincount(seq, minlength=n)
            order = np.argsort(-often, kind="stable")        # frequent words get small numbers
            order = np.concatenate([[0], order[order != 0]])
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            learnt = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(seq[learnt], minlength=n)[order]
            hashes = word_hashes(list(numbers))[order]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([ids], pa.list_(to_arrow_type(idt))),
                 *[pa.array([x], pa.int64()) for x in (len(ids), len(seq), n)],
                 *[pa.array([x], pa.binary()) for x in (_packed(held, np.uint8), _packed(lengths), _packed(place[seq]),
                                                        hashes.tobytes(), _packed(counts))]],
                names=["chunk", "ids", "docs", "tokens", "words", "held", "lengths", "seq", "hashes", "counts"])

        for b in in_parts(batches):
            words = [words_of(t) + [b""] for t in b.column(1).to_pylist()]
            if not words:
                continue
            ids += b.column(0).to_pylist()
            held += b.column(2).to_pylist()
            n = [len(w) for w in words]
            lengths += n
            parts.append(np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int32, sum(n)))
            size += pc.sum(pc.binary_length(b.column(1))).as_py() + 16 * len(n)
            if size >= CHUNK_BYTES:
                yield row()
                made += 1
                ids, held, lengths, parts, numbers, size = [], [], [], [], _Numbers({b"": 0}), 0
        if ids:
            yield row()

    return docs.mapInArrow(run, f"chunk bigint, ids array<{idt.simpleString()}>, docs bigint, tokens bigint, words bigint, "
                                "held binary, lengths binary, seq binary, hashes binary, counts binary")


def _runs(keys: np.ndarray):
    """(a place of each distinct key, number of every key's distinct key)"""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _word_totals(chunks: DataFrame, size: int, keep: int) -> DataFrame:
    """(part, chunk, a, b): the count in the whole corpus of every word of a chunk, by parts of the
    hashes, in the order of the chunk's words of that part (a).  A row a part without a chunk has
    how many words have which count (a) and the most frequent words and the end of a text (b)."""
    parts, end = max(1, -(-size // BUCKET)), word_hashes([b""])[0]

    def deal(batches):
        for b in batches:
            for r in b.to_pylist():
                h, c = np.frombuffer(r["hashes"], np.uint64), _unpacked(r["counts"], r["words"])
                of = _part_of(h, parts)
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(parts + 1))
                groups = [order[a:z] for a, z in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(parts), pa.int64()), pa.array([r["chunk"]] * parts, pa.int64()),
                     pa.array([len(g) for g in groups], pa.int64()),
                     pa.array([h[g].tobytes() for g in groups], pa.binary()),
                     pa.array([_packed(c[g]) for g in groups], pa.binary())], names=["part", "chunk", "n", "h", "c"])

    def total(key, t):
        n = t.column("n").to_pylist()
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()])
        c = np.concatenate([_unpacked(x, k) for x, k in zip(t.column("c").to_pylist(), n)])
        one, number = _runs(h)
        sums = np.bincount(number, c, len(one)).astype(np.int64)
        cuts = np.cumsum([0, *n])
        back = [_packed(sums[number[a:z]], np.int64) for a, z in zip(cuts, cuts[1:])]
        values, times = np.unique(sums[sums > 0], return_counts=True)
        most = np.argsort(-sums, kind="stable")[:keep // parts + 1]
        often = np.union1d(most, np.flatnonzero((sums >= BUCKET // 8) | (h[one] == end)))
        often = often[sums[often] > 0]
        facts = np.stack([values, times]).astype(np.int64).tobytes()
        top = h[one[often]].tobytes() + sums[often].tobytes()
        return pa.table([pa.array([key[0].as_py()] * (len(n) + 1), pa.int64()),
                         pa.array([*t.column("chunk").to_pylist(), None], pa.int64()),
                         pa.array([*back, facts], pa.binary()), pa.array([None] * len(n) + [top], pa.binary())],
                        names=["part", "chunk", "a", "b"])

    return (chunks.select("chunk", "words", "hashes", "counts")
            .mapInArrow(deal, "part bigint, chunk bigint, n bigint, h binary, c binary")
            .groupBy("part").applyInArrow(total, "part bigint, chunk bigint, a binary, b binary"))


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    of = mix64(hashes + _SALT) % np.uint64(parts)
    return of.astype(np.uint16 if parts < 1 << 16 else np.int64)


class Corpus:
    """What every task knows of the corpus: its facts and its ``keep`` most frequent words.

    Codes: NONE, what stands before a text's start; TAIL; END; a frequent word; from ``size``
    on the other words, numbered by a list that goes with the codes."""

    def __init__(self, tops: list[bytes], facts: list[bytes], *, keep: int, word_share: float, gram_share: float,
                 order: int, discount: float):
        values = np.concatenate([np.empty((2, 0), np.int64),
                                 *[np.frombuffer(x, np.int64).reshape(2, -1) for x in facts]], axis=1)
        c, times = values
        n1, n2 = (int(times[c == i].sum()) for i in (1, 2))
        self.n, self.v = int((c * times).sum()), int(times.sum())
        self.d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        self.least_word, self.least = max(2, word_share * self.n), max(2, gram_share * self.n)
        self.order, self.discount = order, discount
        h = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(x, np.uint64)[:len(x) // 16] for x in tops]])
        count = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, np.int64)[len(x) // 16:] for x in tops]])
        self.end = word_hashes([b""])[0]
        good = (count >= self.least_word) & (h != self.end)
        self.c_end = int(count[h == self.end].sum())
        h, count = h[good], count[good]
        most = np.lexsort([h, -count])[:keep]
        self.hashes = np.concatenate([_FIXED, h[most]])
        self.counts = np.concatenate([[0, 0, self.c_end], count[most]])
        self.size = len(self.hashes)
        by = np.argsort(self.hashes[FIRST + 1:])
        self.sorted, self.code = self.hashes[FIRST + 1:][by], by + FIRST + 1
        own = c >= self.least_word
        tail = (c[~own] * times[~own]).sum() - (self.c_end if self.c_end < self.least_word else 0)
        self.counts[1 + TAIL] = tail
        head = self.n - tail - self.c_end
        kept = (head - self.d * (times[own].sum() - (self.c_end >= self.least_word)) + max(self.c_end - self.d, 0))
        self.p_tail = 1 - kept / self.n if self.n else 1.0

    def codes(self, hashes: np.ndarray, counts: np.ndarray):
        """(code of each word, those from ``size`` on)"""
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            code = np.where(self.sorted[at] == hashes, self.code[at], -1)
        else:
            code = np.full(len(hashes), -1)
        code[counts < self.least_word] = 1 + TAIL
        code[hashes == self.end] = 1 + END
        other = np.flatnonzero(code < 0)
        code[other] = self.size + np.arange(len(other))
        return code, other

    def logp(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of the symbols by their codes; ``counts`` are those of the other words."""
        c = np.concatenate([self.counts, counts])
        p = np.maximum(c - self.d, self.d) / self.n
        p[0], p[1 + TAIL] = 1.0, self.p_tail
        p[1 + END] = (self.c_end - self.d) / self.n
        return np.log10(p)


def _coded(chunks: DataFrame, totals: DataFrame, shared, size: int) -> DataFrame:
    """The chunks in codes, and of each text its known words, base score and the probabilities
    of its TAIL words inside TAIL."""
    parts = max(1, -(-size // BUCKET))
    keep = chunks.schema

    def run(left, right):
        m, r = shared.value, left.to_pylist()[0]
        h = np.frombuffer(r["hashes"], np.uint64)
        of = _part_of(h, parts)
        count, got = np.empty(len(h), np.int64), dict(zip(right.column("part").to_pylist(), right.column("a").to_pylist()))
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(parts + 1))
        for i, blob in got.items():
            at = order[cut[i]:cut[i + 1]]
            count[at] = _unpacked(blob, len(at), np.int64)
        code, other = m.codes(h, count)
        seq, lengths = _unpacked(r["seq"], r["tokens"]), _unpacked(r["lengths"], r["docs"])
        starts = np.cumsum(lengths) - lengths
        inside = np.zeros(len(h))
        if m.n:
            each = np.where(count > 0, count - m.d, m.d * m.v) / (m.n * m.p_tail)
            inside = np.where(code == 1 + TAIL, np.log10(each), 0.0)
        sums = [np.add.reduceat(x[seq], starts) for x in ((count > 0).astype(np.int64), np.log10(count + 1), inside)]
        blobs = (_packed(code[seq]), h[other].tobytes(), _packed(count[other], np.int64))
        return pa.table([left.column("chunk"), left.column("ids"), left.column("docs"), left.column("tokens"),
                         left.column("held"), left.column("lengths"), *[pa.array([x], pa.binary()) for x in blobs],
                         *[pa.array([x], pa.list_(t)) for x, t in zip(sums, (pa.int64(), pa.float64(), pa.float64()))]],
                        names=["chunk", "ids", "docs", "tokens", "held", "lengths", "seq", "hashes", "counts", "known",
                               "base", "inside"])

    return chunks.select("chunk", "ids", "docs", "tokens", "held", "lengths", "seq", "hashes").groupBy("chunk").cogroup(
        totals.where("chunk is not null").groupBy("chunk")).applyInArrow(
        run, f"chunk bigint, ids {keep['ids'].dataType.simpleString()}, docs bigint, tokens bigint, held binary, "
             "lengths binary, seq binary, hashes binary, counts binary, known array<bigint>, base array<double>, "
             "inside array<double>")


def _key(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a state (or what it is made from) and the next symbol's hash."""
    with np.errstate(over="ignore"):
        return mix64(state * _STEP + symbol)


class Steps:
    """The steps of a chunk's or bucket's texts: symbols, what stands before them, learnt or not."""

    def __init__(self, m: Corpus, row: dict):
        self.seq = _unpacked(row["seq"], row["tokens"])
        self.lengths = _unpacked(row["lengths"], row["docs"])
        self.learnt = np.repeat(_unpacked(row["held"], row["docs"], np.uint8) == 0, self.lengths)
        self.before = [np.concatenate([[1 + END], self.seq[:-1]]).astype(np.int32)]
        for j in range(2, m.order):
            p = np.concatenate([[0], self.before[-1][:-1]]).astype(np.int32)
            p[self.before[-1] == (1 + END if j == 2 else 0)] = 0
            self.before.append(p)
        self.hashes = np.concatenate([m.hashes, np.frombuffer(row["hashes"], np.uint64)])
        self.counts = _unpacked(row["counts"], len(self.hashes) - m.size, np.int64)


class Parts:
    """Where a step goes: all that follow one symbol to one bucket, but those of a symbol with
    more than ``piece`` occurrences are dealt by the symbol before it to buckets of their own."""

    def __init__(self, m: Corpus, tokens: int, piece: int):
        scale = tokens / max(m.n, 1)                # of all rows to the training rows
        pieces = np.maximum(1, np.ceil(m.counts * scale / piece)).astype(np.int64)
        self.hot = np.flatnonzero(pieces > 1)       # codes
        self.pieces = pieces[self.hot]
        rest = tokens - (m.counts[self.hot] * scale).sum()
        self.plain = max(1, math.ceil(rest / piece))
        self.base = self.plain + np.cumsum(self.pieces) - self.pieces
        self.all = self.plain + int(self.pieces.sum())

    def of(self, steps: Steps) -> np.ndarray:
        h = steps.hashes
        bucket = (mix64(h + _SALT) % np.uint64(self.plain)).astype(np.int64)
        pieces = np.ones(len(h), np.int64)
        bucket[self.hot], pieces[self.hot] = self.base, self.pieces
        last = steps.before[0]
        out = bucket[last]
        if len(self.hot):
            at = np.flatnonzero(pieces[last] > 1)
            by = (steps.before[1] if len(steps.before) > 1 else steps.seq)[at]
            out[at] += (mix64(h[by]) % pieces[last[at]].astype(np.uint64)).astype(np.int64)
        return out.astype(np.uint16) if self.all < 1 << 16 else out


def _hot_pairs(coded: DataFrame, shared, parts: Parts, size: int) -> DataFrame:
    """(hot, n, keys, counts): how often what follows each symbol that is dealt to many buckets."""
    split, hot = max(1, -(-size // BUCKET)), parts.hot

    def deal(batches):
        m = shared.value
        for b in batches:
            for r in b.to_pylist():
                s = Steps(m, r)
                number = np.full(len(s.hashes), -1)
                number[hot] = np.arange(len(hot))
                at = np.flatnonzero((number[s.before[0]] >= 0) & s.learnt)
                pair = number[s.before[0][at]] * len(s.hashes) + s.seq[at]
                pair, c = np.unique(pair, return_counts=True)
                which, symbol = np.divmod(pair, len(s.hashes))
                keys = _key(s.hashes[hot[which]], s.hashes[symbol]) if len(pair) else np.empty(0, np.uint64)
                of = _part_of(keys, split)
                for i in range(split):
                    g = of == i
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int64()), pa.array([int(g.sum())], pa.int64()),
                         *[pa.array([x], pa.binary()) for x in (_packed(which[g]), keys[g].tobytes(), _packed(c[g]))]],
                        names=["part", "n", "hot", "keys", "c"])

    def total(key, t):
        n = t.column("n").to_pylist()
        which, c = (np.concatenate([_unpacked(x, k) for x, k in zip(t.column(name).to_pylist(), n)])
                    for name in ("hot", "c"))
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()])
        one, number = _runs(keys)
        c, which, keys = np.bincount(number, c, len(one)).astype(np.int64), which[one], keys[one]
        groups = [np.flatnonzero(which == i) for i in range(len(hot))]
        return pa.table([pa.array(range(len(hot)), pa.int64()), pa.array([len(g) for g in groups], pa.int64()),
                         pa.array([keys[g].tobytes() for g in groups], pa.binary()),
                         pa.array([_packed(c[g], np.int64) for g in groups], pa.binary())],
                        names=["hot", "n", "hashes", "counts"])

    return (coded.mapInArrow(deal, "part bigint, n bigint, hot binary, keys binary, c binary")
            .groupBy("part").applyInArrow(total, "hot bigint, n bigint, hashes binary, counts binary"))


def _dealt(coded: DataFrame, shared, parts: Parts) -> DataFrame:
    """(bucket, chunk, n, others, steps, hashes, counts): the steps of a chunk that go to a bucket,
    as columns of codes and of texts, and the other words that they name."""

    def run(batches):
        m = shared.value
        for b in batches:
            for r in b.to_pylist():
                s = Steps(m, r)
                bucket = parts.of(s)
                order = np.argsort(bucket, kind="stable")
                doc = 2 * np.repeat(np.arange(len(s.lengths), dtype=np.int32), s.lengths) + s.learnt
                columns = [x[order] for x in (doc, s.seq, *s.before)]
                bucket = bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                own = np.zeros(len(s.hashes), np.int32)
                rows = []
                for a, z in zip(cut, np.append(cut[1:], len(bucket))):
                    some = [x[a:z].copy() for x in columns]
                    names = np.concatenate([x[x >= m.size] for x in some[1:]])
                    names = np.unique(names)
                    own[names] = m.size + np.arange(len(names))
                    for x in some[1:]:
                        x[x >= m.size] = own[x[x >= m.size]]
                    some[0][1:] -= some[0][:-1].copy()
                    rows.append((int(bucket[a]), r["chunk"], z - a, len(names),
                                 _packed(np.concatenate(some)), s.hashes[names].tobytes(),
                                 _packed(s.counts[names - m.size], np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()] * 3)],
                    names=["bucket", "chunk", "n", "others", "steps", "hashes", "counts"])

    return coded.mapInArrow(run, DEALT)


def _walked(dealt: DataFrame, shared, parts: Parts) -> DataFrame:
    """(chunk, n, docs, sums): what the steps of a bucket add to the log10 probability of each text,
    in units of 1 / UNIT."""

    def slices(rows, size):
        some, n = [], 0
        for r in rows:
            some.append(r)
            n += r["n"]
            if n >= size:
                yield some
                some, n = [], 0
        if some:
            yield some

    def run(key, t):
        m, rows = shared.value, t.to_pylist()
        part = Part(m, parts, key[0].as_py(), [r for r in rows if r["chunk"] is None])
        rows = [r for r in rows if r["chunk"] is not None]
        groups = list(slices(rows, SLICE))
        ready = None
        for g in groups:
            ready = part.learn(g)
        value = part.values()
        out = []
        for g in groups:
            distinct, number, docs, ends = ready if len(groups) == 1 else part.read(g)[:4]
            v = (value if len(groups) == 1 else value[np.searchsorted(part.keys, distinct)])[number]
            at = np.concatenate([[0], np.cumsum(ends)])
            sums = np.bincount(docs, np.rint(v * UNIT), at[-1])
            met = np.bincount(docs, minlength=at[-1]) > 0
            for r, a, z in zip(g, at, at[1:]):
                d = np.flatnonzero(met[a:z])
                out.append((r["chunk"], len(d), _packed(np.diff(d, prepend=0)), _packed(sums[a:z][d], np.int64)))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["chunk", "n", "docs", "sums"])

    return dealt.groupBy("bucket").applyInArrow(run, SUMS)


class Part:
    """The part of the automaton whose states end in the symbols of one bucket.  All steps out of
    these states are here, so their stored sequences, totals and backoff weights are known; of
    symbols that are dealt to many buckets the pairs come ready counted."""

    def __init__(self, m: Corpus, parts: Parts, bucket: int, pairs: list[dict]):
        self.m, self.hot = m, m.hashes[parts.hot] if bucket >= parts.plain else np.empty(0, np.uint64)
        self.pair_keys = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r["hashes"], np.uint64) for r in pairs]])
        self.pair_counts = np.concatenate([np.empty(0), *[_unpacked(r["counts"], r["n"], np.int64) for r in pairs]])
        self.pair_state = np.concatenate([np.empty(0, np.uint64),
                                          *[np.full(r["n"], m.hashes[parts.hot[r["others"]]]) for r in pairs]])
        self.keys = np.empty(0, np.uint64)
        self.held: list[tuple] = []

    def _columns(self, rows: list[dict]):
        m, width = self.m, max(2, self.m.order) + 1
        columns, hashes, counts, docs, ends, extra = [], [m.hashes], [], [], [], 0
        base = 0
        for r in rows:
            some = _unpacked(r["steps"], r["n"] * width).reshape(width, -1).copy()
            doc = np.cumsum(some[0])
            some = some[1:]
            some[some >= m.size] += extra
            extra += r["others"]
            hashes.append(np.frombuffer(r["hashes"], np.uint64))
            counts.append(_unpacked(r["counts"], r["others"], np.int64))
            columns.append(some)
            ends.append(int(doc.max() >> 1) + 1)
            docs.append(doc + 2 * base)
            base += ends[-1]
        docs = np.concatenate(docs)
        return (np.concatenate(columns, axis=1), np.concatenate(hashes), np.concatenate(counts), docs >> 1,
                (docs & 1).astype(bool), ends)

    def _keys(self, codes: np.ndarray, hashes: np.ndarray):
        """By length: hash of the state and of the sequence; of none where the state is none."""
        symbol = hashes[codes[0]]
        state = hashes[codes[1]]
        out = [(state, _key(state, symbol))]
        for p in codes[2:]:
            state = _key(state ^ _STATE, hashes[p])
            out.append((state, _key(state, symbol)))
        return out

    def read(self, rows: list[dict]):
        """(keys of the distinct steps, number of every step's, its text, how many texts each row has,
        more of the distinct steps)"""
        codes, hashes, counts, docs, learnt, ends = self._columns(rows)
        one, number = _runs(self._keys(codes, hashes)[-1][1])
        times = np.bincount(number[learnt], minlength=len(one)).astype(float)
        codes = codes[:, one]
        keys = self._keys(codes, hashes)
        return keys[-1][1], number, docs, ends, (times, self.m.logp(counts)[codes[0]], codes[1:] != 0,
                                                 [s for s, _ in keys], [k for _, k in keys])

    def learn(self, rows: list[dict]):
        distinct, number, docs, ends, more = self.read(rows)
        self.held.append((distinct, *more))
        if len(self.held) > 1:
            a, b = self.held
            both = np.concatenate([a[0], b[0]])
            at, place = _runs(both)
            self.held = [(both[at], np.bincount(place, np.concatenate([a[1], b[1]]), len(at)),
                          np.concatenate([a[2], b[2]])[at], np.concatenate([a[3], b[3]], axis=1)[:, at],
                          *[[np.concatenate([x, y])[at] for x, y in zip(a[i], b[i])] for i in (4, 5)])]
        return distinct, number, docs, ends

    def values(self) -> np.ndarray:
        """log10 probability of the last symbol of every distinct step: stored sequences have
        their discounted share and the backoff's, at others the failure arc is taken."""
        if not self.held:
            return np.empty(0)
        self.keys, times, logp, good, states, keys = self.held[0]
        m = self.m
        for k in range(2, m.order + 1):
            state, gram, c = states[k - 2], keys[k - 2], times
            if k == 2 and len(self.hot):
                c = np.where(np.isin(state, self.hot), 0.0, c)
                state, gram = np.concatenate([state, self.pair_state]), np.concatenate([gram, self.pair_keys])
                c = np.concatenate([c, self.pair_counts])
            one, number = _runs(gram)
            c = np.bincount(number, c, len(one))
            _, of = _runs(state[one])
            total = np.bincount(of, c)
            stored = c >= m.least
            own = np.where(stored, c - m.discount, 0.0) / np.maximum(total[of], 1.0)
            left = np.maximum(1 - np.bincount(of, own), 1e-12)
            known = (total > 0 if k == 2 else total >= m.least)[of]
            number = number[:len(logp)]
            own, left, stored, known = (x[number] for x in (own, left[of], stored, known))
            known &= good[k - 2]
            logp = np.where(known & stored, np.log10(own + left * 10 ** logp),
                            np.where(known, np.log10(left) + logp, logp))
        return logp


def _scores(coded: DataFrame, sums: DataFrame, m: Corpus, id_col: str) -> DataFrame:
    """The rows of all texts from their chunks and what the buckets add."""
    idt = coded.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type
    per_token, n = math.log10(m.n + m.v + 1), m.n

    def run(left, right):
        r = left.to_pylist()[0]
        walk = np.zeros(r["docs"], np.int64)
        for d, s, k in zip(right.column("docs").to_pylist(), right.column("sums").to_pylist(), right.column("n").to_pylist()):
            walk[np.cumsum(_unpacked(d, k))] += _unpacked(s, k, np.int64)
        lengths = _unpacked(r["lengths"], r["docs"]).astype(np.int64)
        return pa.table([pa.array(r["ids"], to_arrow_type(idt)), pa.array(_unpacked(r["held"], r["docs"], np.uint8) == 1),
                         pa.array(lengths), pa.array(r["known"], pa.int64()),
                         pa.array(np.full(r["docs"], n, np.int64)),
                         pa.array(np.array(r["base"]) - lengths * per_token),
                         pa.array(walk / UNIT + np.array(r["inside"]))],
                        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.select("chunk", "ids", "docs", "held", "lengths", "known", "base", "inside").groupBy("chunk").cogroup(
        sums.groupBy("chunk")).applyInArrow(
        run, f"`{id_col}` {idt.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held_out: int = 2,
              order: int = 3, word_share: float = 0.0, gram_share: float = 0.0, discount: float = 0.75,
              piece: int = 1 << 19, keep: int = 1 << 17) -> DataFrame:
    """One row per input row: the id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10).

    Learns from rows whose ``crc32(id) mod folds`` is not ``held_out``.  A null or
    empty text is its end alone; repeated rows are counted and scored each; null
    ids count as the empty text's hash.  Without training rows nothing is known
    and both scores are 0; an empty table gives an empty result."""
    small_batches(docs)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    out_fold = F.pmod(crc_of_id("id"), F.lit(folds)) == held_out
    docs = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).select("id", "text", out_fold.alias("held"))
    chunks = scratch.cut(_chunks(docs), "chunks")
    sizes = chunks.agg(F.sum("words"), F.sum("tokens")).first()
    words, tokens = (x or 0 for x in sizes)
    totals = scratch.cut(_word_totals(chunks, words, keep), "words")
    found = totals.where("chunk is null").select("a", "b").collect()
    m = Corpus([bytes(r["b"]) for r in found], [bytes(r["a"]) for r in found], keep=keep, word_share=word_share,
               gram_share=gram_share, order=order, discount=discount)
    shared = spark.sparkContext.broadcast(m)
    coded = scratch.cut(_coded(chunks, totals, shared, words), "coded")
    scratch.drop(chunks, totals)
    if not m.n:
        return _scores(coded, spark.createDataFrame([], SUMS), m, id_col)
    parts = Parts(m, tokens, piece)
    dealt = _dealt(coded, shared, parts)
    if len(parts.hot):
        often = int(m.counts[parts.hot].sum())
        pairs = scratch.cut(_hot_pairs(coded, shared, parts, often), "pairs")
        first, last = (constant_array(x.tolist(), "array<bigint>") for x in (parts.base, parts.base + parts.pieces - 1))
        at = (F.col("hot") + 1).cast("int")
        dealt = dealt.unionByName(pairs.where("n > 0").select(
            F.explode(F.sequence(F.element_at(first, at), F.element_at(last, at))).alias("bucket"),
            F.lit(None).cast("bigint").alias("chunk"), "n", F.col("hot").alias("others"),
            F.lit(None).cast("binary").alias("steps"), "hashes", "counts"))
    sums = scratch.cut(_walked(dealt, shared, parts), "sums")
    return _scores(coded, sums, m, id_col)


def op2_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
