"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is the encoding of a shorter prefix and one last token,
and that last token is the only vocabulary entry ending there that is compatible
with the last token before it.  So one number per prefix -- its last token -- is
enough state.  The distinct new words of a batch are put in trie order; going
depth-first, a word keeps the states of the prefix it shares with its
predecessor and computes only the rest; the word-end symbol closes the word, and
its tokens are read back along the last tokens.  The entries that end at a prefix
are those at its place in the vocabulary's suffix automaton, longest first, so
a prefix tries no start where nothing ends.

Texts are cut at ASCII white space; each distinct stretch between is normalised
and split, and each distinct word encoded, once per worker (bounded dictionaries);
a text's ids are the joined ids of its stretches.  No shuffle; memory is bounded by
the dictionaries and one batch."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import Recent, in_parts, small_batches, table, utf8

MAX_PAIRS, KEPT_WORDS, KEPT_STRETCHES = 300_000, 200_000, 50_000


class Suffixes:
    """Automaton over the byte strings of several tables: from a place and a byte to the
    place of the longest suffix that begins some string.  ``ends[k]`` has, for places
    asked before, the (length, value) of table k's strings that end there, longest first."""

    def __init__(self, *tables: dict[bytes, int]):
        self.edges: dict[int, int] = {}               # place << 8 | byte -> place
        self.own: list[dict[int, tuple[int, int]]] = [{} for _ in tables]
        above, n = [(0, 0)], 1                        # (parent, byte) of every place
        for own, strings in zip(self.own, tables):
            for key, value in strings.items():
                here = 0
                for b in key:
                    edge = here << 8 | b
                    there = self.edges.get(edge)
                    if there is None:
                        there = self.edges[edge] = n
                        above.append((here, b))
                        n += 1
                    here = there
                own[here] = (len(key), value)
        depth = [0] * n
        for i in range(1, n):                         # parents have smaller numbers
            depth[i] = depth[above[i][0]] + 1
        self.back = [0] * n
        for i in sorted(range(1, n), key=depth.__getitem__):
            parent, b = above[i]
            if parent:
                self.back[i] = self._step(self.back[parent], b)
        self.ends: list[dict[int, list]] = [{} for _ in tables]
        self.learnt: list[int] = []

    def _step(self, place: int, byte: int) -> int:
        while True:
            there = self.edges.get(place << 8 | byte)
            if there is not None or not place:
                return there or 0
            place = self.back[place]

    def step(self, edge: int) -> int:
        """The place for an edge that no string has, remembered as an edge."""
        if len(self.learnt) >= MAX_PAIRS:
            for old in self.learnt:
                del self.edges[old]
            self.learnt = []
        self.learnt.append(edge)
        there = self.edges[edge] = self._step(edge >> 8, edge & 255)
        return there

    def ending(self, table: int, place: int) -> list[tuple[int, int]]:
        out, here, own = [], place, self.own[table]
        while here:
            if here in own:
                out.append(own[here])
            here = self.back[here]
        self.ends[table][place] = out                 # bounded by the vocabulary's places
        return out


class TrieBpe:
    """Vocabulary and states of a word-level BPE file with word-end symbols."""

    def __init__(self, path: str):
        d = vocab.load(path)
        model = d["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.symbol = vocab.byte_symbols()
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        made = {a + b for a, b in merges}
        # own numbers: symbols first, then merges in their order
        names = [t for t in ids if t not in made and t not in self.special] + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(names)}
        base = len(names) - len(merges)
        self.ids = [ids[t] for t in names]
        self.left = list(range(base)) + [number[a] for a, _ in merges]
        self.right = list(range(base)) + [number[b] for _, b in merges]
        self.pair = {(number[a], number[b]): base + i for i, (a, b) in enumerate(merges)}
        self.ok: dict[tuple[int, int], bool] = {}
        back = {c: b for b, c in self.symbol.items()}
        self.mid, self.end, self.length = {}, {}, [0] * len(names)
        for t, i in number.items():
            if i >= base and not self._compatible(self.left[i], self.right[i], i):
                continue                      # never the encoding of its own text
            closed = bool(self.suffix) and t.endswith(self.suffix)
            key = bytes(back[c] for c in (t[:-len(self.suffix)] if closed else t))
            (self.end if closed else self.mid)[key] = i
            self.length[i] = len(key)
        self.suffixes = Suffixes(self.mid, self.end if self.suffix else self.mid)
        self.token = dict(zip(ids.values(), ids)) | {i: t for t, i in self.special.items()}
        self.split = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.raw = {i: int(i).to_bytes(4, "little") for i in self.token}
        self.name = {i: t.encode() for i, t in self.token.items()}
        self.known = Recent(self.learn_words, KEPT_WORDS)
        self.recent = Recent(self.learn, KEPT_STRETCHES)

    def _compatible(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether tokens a, b stay apart: no merge across their border, undone
        down to symbols from the latest merge on, comes before the halves' own."""
        left, right, pair = self.left, self.right, self.pair
        while True:
            c = pair.get((a, b))
            if c is not None and c < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _apart(self, a: int, b: int) -> bool:
        """``_compatible``, remembered."""
        if len(self.ok) >= MAX_PAIRS:
            self.ok.clear()
        good = self.ok[a, b] = self._compatible(a, b)
        return good

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Ids of each word, by one depth-first pass over their trie."""
        out, state, places, prev = {}, [], [0], b""
        suffixes, known, length = self.suffixes, self.ok, self.length
        edges, (inside, final) = suffixes.edges, suffixes.ends
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(state), size - 1)
            while shared < most and word[shared] == prev[shared]:
                shared += 1
            del state[shared:]
            del places[shared + 1:]
            place = places[-1]
            for stop in range(shared + 1, size + 1):
                edge = place << 8 | word[stop - 1]
                place = edges.get(edge)
                if place is None:
                    place = suffixes.step(edge)
                if stop < size:
                    ends = inside.get(place)
                    if ends is None:
                        ends = suffixes.ending(0, place)
                else:
                    ends = final.get(place)
                    if ends is None:
                        ends = suffixes.ending(1, place)
                for n, t in ends:                     # the last token is the one that stays apart
                    if n == stop:
                        break
                    pair = (state[stop - n - 1], t)
                    good = known.get(pair)
                    if good or good is None and self._apart(*pair):
                        break
                else:
                    raise ValueError(f"no token ends at {stop} of {word!r}")
                if stop < size:
                    places.append(place)
                    state.append(t)
            tokens, at = [t], size - length[t]
            while at > 0:
                t = state[at - 1]
                tokens.append(t)
                at -= length[t]
            out[word], prev = [self.ids[t] for t in reversed(tokens)], word
        return out

    def learn_words(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit, decoded text and a blank) of each word."""
        coded = {w: w.encode() for w in words}
        ids = self.encode_words(set(coded.values()))
        raw = self.raw
        return {w: (b"".join([raw[i] for i in ids[c]]), self.decode(ids[c]) + b" ") for w, c in coded.items()}

    def learn(self, stretches: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """(ids, decoded text and a blank) of each stretch."""
        plain, parts = list(stretches), []             # (stretch, its pieces but the special tokens)
        marked = [s for s in plain if b"<|" in s and any(x in s.decode("utf-8", "replace") for x in self.special)]
        if marked:
            plain = list(stretches.difference(marked))
            parts = [[p for p in self.cut(s.decode("utf-8", "replace")) if p] for s in marked]
        lines = b"\n".join(plain).decode("utf-8", "replace").split("\n") if plain else []
        lines += [p for pieces in parts for p in pieces if p not in self.special]
        found = self.split(unicodedata.normalize("NFC", "\n".join(lines)).replace("Σ", "σ").lower())
        known = self.known.values(set(found).difference("\n"))
        rows, row = [], []
        for w in found:
            if w == "\n":
                rows.append(row)
                row = []
            else:
                row.append(known[w])
        rows.append(row)
        joined = [r[0] if len(r) == 1 else (b"".join([x for x, _ in r]), b"".join([y for _, y in r])) for r in rows]
        out = dict(zip(plain, joined))
        rest = iter(joined[len(plain):])
        for s, pieces in zip(marked, parts):
            both = [(self.raw[self.special[p]], self.name[self.special[p]] + b" ") if p in self.special else next(rest)
                    for p in pieces]
            out[s] = b"".join([x for x, _ in both]), b"".join([y for _, y in both])
        return out

    def decode(self, ids) -> bytes:
        """The library's text of the ids: without a decoder step, the tokens' names
        with blanks between."""
        return b" ".join([self.name[i] for i in ids])

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of every text."""
        cut = [t.split() if t else [] for t in texts]
        known = self.recent.values(set().union(*cut))
        out = []
        for stretches in cut:
            found = [known[s] for s in stretches]
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])[:-1]))
        return out


_MODELS: dict[str, TrieBpe] = {}


def trie_bpe(path: str) -> TrieBpe:
    if path not in _MODELS:
        _MODELS[path] = TrieBpe(path)
    return _MODELS[path]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
               tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256 (of the ids as
    little-endian 32-bit numbers), decoded_sha256 and, on demand, ids and decoded.

    A null or empty text has no tokens; rows are taken one by one, so repeated
    rows and null ids keep theirs; an empty table gives an empty result.  Special
    tokens written out in a text become their ids, as the library has it."""
    small_batches(docs)
    path = tokenizer or vocab.default_path("word_bpe_49k.json")

    def run(batches):
        model = trie_bpe(path)
        for b in in_parts(batches):
            found = model.encode_batch(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for _, t in found], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                cols += [pa.array([i for i, _ in found], pa.binary()),
                         pa.array([t.decode() for _, t in found], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    idt = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {idt}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), utf8(text_col)).mapInArrow(
        run, schema + ", ids binary, decoded string" * with_text)


def op9_prefix_trie_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), with_text=False)
