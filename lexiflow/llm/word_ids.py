"""Token ids of texts by a word-level BPE file with word-end symbols, in batches.

Texts are cut at ASCII white space, and each distinct stretch between is encoded
once and remembered in a bounded pool.  The new stretches of a batch are joined by
line feeds, normalised and lower-cased; the classes of all their characters give
the words' borders at once; a mark closes every word, and the vocabulary takes the
word-end symbol for that mark, so one call of the merge library encodes them all.
The line feed's own token tells the stretches apart again."""

from __future__ import annotations

import re
import sys
import unicodedata
from itertools import chain

import numpy as np

from . import vocab

MARK = "\x01"
SPACE, LETTER, NUMBER, OTHER, LINE = range(5)


class Ragged:
    """Rows of any length, end to end."""

    def __init__(self, kind=np.uint32):
        self.values = np.empty(0, kind)
        self.starts = np.zeros(1, np.int64)

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Rows given end to end, and where each ends."""
        self.starts = np.concatenate([self.starts, len(self.values) + np.asarray(ends, np.int64)])
        self.values = np.concatenate([self.values, values.astype(self.values.dtype)])

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.starts[numbers + 1] - self.starts[numbers]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The values of the numbered rows, end to end."""
        n = self.lengths(numbers)
        at = np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n)
        return self.values[at + np.arange(len(at))]


class Pool(dict):
    """Numbers distinct byte strings as they are met; each of ``columns`` has a row
    for every number.  Cleared between batches once it is full."""

    def __init__(self, *kinds, limit: int = 400_000):
        super().__init__()
        self.limit, self.kinds = limit, kinds or (np.uint32,)
        self.new: list[bytes] = []
        self.columns = [Ragged(k) for k in self.kinds]

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list[list[bytes]]) -> np.ndarray:
        """The numbers of all keys; ``new`` holds those met for the first time."""
        if len(self) > self.limit:
            self.clear()
            self.columns = [Ragged(k) for k in self.kinds]
        self.new = []
        return np.fromiter(map(self.__getitem__, chain.from_iterable(keys)), np.int64, sum(map(len, keys)))


def character_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    # fixed values: the code points with the property White_Space
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
         0x3000]] = SPACE
    out[0x0A] = LINE
    return out


class WordIds:
    def __init__(self, path: str):
        import tiktoken
        self.path = path
        d = vocab.load(path)
        model = d["model"]
        suffix, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = [t["content"].encode() for t in d["added_tokens"]]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in d["added_tokens"])])
        back = {c: b for b, c in vocab.byte_symbols().items()}

        def raw(token: str) -> bytes:
            closed = token.endswith(suffix)
            return bytes(back[c] for c in (token[:-len(suffix)] if closed else token)) + MARK.encode() * closed

        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        symbols = set(ids) - set(merged) - {t["content"] for t in d["added_tokens"]}
        names = sorted(symbols, key=lambda t: (t.endswith(suffix), ids[t])) + merged
        ranks = {raw(t): i for i, t in enumerate(names)}
        self.ids = np.array([ids[t] for t in names], np.uint32)
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks,
                                          special_tokens={})
        self.line = ranks[b"\n" + MARK.encode()]
        self.classes = character_classes()
        self.odd = re.compile(b"|".join(map(re.escape, [MARK.encode(), *self.special]))).search
        self.pool = Pool()
        self.library = None

    def _marked(self, text: str) -> str:
        """The words and line feeds of a text, each closed by the mark."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[c]
        first = np.ones(len(c) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == LINE)
        quote = np.flatnonzero((c == ord("'")) & first[:-1])       # fixed values: 's 't 're 've 'm 'll 'd
        far = np.concatenate([c, np.zeros(2, np.uint32)])
        one, two = far[quote + 1], far[quote + 2]
        short = quote[np.isin(one, [ord(x) for x in "stmd"])]
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        long = quote[pair]
        first[short + 1], first[short + 2] = False, True
        first[long + 1], first[long + 3] = False, True
        keep = np.flatnonzero(kind != SPACE)
        step = 1 + first[keep + 1]
        out = np.full(int(step.sum()), ord(MARK), np.uint32)
        out[np.cumsum(step) - step] = c[keep]
        return out.tobytes().decode("utf-32-le")

    def _learn(self, stretches: list[bytes]) -> None:
        blob = b"\n".join(stretches)
        if self.odd(blob):
            whole = [self._whole(s) if self.odd(s) else None for s in stretches]
            blob = b"\n".join([s if w is None else b"" for s, w in zip(stretches, whole)])
        else:
            whole = None
        found = self.encoding.encode_to_numpy(self._marked(blob.decode("utf-8", "replace")))
        cuts = np.flatnonzero(found == self.line)
        values = self.ids[np.delete(found, cuts)]
        ends = np.append(cuts - np.arange(len(cuts)), len(values))
        if whole:
            parts = [p if w is None else w for p, w in zip(np.split(values, ends[:-1]), whole, strict=True)]
            values, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        self.pool.columns[0].add(values, ends)

    def _whole(self, stretch: bytes) -> np.ndarray:
        """A stretch that holds the mark or a special token, by the tokenizers library."""
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
            self.library.no_padding()
            self.library.no_truncation()
        return np.array(self.library.encode(stretch.decode("utf-8", "replace"), add_special_tokens=False).ids,
                        np.uint32)

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        cut = [t.split() if t else [] for t in texts]
        numbers = self.pool.numbers(cut)
        if self.pool.new:
            self._learn(self.pool.new)
        ids = self.pool.columns[0]
        upto = np.append(0, np.cumsum(ids.lengths(numbers)))
        ends = upto[np.cumsum([len(c) for c in cut], dtype=np.int64)]
        return ids.gather(numbers), np.diff(ends, prepend=0)


_MODELS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _MODELS:
        _MODELS[path] = WordIds(path)
    return _MODELS[path]
