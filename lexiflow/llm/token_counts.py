"""Token counts of a unigram vocabulary by trie-shared dynamic programming.

A pre-token (a word with the word-start mark before it) is cut into the pieces
of a vocabulary with the highest total score, the fewest pieces among equals.
The forward score of a prefix depends on the prefix alone, so the distinct new
pre-tokens of a batch are taken in trie order: going depth-first, each keeps the
forward scores of the prefix it shares with its predecessor, computes the rest,
and stores its terminal count.  A text's count is the sum over its words.

Narrow pass, no shuffle; each worker keeps a bounded dictionary of words."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import Recent, in_parts, small_batches, table, utf8

MARK = "▁"
MICRO = 1_000_000
UNKNOWN_PENALTY = 10 * MICRO


def read_pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece file with integer scores.  The file orders its
    pieces by usefulness; the score is that of Zipf's law, minus the logarithm of
    the place, in millionths."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {t: -round(MICRO * math.log(i + 2)) for i, t in enumerate(names)}


class UnigramTrie:
    """Best score and token count of words."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        # every ending of a piece, with the score of those that are pieces themselves
        self.endings = {t[i:]: pieces.get(t[i:]) for t in pieces for i in range(len(t))}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.recent = Recent(self.learn, limit=300_000)

    def _step(self, word: str, stop: int, best: list) -> tuple[int, int]:
        """(score, -tokens) of word[:stop] from those of its shorter prefixes."""
        top, endings = None, self.endings
        for start in range(stop - 1, -1, -1):
            piece = word[start:stop]
            if piece not in endings:
                break
            s = endings[piece]
            if s is not None:
                score, tokens = best[start]
                here = (score + s, tokens - 1)
                if top is None or here > top:
                    top = here
        last = word[stop - 1]
        if endings.get(last) is None:     # an unknown character: as many tokens as bytes
            score, tokens = best[stop - 1]
            here = (score + self.unknown, tokens - len(last.encode()))
            if top is None or here > top:
                top = here
        return top

    def learn(self, words: set[bytes]) -> dict[bytes, tuple[int, int]]:
        """(tokens, score) of each word, by one depth-first pass over their trie."""
        out, best, prev = {}, [(0, 0)], ""
        for text, word in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(text), len(prev))
            while shared < most and text[shared] == prev[shared]:
                shared += 1
            del best[shared + 1:]
            for stop in range(shared + 1, len(text) + 1):
                best.append(self._step(text, stop, best))
            out[word] = (-best[-1][1], best[-1][0])
            prev = text
        return out

    def count(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(words, tokens, score) of each text."""
        cut = [t.split() if t else [] for t in texts]
        known = self.recent.values(set().union(*cut))
        out = []
        for ws in cut:
            found = [known[w] for w in ws]
            out.append((len(ws), sum([f[0] for f in found]), sum([f[1] for f in found])))
        return out


_MODELS: dict[str, UnigramTrie] = {}


def unigram_trie(path: str) -> UnigramTrie:
    if path not in _MODELS:
        _MODELS[path] = UnigramTrie(read_pieces(path))
    return _MODELS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 vocabulary: str | None = None) -> DataFrame:
    """One row per input row: the id, n_words, n_tokens and score (millionths of
    a natural logarithm, of the best cutting).

    A null, empty or blank text has no words and no tokens; repeated rows and
    null ids keep their rows; an empty table gives an empty result.  Characters
    outside the vocabulary count as their UTF-8 bytes."""
    small_batches(docs)
    path = vocabulary or vocab.default_path("piece_bpe_32k.model")

    def run(batches):
        model = unigram_trie(path)
        for b in in_parts(batches):
            found = model.count(b.column(1).to_pylist())
            cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "n_words", "n_tokens", "score"])

    idt = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text_col)).mapInArrow(
        run, f"`{id_col}` {idt}, n_words bigint, n_tokens bigint, score bigint")


def op1_trie_unigram(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
