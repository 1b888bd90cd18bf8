"""Text normalisation, tokenising, stop-word removal and n-grams as Column expressions.

All of these stay inside the JVM (regexp, split, higher-order array
functions), so they run per partition with no Python worker and no shuffle.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (BAD_SYMBOLS_RE, ENGLISH_STOP_WORDS, EXTRA_STOP_WORDS, FUSED_FORMS,
                        PUNCT_OR_DIGIT_RE, SPACE_BY_SYMBOLS_RE, WHITESPACE_RE, WORD2_RE)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    """X1."""
    return F.lower(_c(col))


def strip_punct_digits(col) -> Column:
    """Lower-case, delete ASCII punctuation, delete ASCII digits (first half of X2)."""
    return F.regexp_replace(F.lower(_c(col)), PUNCT_OR_DIGIT_RE, "")


def split_ws(col) -> Column:
    """Whitespace tokens with empties removed (``str.split()`` semantics)."""
    return F.filter(F.split(_c(col), WHITESPACE_RE), lambda t: t != "")


def split_fused(tokens) -> Column:
    """Split the fused forms a word tokeniser separates (``cannot`` -> ``can not``)."""
    m = F.create_map(*[x for k, v in FUSED_FORMS.items() for x in (F.lit(k), F.lit(v))])
    # referenced once: a guard such as arrays_overlap(...) would make the
    # optimizer evaluate the whole token expression twice
    return F.flatten(F.transform(_c(tokens), lambda t: F.when(
        m[t].isNotNull(), F.split(m[t], " ")).otherwise(F.array(t))))


def remove_words(tokens, words: Iterable[str]) -> Column:
    """Drop tokens in a small fixed list, keeping order and repeats."""
    # `isin` with many literals becomes a hash-set lookup (InSet) in the plan.
    words = list(words)
    return F.filter(_c(tokens), lambda t: ~t.isin(*words))


def remove_stop_words(tokens, extra: bool = False) -> Column:
    words = list(ENGLISH_STOP_WORDS) + (EXTRA_STOP_WORDS if extra else [])
    return remove_words(tokens, words)


def normalize_tokens_a(col, fused: bool = True) -> Column:
    """X2 without the lemma step: lower, strip punctuation and digits, tokenise,
    drop English stop words.  Returns ``array<string>``."""
    toks = split_ws(strip_punct_digits(col))
    if fused:
        toks = split_fused(toks)
    return remove_stop_words(toks)


def normalize_text_a(col) -> Column:
    return F.array_join(normalize_tokens_a(col), " ")


def clean_symbols(col) -> Column:
    """X3 up to tokenising: lower, symbols to blank, delete everything outside
    ``[0-9a-z #+_]``.  Newlines are deleted, so words across them fuse (kept)."""
    s = F.regexp_replace(F.lower(_c(col)), SPACE_BY_SYMBOLS_RE, " ")
    return F.regexp_replace(s, BAD_SYMBOLS_RE, "")


def clean_tokens_b(col, extra: bool = False) -> Column:
    toks = F.filter(F.split(clean_symbols(col), " +"), lambda t: t != "")
    return remove_stop_words(toks, extra=extra)


def clean_text_b(col, extra: bool = False) -> Column:
    """X3 (+ X6 when ``extra``): cleaned text joined by single blanks."""
    return F.array_join(clean_tokens_b(col, extra=extra), " ")


def explode_tokens(df, id_col, tokens_col, out: str = "token"):
    """(id, token) rows, one per token occurrence.

    ``explode_outer`` + a null filter instead of ``explode``: for ``explode``
    the optimizer infers a ``size(array) > 0`` filter below the projection,
    which evaluates the whole tokenising expression a second time."""
    cols = [F.col(id_col)] if id_col else []
    return df.select(*cols, F.explode_outer(_c(tokens_col)).alias(out)).where(F.col(out).isNotNull())


def word_tokens(col) -> Column:
    """F4 token pattern: lower-cased runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD2_RE), 0)


def ngrams(tokens, n: int) -> Column:
    """Sliding word n-grams joined by a blank; empty when fewer than n tokens."""
    t = _c(tokens)
    if n == 1:
        return t
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(t) - n),
                    lambda i: F.array_join(F.slice(t, i + 1, n), " ")))


def written_words(col) -> Column:
    """Cased words and single other signs, as sub-word splitting takes them."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"([\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}])"))
