"""SQL fragments (DuckDB dialect) for the independent oracle.

They are built from the same fixed values as the Spark expressions, so a
change of constant reaches both sides.
"""

from __future__ import annotations

from ..functions.constants import (ASCII_PUNCT_RE, BAD_SYMBOLS_RE, DIGITS_RE, ENGLISH_STOP_WORDS,
                                   EXTRA_STOP_WORDS, FUSED_FORMS, SPACE_BY_SYMBOLS_RE,
                                   WHITESPACE_RE)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


STOP = str_list(ENGLISH_STOP_WORDS)
STOP_EXTRA = str_list(list(ENGLISH_STOP_WORDS) + EXTRA_STOP_WORDS)


def keyed_hash(expr: str) -> str:
    """h(s) = first 8 hex digits of md5(s) as an integer."""
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def in_test(key_sql: str, seed: int, pct: int) -> str:
    return f"({keyed_hash(f'CAST({key_sql} AS VARCHAR) || {q(":" + str(seed))}')} % 100) < {pct}"


def split_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(WHITESPACE_RE)}), lambda t: t <> '')"


def strip_punct_digits(expr: str) -> str:
    return (f"regexp_replace(regexp_replace(lower({expr}), {q(ASCII_PUNCT_RE)}, '', 'g'), "
            f"{q(DIGITS_RE)}, '', 'g')")


def split_fused(tokens: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {str_list(v.split(' '))}" for k, v in FUSED_FORMS.items())
    return f"flatten(list_transform({tokens}, lambda t: CASE t {cases} ELSE [t] END))"


def remove_stop(tokens: str, extra: bool = False) -> str:
    lst = STOP_EXTRA if extra else STOP
    return f"list_filter({tokens}, lambda t: NOT list_contains({lst}, t))"


def normalize_tokens_a(expr: str) -> str:
    return remove_stop(split_fused(split_ws(strip_punct_digits(expr))))


def clean_tokens_b(expr: str, extra: bool = False) -> str:
    s = (f"regexp_replace(regexp_replace(lower({expr}), {q(SPACE_BY_SYMBOLS_RE)}, ' ', 'g'), "
         f"{q(BAD_SYMBOLS_RE)}, '', 'g')")
    toks = f"list_filter(string_split_regex({s}, ' +'), lambda t: t <> '')"
    return remove_stop(toks, extra)


def count_bucket(expr: str) -> str:
    return (f"CASE WHEN {expr} = 0 THEN 0 WHEN {expr} = 1 THEN 1 "
            f"WHEN {expr} >= 2 AND {expr} < 5 THEN 2 WHEN {expr} >= 5 THEN 5 END")


def ngrams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    return (f"CASE WHEN len({tokens}) < {n} THEN []::VARCHAR[] ELSE "
            f"list_transform(range(0, len({tokens}) - {n} + 1), "
            f"lambda i: array_to_string({tokens}[i + 1 : i + {n}], ' ')) END")
