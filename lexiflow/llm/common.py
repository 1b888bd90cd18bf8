"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import json
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space of the word definition [^\x20\x09-\x0D]+ ; bytes.split() cuts at exactly these
WORD_SEP = r"[\x20\x09-\x0D]+"
# the UTF-8 bytes of the white space beyond ASCII
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words of a UTF-8 text; none for a null text."""
    return text.lower().split() if text else []


def utf8(text_col: str) -> Column:
    """The text as UTF-8 bytes, empty for null: Python then splits without decoding."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _M1
        h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


_K = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words; of the whole
    sequence when it is shorter; empty without words."""
    n = len(h)
    if n == 0:
        return h
    width = min(size, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            acc = acc * _K + h[j:n - width + 1 + j]
    return mix64(acc)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant_array(values, kind: str) -> Column:
    """A bounded list as one constant of the plan (folded before execution)."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


class Recent:
    """Values of the words met lately, learnt in batches by ``learn(set) -> dict``.
    Two generations of at most ``limit`` words each (and one batch): when the
    younger is full the older is dropped, so frequent words stay and memory is
    bounded.  Words longer than ``longest`` are not kept beyond their batch."""

    def __init__(self, learn, limit: int = 200_000, longest: int = 64):
        self.learn, self.limit, self.longest = learn, limit, longest
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list = []

    def values(self, met: set) -> dict:
        """A dictionary with the values of all of ``met``, good until the next call."""
        for w in self.passing:
            del self.young[w]
        if len(self.young) + len(met) > self.limit:
            self.old, self.young = self.young, {}
        new = met.difference(self.young)
        again = {w: self.old[w] for w in new if w in self.old}
        self.young.update(again)
        self.young.update(self.learn(new.difference(again)))
        self.passing = [w for w in new if len(w) > self.longest]
        return self.young


def small_batches(df: DataFrame) -> None:
    """Texts are long: unless the session has its own limits, Arrow batches hold at
    most 1,000 rows and 8 MB, in the executors' native memory and in the workers'."""
    conf = df.sparkSession.conf
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
                                ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        if conf.get(key, default) == default:
            conf.set(key, value)


def in_parts(batches, size: int = 256):
    """Slices of record batches, so that long texts don't pile up in memory."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), size):
            yield b.slice(at, size)
