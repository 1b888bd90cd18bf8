"""Operator 11: bit packing against big integers, ids against the library, random access, odd rows."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import SF0001
from edge import TEXTS, documents
from lexiflow.llm import token_files, vocab, word_ids

PATH = vocab.default_path("word_bpe_49k.json")


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain(rows):
    """(number, start, n, crc) of rows in order, by the library."""
    at = 0
    for (number, _), ids in zip(rows, library([t for _, t in rows])):
        ids = [*ids, 2]
        yield number, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing_is_one_long_number(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 31, 32, 33, 4097):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack_bits(ids, bits)
        assert int.from_bytes(packed, "little") == sum(int(v) << (i * bits) for i, v in enumerate(ids))
        assert (token_files.unpack_bits(packed, bits, n) == ids).all() and len(packed) == 4 * -(-n * bits // 32)


def test_width_and_too_wide_ids():
    assert [token_files.width_of(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        token_files.write_segment(np.array([8], np.uint32), np.array([1]), [0], 3, 0, 0)


def test_segment_random_access():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49408, 30_000).astype(np.uint32)
    ends = np.array([0, 5, 5, 9000, 29_999, 30_000])
    s = token_files.Segment(token_files.write_segment(ids, ends, [None, 4, 4, 5, 0, -7], 17, 3, 9))
    assert (s.ids() == ids).all() and (s.task, s.place, s.numbers) == (3, 9, [None, 4, 4, 5, 0, -7])
    for a, b in ((0, 1), (4095, 4097), (8192, 12288), (29_999, 40_000), (7, 7)):
        assert (s.ids(a, b) == ids[a:b]).all()
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        assert (s.document(i) == ids[a:b]).all()


def test_ids_are_the_librarys():
    rng = random.Random(5)
    signs = "'’stmdrevl xé1٣Ⅷ.  -_ΣАa\n\x1f́ǅ中\x01<|>"
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    odd += ["a\x01b c", "x<|startoftext|>y <|endoftext|>", "''s 's's 're' 'r 'l", "it'll've 'dx a'sb", "İI ΑΣ."]
    model = word_ids.WordIds(PATH)
    model.pool.limit = 500                       # cleared again and again
    for i in range(0, len(odd), 256):
        ids, n = model.batch([t.encode() for t in odd[i:i + 256]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library(odd[i:i + 256])


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    got = token_files.op11_fixed_width_ids(spark, SF0001).collect()
    assert sorted(map(tuple, got)) == list(plain(sorted((r.doc_id, r.text) for r in docs)))


@pytest.mark.parametrize("segment_ids", [1, 1000, 1 << 22])
def test_odd_rows(spark, tmp_dir, segment_ids):
    docs = documents(spark).repartition(3)
    token_files.write_tokens(docs, tmp_dir, segment_ids=segment_ids)
    got = token_files.read_documents(spark, tmp_dir, with_ids=True).collect()
    assert len(got) == len(TEXTS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):                  # gapless, numbers ascending, nulls first
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    numbers = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert numbers == sorted(numbers, key=lambda n: (n is not None, n or 0))
    want = [(n, np.array([*ids, 2], "<u4").tobytes()) for (n, _), ids in zip(TEXTS, library([t for _, t in TEXTS]))]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)


def test_a_hot_number_and_an_empty_table(spark, tmp_dir):
    rows = [(7, "same text")] * 300 + [(i, f"text {i}") for i in range(100)]
    token_files.write_tokens(documents(spark, rows), f"{tmp_dir}/a", segment_ids=100)
    got = sorted(map(tuple, token_files.read_documents(spark, f"{tmp_dir}/a").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(n for n, _ in rows) and sum(r[2] for r in got) == got[-1][1] + got[-1][2]
    token_files.write_tokens(documents(spark, []), f"{tmp_dir}/b")
    assert token_files.read_documents(spark, f"{tmp_dir}/b").collect() == []
