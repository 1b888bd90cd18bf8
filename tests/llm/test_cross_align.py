"""Operator 12: cuts, links and counts against the libraries' whole-text ids and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF0001
from edge import TEXTS, documents
from lexiflow.llm import cross_align, vocab

PATHS = vocab.default_path("byte_bpe_50k.json"), vocab.default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups, links) by the libraries and plain loops."""
    lib_a, lib_b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    lib_a.encode_special_tokens = True
    back = {c: b for b, c in vocab.byte_symbols().items()}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in lib_a.get_vocab().items() if i < 50256}
    bytes_b = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in enumerate(lib_b.id_to_piece(list(range(lib_b.get_piece_size()))))]

    def of(text):
        if not text:
            return [], [], [], Counter()
        a, b = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
        if {b"".join(bytes_a[i] for i in a), b"".join(bytes_b[i] for i in b)} != {(" " + text).encode()}:
            return [], [], [], Counter()
        ends_a = np.cumsum([len(bytes_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(bytes_b[i]) for i in b]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, n = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((a[i:k], b[j:n]))
            i, j = k, n
        links, first = Counter(), 0
        for i, (start, end) in enumerate(zip([0, *ends_a], ends_a)):
            while ends_b[first] <= start:
                first += 1
            j = first
            while j < len(b) and (ends_b[j - 1] if j else 0) < end:
                links[a[i], b[j]] += 1
                j += 1
        return a, b, groups, links

    return of


def digest(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def expected(plain, rows):
    found = [(i, *plain(t)) for i, t in rows]
    count = Counter(p for f in found for p in f[4])
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for i, a, b, groups, links in found:
        yield (i, len(a), len(b), len(groups), sum(links.values()),
               sum(n for p, n in links.items() if count[p] == most[p[0]]),
               sum(n * count[p] for p, n in links.items()), digest(groups))


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_align_finds_every_cut():
    rng = np.random.default_rng(4)
    for _ in range(300):
        bounds, ends_a, ends_b, at = [], [], [], 0
        for _ in range(rng.integers(1, 4)):
            n = int(rng.integers(1, 60))
            sides = [np.append(np.flatnonzero(rng.random(n - 1) < rng.choice([0.05, 0.5, 0.95])) + 1, n) for _ in "ab"]
            bounds.append((len(ends_a), len(ends_a) + len(sides[0]), len(ends_b), len(ends_b) + len(sides[1])))
            ends_a += (sides[0] + at).tolist()
            ends_b += (sides[1] + at).tolist()
            at += n
        a, b = np.array(ends_a), np.array(ends_b)
        got = cross_align.align(a, b, np.array(bounds))
        cuts = sorted(set(ends_a) & set(ends_b))
        assert a[got[:, 1] - 1].tolist() == b[got[:, 3] - 1].tolist() == cuts
        assert (got[1:, ::2] == got[:-1, 1::2]).all() and got[0].tolist()[::2] == [0, 0]
    assert len(cross_align.align(a, b, np.empty((0, 4)))) == 0
    long = np.arange(1, 40_001)                       # one group without an inner cut
    one = cross_align.align(3 * long, np.append(3 * long[:-1] - 1, 120_000), np.array([[0, 40_000, 0, 40_000]]))
    assert one.tolist() == [[0, 40_000, 0, 40_000]]


def test_odd_texts(plain):
    rng = random.Random(2)
    signs = "ab;) c  \r\n\tdé中x.1'▁<s>😀\xa0\u2003\x85"
    texts = [t for _, t in TEXTS] + ["<s>a</s> <|endoftext|>", "▁", "a▁b", "a\x00b", "xyz" * 3000, " " * 900 + "\n" * 90]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    model = cross_align.Pair(*PATHS)
    model.pool.limit = 300                            # cleared again and again
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        for text, got in zip(part, model.batch([(t or "").encode() for t in part], True), strict=True):
            a, b, groups, links = plain(text)
            assert got[:5] == (len(a), len(b), len(groups), sum(links.values()), digest(groups))
            assert got[7].tolist() == a and got[8].tolist() == b
            assert got[9].tolist() == np.cumsum([len(g[0]) for g in groups]).tolist()
            pairs = dict(zip(np.frombuffer(got[5], "<i8").tolist(), np.frombuffer(got[6], "<u4").tolist()))
            assert pairs == {x * model.size_b + y: n for (x, y), n in links.items()}


def test_query_equals_the_plain_loops(spark, plain):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    got = cross_align.op12_divide_at_cuts(spark, SF0001).collect()
    assert ordered(got) == ordered(expected(plain, [(r.doc_id, r.text) for r in docs]))


@pytest.mark.parametrize("hot_pairs", [0, 40, 1 << 20])
def test_odd_rows_whatever_is_broadcast(spark, plain, hot_pairs):
    got = cross_align.cross_align(documents(spark), hot_pairs=hot_pairs).collect()
    assert ordered(got) == ordered(expected(plain, TEXTS))
    assert cross_align.cross_align(documents(spark, []), hot_pairs=hot_pairs).collect() == []
