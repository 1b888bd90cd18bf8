"""Operators 1, 2, 3, 9, 10: brute force, the public libraries, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from conftest import SF0001
from edge import TEXTS, documents, labels
from lexiflow.llm import bpe_trie, lm_score, packing, quality, token_counts, vocab

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").encode().lower().split()


def sample(spark, n=200):
    return spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").limit(n)


# 1 ---------------------------------------------------------------------------------------------

def test_token_counts_match_the_library(spark):
    path = vocab.default_path("piece_bpe_32k.model")
    pieces = token_counts.read_pieces(path)
    lib = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{i:02X}>", -1e9) for i in range(256)]
                                   + [(k, v / token_counts.MICRO) for k, v in pieces.items()], 0, True))
    docs = documents(spark).select("doc_id", "text").union(sample(spark, 40))
    assert token_counts.token_counts(documents(spark)).count() == len(TEXTS)
    assert token_counts.token_counts(documents(spark, [])).collect() == []
    for r, t in zip(token_counts.token_counts(docs).collect(), docs.collect()):
        words = lower(t.text) and (t.text or "").encode().split()
        assert r.doc_id == t.doc_id and r.n_words == len(words)
        trie = token_counts.UnigramTrie(pieces)
        for w in set(words[:200]):
            tokens, score = trie.learn({w})[w]
            found = lib.encode(token_counts.MARK + w.decode()).tokens
            other = sum(pieces.get(x, 0) for x in found)
            assert tokens == len(found) or abs(other - score) <= 5
        if len(words) <= 200:
            assert r.n_tokens == sum(trie.learn({w})[w][0] for w in words)


def test_unigram_trie_is_the_best_cut():
    pieces = {"▁": -9, "a": -5, "b": -5, "ab": -6, "ba": -6, "▁a": -7, "aba": -13, "bb": -10}
    trie = token_counts.UnigramTrie(pieces)

    def brute(w):
        best = {0: (0, 0)}
        for stop in range(1, len(w) + 1):
            best[stop] = max((best[s][0] + pieces[w[s:stop]], best[s][1] - 1)
                             for s in range(stop) if w[s:stop] in pieces)
        return -best[len(w)][1], best[len(w)][0]

    words = {"".join("ab"[(i >> k) & 1] for k in range(n)).encode() for n in range(1, 8) for i in range(1 << n)}
    assert trie.learn(words) == {w: brute("▁" + w.decode()) for w in words}


def test_recent_keeps_frequent_and_stays_bounded():
    from lexiflow.llm.common import Recent
    r = Recent(lambda ws: {w: len(w) for w in ws}, limit=10, longest=5)
    for i in range(50):
        met = {"a", f"w{i}", "longer than five"}
        got = r.values(met)
        assert all(got[w] == len(w) for w in met)
        assert len(r.young) <= 14 and len(r.old) <= 14


# 2 ---------------------------------------------------------------------------------------------

def test_lm_base_and_counts(spark):
    docs = sample(spark)
    texts = {r.doc_id: lower(r.text) + [b""] for r in docs.collect()}
    train = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    rows = lm_score.lm_scores(docs, word_share=1e-3, gram_share=1e-3).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_walk_equals_a_plain_walk_and_sums_to_one(spark):
    from lexiflow.session import Scratch
    docs = sample(spark)
    texts = docs.selectExpr("cast(text as binary) as text")
    m, _, f = lm_score.fit(texts, Scratch(spark), order=3, word_share=2e-3, gram_share=2e-3, discount=0.75)
    assert len(m.codes) == 3 and len(m.codes[2])
    stored = [{int(c): i for i, c in enumerate(codes)} for codes in m.codes]

    def prob(context, s):       # context: stored places by length, longest first
        out = m.logp[0][s]
        for k in (2, 3):
            if len(context) >= k - 1 and context[k - 2] is not None:
                st = context[k - 2]
                at = stored[k - 1].get(st * m.n_symbols + s)
                out = m.logp[k - 1][at] if at is not None else m.backoff[k - 2][st] + out
        return out

    for r in docs.limit(20).collect():
        seq = m.symbols(lower(r.text))
        steps, last, pair = m.steps(seq), lm_score.END, None
        for i, s in enumerate(seq):
            assert steps[i] == pytest.approx(prob([last, pair], int(s)))
            pair = stored[1].get(last * m.n_symbols + int(s))
            last = int(s)
    for pair in list(range(0, len(m.codes[1]), max(1, len(m.codes[1]) // 20))):
        last = int(m.codes[1][pair] % m.n_symbols)
        if last != lm_score.END:
            assert sum(10 ** prob([last, pair], s) for s in range(m.n_symbols)) == pytest.approx(1, abs=1e-6)
    for last in range(min(30, m.n_symbols)):
        assert sum(10 ** prob([last, None], s) for s in range(m.n_symbols)) == pytest.approx(1, abs=1e-6)


def test_lm_odd_rows(spark):
    rows = lm_score.lm_scores(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.score <= 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.n_tokens for r in empty} == {1}
    assert lm_score.lm_scores(documents(spark, [])).collect() == []
    only_held = [(i, "a b c") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {(r.n_known, r.base_score) for r in lm_score.lm_scores(documents(spark, only_held)).collect()} == {(0, 0.0)}


@pytest.mark.parametrize("settings", [{}, {"piece": 300, "keep": 40}, {"order": 2, "piece": 300}, {"order": 1},
                                      {"word_share": 1e-3, "gram_share": 5e-4}])
def test_lm_scores_equal_the_whole_automaton(spark, settings, monkeypatch):
    from lexiflow.session import Scratch
    monkeypatch.setattr(lm_score, "BUCKET", 5_000)
    monkeypatch.setattr(lm_score, "SLICE", 200 if "piece" in settings else 1 << 22)
    docs = sample(spark).union(documents(spark).select("doc_id", "text"))
    rows = docs.withColumn("t", docs.text.cast("binary")).collect()
    learnt = [(bytearray(r.t or b""),) for r in rows if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 != 2]
    shares = {k: settings.get(k, 0.0) for k in ("word_share", "gram_share")}
    m, counts, f = lm_score.fit(spark.createDataFrame(learnt, "text binary"), Scratch(spark), **shares,
                                order=settings.get("order", 3), discount=0.75)
    c = {bytes(r.word): r.c for r in counts.collect()}

    def score(text):
        words = lower(text)
        tails = [c.get(w, 0) for w in words if w not in m.head]
        inside = sum(math.log10((x - f["d"] if x else f["d"] * f["v"]) / (f["n"] * f["p_tail"])) for x in tails)
        return float(m.steps(m.symbols(words)).sum()) + inside

    expected = sorted((str(r.doc_id), round(score(r.text), 4)) for r in rows)
    found = sorted((str(r.doc_id), round(r.score, 4)) for r in lm_score.lm_scores(docs, **settings).collect())
    for a, b in zip(found, expected, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-6, abs=2e-4)


def test_lm_stores_what_is_seen_twice_in_a_large_corpus(spark):
    """A phrase seen twice is learnt however many other words there are."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(held[0], "rare kept phrase"), (held[1], "phrase rare kept")]
    rows += [(1000 + i, "rare kept phrase") for i in range(40) if zlib.crc32(str(1000 + i).encode()) % 7 != 2][:2]
    rows += [(10_000 + i, "filler " * 60_000) for i in range(30)]
    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 3


# 3 ---------------------------------------------------------------------------------------------

def quality_brute(t):
    w = WORD.findall(t or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), failed)


def test_quality_measures(spark):
    docs = documents(spark).select("doc_id", "text").union(sample(spark))
    lab = spark.read.parquet(f"{SF0001}/labels.parquet")
    rows = quality.quality_rules(docs, lab).select("text", "quality.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == \
            quality_brute(r.text)
        assert r.kept == (not r.base_failed and r.score >= -0.3)


def test_repeats_of_texts_too_long_to_pack(spark):
    from pyspark.sql import functions as F
    docs = sample(spark, 60)
    for bits in (quality.POS_BITS, 4):
        got = docs.select("text", quality.repeated_words(quality.words(F.col("text")), pos_bits=bits).alias("n")).collect()
        assert all(r.n == quality_brute(r.text)[4] for r in got)


def test_quality_score_is_the_mean_ratio(spark):
    ratios = [round(math.sin(i), 6) for i in range(64)]
    from pyspark.sql import functions as F
    docs = sample(spark, 50)
    rows = docs.select("text", quality.ngram_buckets(quality.words(F.col("text")), 64).alias("b"),
                       quality.quality_columns(F.col("text"), ratios, 0.0).alias("q")).collect()
    for r in rows:
        want = sum(ratios[b] for b in r.b) / len(r.b) if r.b else 0.0
        assert r.q.score == pytest.approx(want) and len(r.b) == 2 * len(WORD.findall(r.text))


def test_quality_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_rules(docs, lab).select("doc_id", "quality.*").join(
        lab.selectExpr("doc_id", "quality as y"), "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in judged if r.y == 1) >= 0.99 * sum(r.y == 1 for r in judged)
    assert sum(r.kept for r in judged if r.y == 0) <= 0.05 * sum(r.y == 0 for r in judged)


def test_quality_odd_rows(spark):
    assert quality.quality_rules(documents(spark, []), labels(spark)).count() == 0
    for lab in (labels(spark), labels(spark).limit(0)):
        assert quality.quality_rules(documents(spark), lab).count() == len(TEXTS)
    kept = quality.keep_good(documents(spark), labels(spark))
    assert kept.columns == documents(spark).columns


# 9 ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(vocab.default_path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, word_bpe):
    docs = documents(spark).select("doc_id", "text").union(sample(spark))
    got = bpe_trie.bpe_encode(docs).collect()
    assert len(got) == docs.count()
    for r, t in zip(got, docs.collect()):
        ids = word_bpe.encode(t.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        text = word_bpe.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) == (t.doc_id, len(ids), raw, text)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_strings(word_bpe):
    import random
    rng = random.Random(3)
    odd = ["it's we'LL ''s 's'ssss I'M", "é ̈ a\x1cb\x85c\xa0d", "<|ENDOFTEXT|> <|startoftext|>x", "１２３ ½ ④ ǅ İ ΑΣ Σ"]
    odd += ["".join(rng.choice("aehtoinsrdl 'é中1.,!<|>\n\t́AΣ") for _ in range(40)) for _ in range(500)]
    odd += ["".join(rng.choice("eatonisrh") for _ in range(rng.randint(1, 18))) for _ in range(1000)]
    model = bpe_trie.trie_bpe(vocab.default_path("word_bpe_49k.json"))
    for t, (ids, text) in zip(odd, model.encode_batch([t.encode() for t in odd])):
        want = word_bpe.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert text.decode() == word_bpe.decode(want, skip_special_tokens=False)


def test_bpe_empty_table(spark):
    assert bpe_trie.bpe_encode(documents(spark, [])).collect() == []


# 10 --------------------------------------------------------------------------------------------

def check_packed(rows, window=1024):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq, by_doc


def test_packing_covers_every_id(spark):
    lib = Tokenizer.from_file(vocab.default_path("byte_bpe_50k.json"))
    docs = sample(spark).union(documents(spark, [x for x in TEXTS if x[0] is not None and x[0] != 5])
                               .selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = packing.pack(docs, with_ids=True).collect()
    by_seq, by_doc = check_packed(rows)
    for t in docs.collect():
        ids = np.array(lib.encode(t.text or "", add_special_tokens=False).ids + [0], "<u4")
        end = 0
        for r in sorted(by_doc[t.doc_id], key=lambda r: r.start):
            part = ids[r.start:r.start + r.length].tobytes()
            assert r.start == end and r.doc_tokens == len(ids)
            assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part)
            end += r.length
        assert end == len(ids)
    lost = sum(packing._padding(sum(r.length for r in s), 1024) for s in by_seq.values())
    assert lost <= 0.05 * sum(r.length for r in rows)


def test_window_filling_is_the_best_subset():
    import itertools
    import random
    rng = random.Random(5)
    for _ in range(60):
        window = 32
        counts = Counter(rng.randint(1, 31) for _ in range(rng.randint(1, 9)))
        got = packing.fill_window(dict(counts), window)
        assert all(k <= counts[n] for n, k in got.items()) and max(counts) in got
        items = list(counts.elements())
        items.remove(max(counts))
        sums = {max(counts) + sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r)}
        best = min(packing._padding(s, window) for s in sums if s <= window)
        assert packing._padding(sum(n * k for n, k in got.items()), window) == best


def test_plan_takes_every_piece_once():
    histogram = {n: (n * 7919) % 50 + 1 for n in range(1, 1025)} | {3: 10 ** 9}
    plan = packing.plan_windows(histogram, 1024)
    used = Counter()
    for chosen, times in plan:
        assert sum(n * k for n, k in chosen.items()) <= 1024
        for n, k in chosen.items():
            used[n] += k * times
    assert used == Counter(histogram) and len(plan) < 20_000


def test_packing_odd_rows(spark):
    rows = packing.pack(documents(spark)).collect()
    check_packed(rows)
    assert sum(r.start == 0 for r in rows) == len(TEXTS)
    assert packing.pack(documents(spark, [])).collect() == []


def test_batches_of_ids_are_the_librarys():
    path = vocab.default_path("byte_bpe_50k.json")
    rng = random.Random(3)
    signs = [*"ab c   \r\n\tdé中x.1'<>|", "<|endoftext|>", " ", "\xa0", " ", "\x85"]
    texts = ["<|endoftext|>", "\n<|endoftext|>\n\nx <|endoftext|>", "  ", "\n", "a\n", " \n a", "x" * 3000]
    texts += ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(4000)]
    model = packing.ByteBpe(path)
    model.pool.limit = 500                       # cleared again and again
    lib = Tokenizer.from_file(path)
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        ids, n = model.batch([t.encode() for t in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [
            e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
