"""Contextual sentiment, best tag paths and sub-word pieces against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from lexiflow.operators.sentiment import contextual_sentiment
from lexiflow.operators.subwords import encode_pieces
from lexiflow.operators.tagging import best_paths, decode_tags

VALENCE = {"good": 1.9, "great": 3.1, "bad": -2.5, "love": 3.2, "least": 0.5, "awful": -2.0}
BOOST = {"very": 0.293, "really": 0.293, "hardly": -0.293, "so": 0.293}
NEGATE = {"not", "never", "without", "cannot"}


def plain_scores(text):
    words = [w if len(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) <= 2 else w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
             for w in re.split(r"\s+", text or "") if w]
    low = [w.lower() for w in words]
    caps = [w.isupper() for w in words]
    differ = 0 < sum(caps) < len(words)
    out = []
    for i, t in enumerate(low):
        if t in BOOST or t not in VALENCE:
            out.append(0.0)
            continue
        v = VALENCE[t]
        if caps[i] and differ:
            v += 0.733 if v > 0 else -0.733
        for k in (1, 2, 3):
            if i < k or low[i - k] in VALENCE:
                continue
            p = low[i - k]
            if p in BOOST:
                s = -BOOST[p] if v < 0 else BOOST[p]
                if caps[i - k] and differ:
                    s += 0.733 if v > 0 else -0.733
                v += s * (1, 0.95, 0.9)[k - 1]
            between = low[i - k + 1:i]
            if k > 1 and p == "never" and any(x in ("so", "this") for x in between):
                v *= 1.25
            elif k > 1 and p == "without" and "doubt" in between:
                pass
            elif p in NEGATE or "n't" in p:
                v *= -0.74
        if i and low[i - 1] == "least" and "least" not in VALENCE and (i == 1 or low[i - 2] not in ("at", "very")):
            v *= -0.74
        out.append(v)
    if "but" in low:
        b = low.index("but")
        out = [s * (0.5 if i < b else 1.5 if i > b else 1) for i, s in enumerate(out)]
    asks = (text or "").count("?")
    marks = min((text or "").count("!"), 4) * 0.292 + (0 if asks <= 1 else asks * 0.18 if asks <= 3 else 0.96)
    total = sum(out)
    total += marks if total > 0 else -marks if total < 0 else 0
    up, down = sum(s + 1 for s in out if s > 0), sum(1 - s for s in out if s < 0)
    up, down = up + marks * (up > down), down + marks * (down > up)
    whole = up + down + sum(s == 0 for s in out)
    return [x / whole if whole else 0.0 for x in (up, down, sum(s == 0 for s in out))] + [total / math.sqrt(total ** 2 + 15)]


@pytest.mark.parametrize("bound", [0, 1000])
def test_sentiment_rules(spark, bound, monkeypatch):
    monkeypatch.delitem(VALENCE, "least") if bound else None
    rng = random.Random(3)
    pool = [*VALENCE, *BOOST, *NEGATE, "but", "this", "doubt", "at", "least", "food", "GREAT", "VERY", "isn't", "Bad!!", "ok?",
            "(love)", ":)", "NOT"]
    texts = [None, "", "  \n", "GOOD", "good but awful!!!!!!", "never so good", "without a doubt great??"]
    texts += [" ".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i % 300, t) for i, t in enumerate(texts)], "id int, text string")
    make = spark.createDataFrame
    got = contextual_sentiment(
        df, "id", "text", make(list(VALENCE.items()), "token string, valence double"),
        make(list(BOOST.items()), "token string, scalar double"), make([(n,) for n in NEGATE], "token string"), bound)
    got = sorted([r.id, r.pos, r.neg, r.neu, r.compound] for r in got.collect())
    want = sorted([i % 300, *plain_scores(t)] for i, t in enumerate(texts))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


def test_best_paths_are_the_best(spark):
    rng = np.random.default_rng(2)
    for _ in range(40):
        tags, n = int(rng.integers(1, 4)), int(rng.integers(1, 6))
        scores, start, move = (rng.integers(-3, 1, s).astype(float) for s in ((n, tags), (tags,), (tags, tags)))

        def score(path):
            return start[path[0]] + sum(scores[i, t] for i, t in enumerate(path)) + sum(
                move[a, b] for a, b in zip(path, path[1:]))
        want = max(itertools.product(range(tags), repeat=n), key=lambda p: (score(p), [-t for t in reversed(p)]))
        assert tuple(best_paths(scores, np.array([n]), start, move)) == want


@pytest.mark.parametrize("bound", [0, 1000])
def test_decode_tags(spark, bound):
    rows = [(1, ["the", "dog", "runs"]), (1, ["dog"]), (2, []), (3, None), (None, ["x", None, "runs", "the"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    emission = spark.createDataFrame([("the", "D", -0.1), ("dog", "N", -0.5), ("dog", "V", -0.4), ("runs", "V", -0.7),
                                      ("runs", "N", -0.6), ("runs", "N", -9.0)], "token string, tag string, score double")
    move = spark.createDataFrame([(None, "D", -0.2), ("D", "N", -0.1), ("N", "V", -0.2), ("V", "D", -0.5), ("V", "N", -2.0)],
                                 "prev string, tag string, score double")
    got = {(r.id, tuple(r.tokens)): r.tags for r in decode_tags(df, "id", "tokens", emission, move, -20.0, bound).collect()}
    assert got[1, ("the", "dog", "runs")] == ["D", "N", "V"] and got[2, ()] == [] == got[3, ()]
    assert got[1, ("dog",)] == ["D"] and len(got) == 5 and len(got[None, ("x", "runs", "the")]) == 3


def test_pieces(spark):
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "aff", "a", "##a", "ü", "##ü", "##ables"]
    table = spark.createDataFrame([(p, i) for i, p in enumerate(vocab)], "piece string, id int")

    def plain(word):
        out, at = [], 0
        while at < len(word):
            fits = [s for s in range(len(word), at, -1) if ("##" if at else "") + word[at:s] in vocab]
            if not fits:
                return [1]
            out.append(vocab.index(("##" if at else "") + word[at:fits[0]]))
            at = fits[0]
        return out if len(word) <= 20 else [1]
    rng = random.Random(8)
    rows = [["unaffable", "unaffables"], [], None, ["", None, "üa"], ["a" * 20, "a" * 21], ["zz", "unzz"]]
    rows += [["".join(rng.choice(["un", "aff", "able", "a", "ü", "s"]) for _ in range(rng.randint(1, 4))) for _ in range(7)]
             for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, tokens array<string>")
    got = {r.id: r for r in encode_pieces(df, "id", "tokens", table, 10, max_word=20).collect()}
    for i, words in enumerate(rows):
        pieces = [p for w in words or [] if w for p in plain(w)]
        ids = [2, *pieces[:8], 3]
        assert got[i].input_ids == ids + [0] * (10 - len(ids)) and got[i].n_pieces == len(pieces)
        assert got[i].attention_mask == [1] * len(ids) + [0] * (10 - len(ids))
    with pytest.raises(ValueError):
        encode_pieces(df, "id", "tokens", table, 10, max_bytes=5)


def test_pieces_of_a_large_batch_come_in_slices():
    """A worker holds a slice of a batch at a time, whatever the batch."""
    import pyarrow as pa
    from lexiflow.operators import subwords
    texts = [["ab", None, ""] * (i % 5) for i in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(texts, pa.list_(pa.string()))], names=["id", "tokens"])
    words = {"ids": {"a": 5, "##b": 6}, "longest": 3, "mark": "##", "unknown": 1, "max_word": 9}
    out = list(subwords.encode_batches([batch], words, 6, [2], [3], 0, "id"))
    assert [b.num_rows for b in out] == [512, 512, 276]
    got = [r for b in out for r in b.to_pylist()]
    for i, r in enumerate(got):
        ids = [2, *([5, 6] * (i % 5))[:4], 3]
        assert r["id"] == i and r["n_pieces"] == 2 * (i % 5) and r["input_ids"] == ids + [0] * (6 - len(ids))
        assert r["attention_mask"] == [1] * len(ids) + [0] * (6 - len(ids))
