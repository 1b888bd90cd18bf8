"""Text expressions on hand-written fixtures."""

from pyspark.sql import functions as F

from lexiflow.functions import text as X


def _one(spark, text, col):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(col.alias("x")).first()["x"]


def test_normalize_a_strips_punct_digits_stopwords(spark):
    out = _one(spark, "The 3 cats, and 42 DOGS!\nRan-fast.", X.normalize_tokens_a("text"))
    assert out == ["cats", "dogs", "ranfast"]


def test_normalize_a_digits_only_and_stop_only(spark):
    assert _one(spark, "123 456", X.normalize_tokens_a("text")) == []
    assert _one(spark, "the and of it", X.normalize_tokens_a("text")) == []


def test_normalize_a_accents_and_unicode_blanks(spark):
    out = _one(spark, "Élan Café naïve", X.normalize_tokens_a("text"))
    assert out == ["élan", "café", "naïve"]


def test_fused_forms_split(spark):
    out = _one(spark, "I gonna wanna go", X.normalize_tokens_a("text"))
    assert out == ["gon", "na", "wan", "na", "go"]


def test_clean_symbols_fuses_across_newlines(spark):
    # newlines are deleted (not spaced), so words across them fuse
    out = _one(spark, "Good/bad food\nhere; #1 c++", X.clean_text_b("text"))
    assert out == "good bad foodhere #1 c++"


def test_extra_stop_words(spark):
    out = _one(spark, "we also got pizza", X.clean_text_b("text", extra=True))
    assert out == "pizza"


def test_ngrams(spark):
    t = F.array(*[F.lit(w) for w in ["a", "b", "c"]])
    assert _one(spark, "", X.ngrams(t, 2)) == ["a b", "b c"]
    assert _one(spark, "", X.ngrams(t, 3)) == ["a b c"]
    assert _one(spark, "", X.ngrams(t, 4)) == []


def test_word_tokens(spark):
    assert _one(spark, "A bc d_e 12 x", X.word_tokens("text")) == ["bc", "d_e", "12"]
