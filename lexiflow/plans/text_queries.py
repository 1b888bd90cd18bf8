"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import keyed_hash
from ..operators import lexicon as L
from ..operators.clean import canonicalize, count_bucket, dedupe, fill_nulls, drop_nulls, strip
from ..operators.encode import build_vocabulary, encode
from ..operators.features import tfidf_long as tfidf
from ..sources.readers import read_table


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _conv(spark, sf):
    c = read_table(spark, sf, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(key.alias("key"), "conv_id", "turn", "role", "text")


def clean_text_basic(spark, sf):
    """X1+X2+X4+X5: lower, strip punctuation and digits, tokenise, drop stop words."""
    d = read_table(spark, sf, "documents")
    toks = X.normalize_tokens_a("text")
    return d.select("doc_id", F.array_join(toks, " ").alias("clean_text"),
                    F.size(toks).cast("bigint").alias("n_tokens"))


def clean_text_symbols(spark, sf):
    """Symbols to blank, drop everything outside [0-9a-z #+_], stop words."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", X.clean_text_b("text").alias("clean_text"))


def normalize_tokens(spark, sf):
    """X3 + X6: cleaned tokens minus the extra stop-word list, per turn."""
    c = _conv(spark, sf)
    toks = X.clean_tokens_b("text", extra=True)
    return c.select("key", F.array_join(toks, " ").alias("tokens"),
                    F.size(toks).cast("bigint").alias("n_tokens"))


def dedupe_clean(spark, sf):
    """P8 after cleaning: distinct (lang, cleaned text)."""
    d = read_table(spark, sf, "documents").select("lang", X.clean_text_b("text").alias("clean_text"))
    return dedupe(d)


def dropna_fill(spark, sf):
    """P6 + P7: documents with their (optional) labels; missing labels -> 0,
    rows without a language dropped."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = drop_nulls(d.join(lab, "doc_id", "left"), ["lang"])
    j = j.withColumn("labelled", F.col("quality").isNotNull())
    return fill_nulls(j, {"quality": 0, "toxic": 0}).select(
        "doc_id", "lang", F.col("quality").cast("bigint").alias("quality"),
        F.col("toxic").cast("bigint").alias("toxic"), "labelled")


# Priority aliases for the category clean-up query.
PRIORITY_ALIASES = {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM",
                    "4-NOT SPECIFIED": "UNSPECIFIED", "5-LOW": "LOW"}


def canonical_category(spark, sf):
    """P9 + P10: strip, exact alias replacement, null -> default."""
    o = read_table(spark, sf, "orders")
    pr = canonicalize(strip("o_orderpriority"), PRIORITY_ALIASES, null_value="UNSPECIFIED")
    st = canonicalize(strip("o_orderstatus"), {}, null_value="U")
    return o.select("o_orderkey", pr.alias("priority"), st.alias("status"))


def ngrams(spark, sf):
    """Word bigram counts over every turn."""
    c = _conv(spark, sf)
    g = c.select(F.explode_outer(X.ngrams(X.normalize_tokens_a("text"), 2)).alias("ngram")).where(
        F.col("ngram").isNotNull())
    return g.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(spark, sf):
    """A2: vocabulary with document frequency and total count."""
    d = read_table(spark, sf, "documents").select(X.normalize_tokens_a("text").alias("t"))
    return vocabulary_table(d, "t")


def vocabulary_table(d, tokens_col):
    """(token, df, cnt) in ONE aggregation on token.  Each row explodes its
    tokens followed by its distinct tokens; a position below the token count
    is an occurrence (adds to cnt), one above is a document hit (adds to df).
    Nothing keyed by (doc, token) is shuffled, and map-side partial
    aggregation folds a hot token to one row per task."""
    t = F.col(tokens_col)
    e = d.select(F.size(t).alias("_n"),
                 F.posexplode(F.concat(t, F.array_distinct(t))).alias("_pos", "token"))
    return e.groupBy("token").agg(
        F.count(F.when(F.col("_pos") >= F.col("_n"), 1)).alias("df"),
        F.count(F.when(F.col("_pos") < F.col("_n"), 1)).alias("cnt"))


def bucket_counts(spark, sf):
    """P14 + A4: value counts of the bucketed turn number."""
    c = read_table(spark, sf, "conversations")
    return c.groupBy(count_bucket("turn").cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def tfidf_long(spark, sf):
    """F4 in long form over every turn."""
    c = _conv(spark, sf).select("key", X.word_tokens("text").alias("tokens"))
    t = tfidf(c, "key", "tokens")
    return t.select("key", "token", F.col("tf").cast("bigint").alias("tf"), _r("weight").alias("weight"))


# ---------------------------------------------------------------- lexicons
# The lexicons are derived by Spark from the conversations' own vocabulary with
# fixed rules, so their size grows with the data like a real dictionary.

def _conv_tokens(spark, sf):
    return _conv(spark, sf).select("key", "turn", X.normalize_tokens_a("text").alias("tokens"))


def valence_lexicon(tokens_df):
    """(token, valence): integer valence -4..4 for about a fifth of the vocabulary."""
    v = X.explode_tokens(tokens_df, None, "tokens").distinct()
    h = keyed_hash(F.col("token"), "v")
    return v.where(h % 5 == 0).select("token", ((h % 9) - 4).cast("double").alias("valence"))


def tag_lexicon(tokens_df):
    """(token, tag) by suffix rule for two thirds of the vocabulary."""
    v = X.explode_tokens(tokens_df, None, "tokens").distinct()
    tag = (F.when(F.col("token").endswith("ment"), "NN").when(F.col("token").endswith("ly"), "RB")
           .when(F.col("token").endswith("ing"), "VBG").when(F.col("token").endswith("ed"), "VBD")
           .otherwise("JJ"))
    return v.where(keyed_hash(F.col("token"), "t") % 3 != 0).select("token", tag.alias("tag"))


def lemma_lexicon(tokens_df):
    """(form, lemma): plural-looking forms longer than three characters."""
    v = X.explode_tokens(tokens_df, None, "tokens").distinct()
    return v.where((F.length("token") > 3) & F.col("token").endswith("s")).select(
        F.col("token").alias("form"), F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))


def lexicon_sentiment(spark, sf):
    """X9 per turn."""
    t = _conv_tokens(spark, sf)
    s = L.sentiment(t, "key", "tokens", valence_lexicon(t))
    return s.select("key", *[_r(c).alias(c) for c in ("pos", "neg", "neu", "compound")])


def adjust_label(spark, sf):
    """M13 on a 0-based five-level label (turn mod 5) with X9 scores."""
    t = _conv_tokens(spark, sf)
    s = L.sentiment(t, "key", "tokens", valence_lexicon(t))
    j = s.join(t.select("key", (F.col("turn") % 5).alias("s")), "key")
    s1, s2, s3, down, up = L.adjust_label("s", "neg", "compound")
    return j.select("key", F.col("s").cast("bigint").alias("s"), s1.cast("bigint").alias("s1"),
                    s2.cast("bigint").alias("s2"), s3.cast("bigint").alias("s3"),
                    down.cast("bigint").alias("n_down"), up.cast("bigint").alias("n_up"))


def adjust_counts(spark, sf):
    """How many adjustments went down and up in total."""
    a = adjust_label(spark, sf)
    return a.agg(F.sum("n_down").cast("bigint").alias("down"), F.sum("n_up").cast("bigint").alias("up"))


def dictionary_annotate(spark, sf):
    """token_TAG strings with a default tag."""
    t = _conv_tokens(spark, sf)
    a = L.annotate(t, "key", "tokens", tag_lexicon(t), default="NN")
    return a.select("key", F.array_join("tokens", " ").alias("tagged"))


def dictionary_rewrite(spark, sf):
    """Dictionary lemmatisation."""
    t = _conv_tokens(spark, sf)
    a = L.rewrite(t, "key", "tokens", lemma_lexicon(t))
    return a.select("key", F.array_join("tokens", " ").alias("lemmatized"))


def sequence_encode(spark, sf):
    """X11: ids by vocabulary rank, cut to 64, padded; mask; whole-text length."""
    t = _conv_tokens(spark, sf)
    vocab = build_vocabulary(t, "tokens")
    e = encode(t, "key", "tokens", vocab, 64)
    return e.select("key", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"), "n_tokens")


def stop_anti_join(spark, sf):
    """J1 as a join: tokens not in a stop table, counted for every document."""
    from ..functions.constants import ENGLISH_STOP_WORDS
    d = read_table(spark, sf, "documents").select(
        "doc_id", X.split_ws(X.strip_punct_digits("text")).alias("tokens"))
    stop = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "token string")
    return L.count_unlisted(d, "doc_id", "tokens", F.broadcast(stop), "n_kept")
