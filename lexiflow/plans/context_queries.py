"""Registered queries of the operators that look at a token's neighbours or inside it:
sentiment rules, tag paths, sub-word pieces.  The tables are derived by Spark from the
conversations' own vocabulary with fixed rules, as in ``text_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import keyed_hash
from ..operators import sentiment as S
from ..operators.ranking import global_index
from ..operators.subwords import encode_pieces
from ..operators.tagging import decode_tags
from ..sources.readers import read_table
from .sqltext import keyed_hash as hash_sql
from .sqltext import normalize_tokens_a, q
from .text_oracle import CONV_KEY


def _turns(spark, sf):
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return read_table(spark, sf, "conversations").select(key.alias("key"), "text")


# ------------------------------------------------------------------ sentiment rules

def sentiment_rules(spark, sf):
    """X9 with context, per turn."""
    t = _turns(spark, sf)
    token = t.select(F.explode(S.words("text")).alias("w")).select(F.lower("w").alias("token")).distinct()
    v, b, n = (keyed_hash(F.col("token"), x) for x in "vbn")
    out = S.contextual_sentiment(
        t, "key", "text", token.where(v % 5 == 0).select("token", ((v % 9) - 4).cast("double").alias("valence")),
        token.where(b % 20 == 0).select("token", F.when(b % 3 == 0, -0.293).otherwise(0.293).alias("scalar")),
        token.where(n % 25 == 0))
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "neu", "compound")])


def sentiment_rules_sql():
    punct = S.PUNCTUATION
    bare = f"regexp_replace(regexp_replace(x, {q('^' + punct)}, ''), {q(punct + '$')}, '')"
    cap = S.CAPITALS
    lags = ", ".join(f"lag({c}, {k}) OVER o AS {c}{k}" for k in (1, 2, 3) for c in ("t", "v", "b", "n", "caps"))
    steps, negate = [], {
        1: "CASE WHEN n1 THEN z * {n} ELSE z END",
        2: "CASE WHEN t2 = 'never' AND t1 IN ('so', 'this') THEN z * {s} WHEN t2 = 'without' AND t1 = 'doubt' THEN z "
           "WHEN n2 THEN z * {n} ELSE z END",
        3: "CASE WHEN t3 = 'never' AND (t2 IN ('so', 'this') OR t1 IN ('so', 'this')) THEN z * {s} "
           "WHEN t3 = 'without' AND (t2 = 'doubt' OR t1 = 'doubt') THEN z WHEN n3 THEN z * {n} ELSE z END"}
    for k in (1, 2, 3):
        inc = (f"coalesce((CASE WHEN s{k - 1} < 0 THEN -b{k} ELSE b{k} END + CASE WHEN caps{k} AND d THEN "
               f"CASE WHEN s{k - 1} > 0 THEN {cap} ELSE -{cap} END ELSE 0 END) * {S.FADE[k - 1]}, 0)")
        steps.append(f"z{k} AS (SELECT *, s{k - 1} + {inc} AS z FROM {'s0' if k == 1 else f'x{k - 1}'})")
        steps.append(f"x{k} AS (SELECT * EXCLUDE (z), CASE WHEN t{k} IS NULL OR v{k} IS NOT NULL THEN s{k - 1} "
                     f"ELSE {negate[k].format(n=S.NEGATED, s=S.NEVER_SO)} END AS s{k} FROM z{k})")
    h = {x: hash_sql(f"t || ':{x}'") for x in "vbn"}
    return f"""WITH w AS (SELECT {CONV_KEY} AS key, coalesce(text, '') AS text, list_transform(list_filter(
  regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''),
  lambda x: CASE WHEN length({bare}) <= 2 THEN x ELSE {bare} END) AS w FROM conversations),
each AS (SELECT key, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM w),
lex AS (SELECT t, CASE WHEN {h['v']} % 5 = 0 THEN ({h['v']} % 9 - 4)::DOUBLE END AS v,
  CASE WHEN {h['b']} % 20 = 0 THEN CASE WHEN {h['b']} % 3 = 0 THEN -0.293 ELSE 0.293 END::DOUBLE END AS b,
  {h['n']} % 25 = 0 OR contains(t, 'n''t') AS n FROM (SELECT DISTINCT lower(word) AS t FROM each)),
met AS (SELECT key, i, lex.*, upper(word) = word AND lower(word) <> word AS caps FROM each JOIN lex ON t = lower(word)),
told AS (SELECT *, bool_or(caps) OVER (PARTITION BY key) AND NOT bool_and(caps) OVER (PARTITION BY key) AS d,
  min(CASE WHEN t = 'but' THEN i END) OVER (PARTITION BY key) AS but, {lags} FROM met
  WINDOW o AS (PARTITION BY key ORDER BY i)),
s0 AS (SELECT *, v + CASE WHEN caps AND d THEN CASE WHEN v > 0 THEN {cap} ELSE -{cap} END ELSE 0 END AS s0 FROM told),
{', '.join(steps)},
sc AS (SELECT key, CASE WHEN v IS NULL OR b IS NOT NULL THEN 0.0::DOUBLE ELSE s3
  * CASE WHEN t1 = 'least' AND v1 IS NULL AND (i = 1 OR t2 NOT IN ('at', 'very')) THEN {S.NEGATED} ELSE 1 END
  * CASE WHEN but IS NULL OR i = but THEN 1 WHEN i < but THEN {S.BEFORE_BUT} ELSE {S.AFTER_BUT} END END AS s FROM x3),
sums AS (SELECT key, sum(s) AS total, sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END) AS up,
  sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END) AS down, count(*) FILTER (s = 0) AS even FROM sc GROUP BY key),
marks AS (SELECT key, least(length(regexp_replace(text, '[^!]', '', 'g')), {S.MOST_EXCLAMATIONS}) * {S.EXCLAMATION}
  + CASE length(regexp_replace(text, '[^?]', '', 'g')) WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 * {S.QUESTION}
    WHEN 3 THEN 3 * {S.QUESTION} ELSE {S.MANY_QUESTIONS} END AS m FROM w),
e AS (SELECT marks.key, coalesce(total, 0)::DOUBLE + sign(coalesce(total, 0)) * m AS total,
  coalesce(up + CASE WHEN up > down THEN m ELSE 0 END, 0)::DOUBLE AS up,
  coalesce(down + CASE WHEN down > up THEN m ELSE 0 END, 0)::DOUBLE AS down,
  coalesce(even, 0)::DOUBLE AS even FROM marks LEFT JOIN sums USING (key))
SELECT key, CASE WHEN up + down + even = 0 THEN 0 ELSE round(up / (up + down + even), 6) END AS pos,
  CASE WHEN up + down + even = 0 THEN 0 ELSE round(down / (up + down + even), 6) END AS neg,
  CASE WHEN up + down + even = 0 THEN 0 ELSE round(even / (up + down + even), 6) END AS neu,
  round(total / sqrt(total * total + 15.0), 6) AS compound FROM e"""


# ------------------------------------------------------------------------ tag paths

TAGS = ["D", "J", "N", "R", "V"]
MISSING = -60.0


def tag_paths(spark, sf):
    """X8 with context: the best tag path of every turn."""
    t = _turns(spark, sf).select("key", X.normalize_tokens_a("text").alias("tokens"))
    pairs = X.explode_tokens(t, None, "tokens").distinct().select(
        "token", F.explode(F.array(*map(F.lit, TAGS))).alias("tag"))
    h = keyed_hash(F.col("token"), F.col("tag"))
    emission = pairs.where(h % 2 == 0).select("token", "tag", (-(h % 50)).cast("double").alias("score"))
    moves = spark.createDataFrame([(p, t) for p in [None, *TAGS] for t in TAGS], "prev string, tag string")
    moves = moves.withColumn("score", (-(keyed_hash(F.coalesce("prev", F.lit("-")), F.col("tag")) % 30)).cast("double"))
    out = decode_tags(t, "key", "tokens", emission, moves, MISSING)
    return out.select("key", F.array_join("tags", "").alias("tags"))


def tag_paths_sql():
    h = hash_sql("token || ':' || tag")
    move = f"-({hash_sql('''prev || ':' || tag''')} % 30)"
    return f"""WITH RECURSIVE t AS (SELECT {CONV_KEY} AS key, {normalize_tokens_a('text')} AS w FROM conversations),
tag AS (SELECT unnest([{', '.join(map(q, TAGS))}]) AS tag),
move AS (SELECT prev, tag, {move} AS score FROM tag, (SELECT tag AS prev FROM tag UNION ALL SELECT '-')),
emit AS (SELECT token, tag, CASE WHEN {h} % 2 = 0 THEN -({h} % 50) ELSE {MISSING}::BIGINT END AS score
  FROM (SELECT DISTINCT unnest(w) AS token FROM t), tag),
each AS (SELECT key, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM t),
way AS (SELECT key, 1 AS i, tag, m.score + e.score AS score, tag AS path FROM each JOIN emit e USING (token)
  JOIN move m USING (tag) WHERE i = 1 AND prev = '-'
  UNION ALL
  SELECT key, i, tag, score, path FROM (SELECT way.key, each.i, e.tag, way.score + m.score + e.score AS score,
    way.path || e.tag AS path, row_number() OVER (PARTITION BY way.key, e.tag
    ORDER BY way.score + m.score DESC, way.tag) AS r
    FROM way JOIN each ON each.key = way.key AND each.i = way.i + 1 JOIN emit e ON e.token = each.token
    JOIN move m ON m.prev = way.tag AND m.tag = e.tag) WHERE r = 1),
best AS (SELECT way.key, path FROM way JOIN t ON t.key = way.key AND way.i = len(w)
  QUALIFY row_number() OVER (PARTITION BY way.key ORDER BY score DESC, tag) = 1)
SELECT t.key, coalesce(path, '') AS tags FROM t LEFT JOIN best USING (key)"""


# ------------------------------------------------------------------- sub-word pieces

SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
LENGTH = 64


def subword_encode(spark, sf):
    """X11 on pieces: every turn as 64 ids."""
    t = _turns(spark, sf).select("key", X.normalize_tokens_a("text").alias("tokens"))
    words = X.explode_tokens(t, None, "tokens").distinct()
    heads = words.select(F.explode(F.expr("transform(sequence(1, 3), k -> substring(token, 1, k))")).alias("piece"))
    tails = words.where(F.length("token") > 1).select(F.explode(F.expr(
        "flatten(transform(sequence(2, length(token)), p -> array(concat('##', substring(token, p, 1)), "
        "concat('##', substring(token, p, 2)))))")).alias("piece"))
    pieces = heads.unionByName(tails).distinct().where(keyed_hash(F.col("piece"), "p") % 6 != 0)
    ranked = global_index(pieces, [F.col("piece")], "id").select("piece", (F.col("id") + len(SPECIAL)).alias("id"))
    marks = spark.createDataFrame(list(zip(SPECIAL, range(len(SPECIAL)))), "piece string, id bigint")
    out = encode_pieces(t, "key", "tokens", marks.unionByName(ranked), LENGTH)
    return out.select("key", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_used"), "n_pieces")


def subword_encode_sql():
    return f"""WITH RECURSIVE t AS (SELECT {CONV_KEY} AS key, {normalize_tokens_a('text')} AS w FROM conversations),
word AS (SELECT DISTINCT unnest(w) AS word FROM t),
raw AS (SELECT DISTINCT substr(word, 1, k) AS piece FROM word, (SELECT unnest([1, 2, 3]) AS k)
  UNION SELECT DISTINCT '##' || substr(word, p, k) FROM (SELECT word, unnest(range(2, length(word) + 1)) AS p FROM word),
  (SELECT unnest([1, 2]) AS k)),
voc AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 + {len(SPECIAL)} AS id FROM raw
  WHERE {hash_sql("piece || ':p'")} % 6 <> 0),
fit AS (SELECT word, p, k, id FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM word),
  (SELECT unnest([1, 2, 3]) AS k) JOIN voc ON piece = CASE WHEN p = 1 THEN '' ELSE '##' END || substr(word, p, k)
  WHERE p + k - 1 <= length(word) QUALIFY row_number() OVER (PARTITION BY word, p ORDER BY k DESC) = 1),
go AS (SELECT word, 1 AS p, []::BIGINT[] AS ids FROM word
  UNION ALL SELECT go.word, go.p + k, list_append(go.ids, fit.id) FROM go JOIN fit ON fit.word = go.word AND fit.p = go.p),
done AS (SELECT word.word, coalesce(any_value(ids) FILTER (p = length(word.word) + 1 AND length(word.word) <= 100),
  [1::BIGINT]) AS ids FROM word LEFT JOIN go ON go.word = word.word GROUP BY word.word),
each AS (SELECT key, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
row AS (SELECT key, flatten(list(ids ORDER BY i)) AS ids FROM each JOIN done USING (word) GROUP BY key),
full_row AS (SELECT key, coalesce(ids, []) AS ids FROM t LEFT JOIN row USING (key)),
cut AS (SELECT key, len(ids) AS n, list_concat([2::BIGINT], list_append(ids[1:{LENGTH - 2}], 3)) AS ids FROM full_row)
SELECT key, array_to_string(list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: 0)), ' ') AS ids,
  len(ids)::BIGINT AS n_used, n::BIGINT AS n_pieces FROM cut"""


SQL = {"sentiment_rules": sentiment_rules_sql, "tag_paths": tag_paths_sql, "subword_encode": subword_encode_sql}
