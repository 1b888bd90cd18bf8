"""Oracle SQL for the text queries."""

from __future__ import annotations

from .sqltext import (clean_tokens_b, count_bucket, keyed_hash, ngrams as ngram_sql,
                      normalize_tokens_a, q, remove_stop, split_ws, strip_punct_digits, STOP)
from ..functions.constants import WORD2_RE

CONV_KEY = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


def clean_text_basic():
    return f"""SELECT doc_id, array_to_string(t, ' ') AS clean_text, len(t)::BIGINT AS n_tokens
FROM (SELECT doc_id, {normalize_tokens_a('text')} AS t FROM documents)"""


def clean_text_symbols():
    return f"""SELECT doc_id, array_to_string({clean_tokens_b('text')}, ' ') AS clean_text
FROM documents"""


def normalize_tokens():
    return f"""SELECT {CONV_KEY} AS key, array_to_string(t, ' ') AS tokens, len(t)::BIGINT AS n_tokens
FROM (SELECT conv_id, turn, {clean_tokens_b('text', extra=True)} AS t FROM conversations)"""


def dedupe_clean():
    return f"""SELECT DISTINCT lang, array_to_string({clean_tokens_b('text')}, ' ') AS clean_text
FROM documents"""


def dropna_fill():
    return """SELECT d.doc_id, d.lang, coalesce(l.quality, 0)::BIGINT AS quality,
       coalesce(l.toxic, 0)::BIGINT AS toxic, l.quality IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL"""


def canonical_category():
    from .text_queries import PRIORITY_ALIASES
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PRIORITY_ALIASES.items())
    strip = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    p = strip.format(x="o_orderpriority")
    s = strip.format(x="o_orderstatus")
    return f"""SELECT o_orderkey, coalesce(CASE {p} {cases} ELSE {p} END, 'UNSPECIFIED') AS priority,
       coalesce({s}, 'U') AS status FROM orders"""


def ngrams():
    return f"""SELECT ngram, count(*)::BIGINT AS cnt FROM (
  SELECT unnest({ngram_sql(normalize_tokens_a('text'), 2)}) AS ngram FROM conversations) x
GROUP BY ngram"""


def vocabulary():
    return f"""WITH tf AS (
  SELECT doc_id, token, count(*) AS tf FROM (
    SELECT doc_id, unnest({normalize_tokens_a('text')}) AS token FROM documents) x
  GROUP BY ALL)
SELECT token, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cnt FROM tf GROUP BY token"""


def bucket_counts():
    return f"""SELECT ({count_bucket('turn')})::BIGINT AS bucket, count(*)::BIGINT AS n
FROM conversations GROUP BY ALL"""


def tfidf_long():
    return f"""WITH t AS (
  SELECT {CONV_KEY} AS key, regexp_extract_all(lower(text), {q(WORD2_RE)}) AS tokens
  FROM conversations),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
tf AS (SELECT key, token, count(*) AS tf FROM (SELECT key, unnest(tokens) AS token FROM t) x
       GROUP BY ALL),
idf AS (SELECT token, ln((1 + n.n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY token, n.n),
w AS (SELECT key, token, tf, tf * idf AS w FROM tf JOIN idf USING (token))
SELECT key, token, tf::BIGINT AS tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight
FROM w"""


def _conv_tokens_sql():
    return f"""ct AS (SELECT {CONV_KEY} AS key, turn, {normalize_tokens_a('text')} AS tokens
       FROM conversations),
voc AS (SELECT DISTINCT unnest(tokens) AS token FROM ct)"""


def _valence_sql():
    h = keyed_hash("token || ':v'")
    return f"""val AS (SELECT token, (({h} % 9) - 4)::DOUBLE AS valence FROM voc WHERE {h} % 5 = 0),
pos AS (SELECT key, unnest(tokens) AS token FROM ct),
agg AS (
  SELECT pos.key,
    sum(CASE WHEN coalesce(valence, 0) > 0 THEN valence + 1 ELSE 0 END) AS ps,
    sum(CASE WHEN coalesce(valence, 0) < 0 THEN valence - 1 ELSE 0 END) AS ns,
    sum(CASE WHEN coalesce(valence, 0) = 0 THEN 1.0 ELSE 0 END) AS nu,
    sum(coalesce(valence, 0)) AS s
  FROM pos LEFT JOIN val USING (token) GROUP BY pos.key),
sent AS (
  SELECT ct.key, ct.turn, coalesce(ps, 0) AS ps, coalesce(ns, 0) AS ns, coalesce(nu, 0) AS nu,
         coalesce(s, 0) AS s
  FROM ct LEFT JOIN agg USING (key)),
sh AS (
  SELECT key, turn,
    CASE WHEN ps + abs(ns) + nu = 0 THEN 0.0 ELSE abs(ps) / (ps + abs(ns) + nu) END AS pos,
    CASE WHEN ps + abs(ns) + nu = 0 THEN 0.0 ELSE abs(ns) / (ps + abs(ns) + nu) END AS neg,
    CASE WHEN ps + abs(ns) + nu = 0 THEN 0.0 ELSE abs(nu) / (ps + abs(ns) + nu) END AS neu,
    s / sqrt(s * s + 15.0) AS compound
  FROM sent)"""


def lexicon_sentiment():
    return f"""WITH {_conv_tokens_sql()}, {_valence_sql()}
SELECT key, round(pos, 6) AS pos, round(neg, 6) AS neg, round(neu, 6) AS neu,
       round(compound, 6) AS compound FROM sh"""


def _adjust_sql():
    return f"""WITH {_conv_tokens_sql()}, {_valence_sql()},
a0 AS (SELECT key, turn % 5 AS s, neg, compound FROM sh),
a1 AS (SELECT *, s > 0 AND s < 4 AND neg > 0.1 AS r1,
              CASE WHEN s > 0 AND s < 4 AND neg > 0.1 THEN s - 1 ELSE s END AS s1 FROM a0),
a2 AS (SELECT *, s > 0 AND s < 4 AND s1 > 0 AND s1 < 4 AND compound < 0.25 AS r2,
              CASE WHEN s > 0 AND s < 4 AND s1 > 0 AND s1 < 4 AND compound < 0.25
                   THEN s1 - 1 ELSE s1 END AS s2 FROM a1),
a3 AS (SELECT *, s > 0 AND s < 4 AND s2 > 0 AND s2 < 4 AND neg < 0.01 AS r3,
              CASE WHEN s > 0 AND s < 4 AND s2 > 0 AND s2 < 4 AND neg < 0.01
                   THEN s2 + 1 ELSE s2 END AS s3 FROM a2)"""


def adjust_label():
    return _adjust_sql() + """
SELECT key, s::BIGINT AS s, s1::BIGINT AS s1, s2::BIGINT AS s2, s3::BIGINT AS s3,
       (r1::INT + r2::INT)::BIGINT AS n_down, r3::BIGINT AS n_up FROM a3"""


def adjust_counts():
    return _adjust_sql() + """
SELECT sum(r1::INT + r2::INT)::BIGINT AS down, sum(r3::INT)::BIGINT AS up FROM a3"""


def dictionary_annotate():
    h = keyed_hash("token || ':t'")
    return f"""WITH {_conv_tokens_sql()},
tag AS (SELECT token, CASE WHEN suffix(token, 'ment') THEN 'NN' WHEN suffix(token, 'ly') THEN 'RB'
                  WHEN suffix(token, 'ing') THEN 'VBG' WHEN suffix(token, 'ed') THEN 'VBD'
                  ELSE 'JJ' END AS tag FROM voc WHERE {h} % 3 <> 0),
p AS (SELECT key, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM ct),
j AS (SELECT key, pos, token || '_' || coalesce(tag, 'NN') AS v FROM p LEFT JOIN tag USING (token)),
g AS (SELECT key, array_to_string(list(v ORDER BY pos), ' ') AS tagged FROM j GROUP BY key)
SELECT ct.key, coalesce(g.tagged, '') AS tagged FROM ct LEFT JOIN g USING (key)"""


def dictionary_rewrite():
    return f"""WITH {_conv_tokens_sql()},
lem AS (SELECT token AS form, substring(token, 1, length(token) - 1) AS lemma FROM voc
        WHERE length(token) > 3 AND suffix(token, 's')),
p AS (SELECT key, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM ct),
j AS (SELECT key, pos, coalesce(lemma, token) AS v FROM p LEFT JOIN lem ON lem.form = p.token),
g AS (SELECT key, array_to_string(list(v ORDER BY pos), ' ') AS lemmatized FROM j GROUP BY key)
SELECT ct.key, coalesce(g.lemmatized, '') AS lemmatized FROM ct LEFT JOIN g USING (key)"""


def sequence_encode():
    return f"""WITH {_conv_tokens_sql()},
cnt AS (SELECT token, count(*) AS c FROM (SELECT unnest(tokens) AS token FROM ct) x GROUP BY token),
vid AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) + 1 AS id FROM cnt),
p AS (SELECT key, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM ct),
g AS (SELECT key, list(coalesce(id, 1) ORDER BY pos) AS ids FROM p LEFT JOIN vid USING (token)
      GROUP BY key),
f AS (SELECT ct.key, coalesce(g.ids, []) AS ids FROM ct LEFT JOIN g USING (key))
SELECT key,
  array_to_string(list_concat(ids[1:64], list_transform(range(greatest(64 - len(ids), 0)), lambda x: 0)), ' ')
    AS input_ids,
  array_to_string(list_concat(list_transform(range(least(len(ids), 64)), lambda x: 1),
                              list_transform(range(greatest(64 - len(ids), 0)), lambda x: 0)), ' ')
    AS attention_mask,
  len(ids)::BIGINT AS n_tokens
FROM f"""


def stop_anti_join():
    return f"""SELECT doc_id, len(list_filter({split_ws(strip_punct_digits('text'))},
  lambda t: NOT list_contains({STOP}, t)))::BIGINT AS n_kept FROM documents"""
