"""Independent SQL (DuckDB dialect) for every registered query."""

from __future__ import annotations

from .sqltext import count_bucket, in_test, ngrams, normalize_tokens_a, q

SEED = 0
TEST_PCT = 20
ALPHA_S = 0.05
ALPHA_CUF = 1e-6


def _lang_docs_sql():
    return f"""d AS (
  SELECT doc_id, lang AS label, {normalize_tokens_a('text')} AS tokens,
         {in_test('doc_id', SEED, TEST_PCT)} AS is_test
  FROM documents)"""


def _nb_lang_core():
    a = ALPHA_S
    return f"""WITH {_lang_docs_sql()},
tr AS (SELECT * FROM d WHERE NOT is_test),
tt AS (SELECT label, unnest(tokens) AS token FROM tr),
cnt AS (SELECT label, token, count(*) AS c FROM tt GROUP BY label, token),
voc AS (SELECT count(DISTINCT token)::DOUBLE AS v FROM tt),
pri AS (SELECT label, count(*) AS n_l,
               ln(count(*)::DOUBLE / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY label),
te AS (SELECT doc_id, label AS truth FROM d WHERE is_test),
tf AS (SELECT doc_id, token, count(*) AS tf
       FROM (SELECT doc_id, unnest(tokens) AS token FROM d WHERE is_test) x
       WHERE token IN (SELECT token FROM tt) GROUP BY doc_id, token),
sc AS (
  SELECT te.doc_id, pri.label,
         pri.lp + coalesce(sum(tf.tf * ln((coalesce(cnt.c, 0) + {a}) / (pri.n_l + {a} * voc.v))), 0)
           AS score
  FROM te CROSS JOIN pri CROSS JOIN voc
  LEFT JOIN tf ON tf.doc_id = te.doc_id
  LEFT JOIN cnt ON cnt.label = pri.label AND cnt.token = tf.token
  GROUP BY te.doc_id, pri.label, pri.lp),
pred AS (
  SELECT sc.doc_id, 'lang' AS target, te.truth,
         first(sc.label ORDER BY sc.score DESC, sc.label) AS pred
  FROM sc JOIN te USING (doc_id) GROUP BY sc.doc_id, te.truth)"""


def _class_report_sql(src: str) -> str:
    """A6 over a relation (truth, pred)."""
    return f"""cc AS (
  SELECT cls, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM (
    SELECT CAST(truth AS VARCHAR) AS cls, 1 AS s, 0 AS p, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp FROM {src}
    UNION ALL SELECT CAST(pred AS VARCHAR), 0, 1, 0 FROM {src}) u GROUP BY cls),
per AS (
  SELECT cls AS class,
         CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
         support, tp FROM cc),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                        ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr,
               avg(f1) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr,
               sum(f1 * support) AS wf FROM per2),
rep AS (
  SELECT class, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0.0 ELSE tp::DOUBLE / n END, n FROM tot
  UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM tot
  UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, n FROM tot)"""


def nb_lang_predict():
    return _nb_lang_core() + "\nSELECT doc_id, target, truth, pred FROM pred"


def nb_lang_scores():
    return _nb_lang_core() + "\nSELECT doc_id, label, round(score, 4) AS score FROM sc"


def nb_lang_model():
    a = ALPHA_S
    return _nb_lang_core() + f"""
SELECT 'lang' AS target, label, n_l::BIGINT AS n_docs, round(lp, 6) AS log_prior,
       round(ln({a} / (n_l + {a} * v)), 6) AS base FROM pri CROSS JOIN voc"""


def nb_lang_report():
    return _nb_lang_core() + ",\n" + _class_report_sql("pred") + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support::BIGINT AS support FROM rep"""


# ---------------------------------------------------------- conversations, 2 targets

def _conv_docs_sql():
    key = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
    return f"""d AS (
  SELECT {key} AS key, role, turn, {count_bucket('turn')} AS turn_bucket,
         {normalize_tokens_a('text')} AS tokens, {in_test(key, SEED, TEST_PCT)} AS is_test
  FROM conversations),
lab AS (
  SELECT key, 'role' AS target, role AS label, tokens, is_test FROM d WHERE role IS NOT NULL
  UNION ALL
  SELECT key, 'turn', CAST(turn_bucket AS VARCHAR), tokens, is_test FROM d
  WHERE turn_bucket IS NOT NULL)"""


def _nb_conv_core(drop=0, ngram=1):
    a_s, a_c = ALPHA_S, ALPHA_CUF
    toks = ngrams("tokens", ngram)
    alpha = f"CASE WHEN target = 'role' THEN {a_s} ELSE {a_c} END"
    dropped = ""
    delta_num = "coalesce(cnt.c, 0) + pri.alpha"
    if drop:
        dropped = f""",
rk AS (SELECT target, label, token, row_number() OVER (
         PARTITION BY target, label ORDER BY c DESC, token) AS rn FROM cnt),
dr AS (SELECT target, label, token FROM rk WHERE rn <= {drop})"""
        delta_num = (f"CASE WHEN dr.token IS NOT NULL THEN {a_s} "
                     "ELSE coalesce(cnt.c, 0) + pri.alpha END")
    return f"""WITH {_conv_docs_sql()},
tr AS (SELECT * FROM lab WHERE NOT is_test),
tt AS (SELECT target, label, unnest({toks}) AS token FROM tr),
cnt AS (SELECT target, label, token, count(*) AS c FROM tt GROUP BY ALL),
voc AS (SELECT count(DISTINCT token)::DOUBLE AS v FROM tt),
pri0 AS (SELECT target, label, count(*) AS n_l FROM tr GROUP BY ALL),
pri AS (SELECT target, label, n_l, {alpha} AS alpha,
               ln(n_l::DOUBLE / sum(n_l) OVER (PARTITION BY target)) AS lp FROM pri0){dropped},
te AS (SELECT DISTINCT key FROM d WHERE is_test),
tf AS (SELECT key, token, count(*) AS tf
       FROM (SELECT key, unnest({toks}) AS token FROM d WHERE is_test) x
       WHERE token IN (SELECT token FROM tt) GROUP BY ALL),
sc AS (
  SELECT te.key, pri.target, pri.label,
         pri.lp + coalesce(sum(tf.tf * ln(({delta_num}) / (pri.n_l + pri.alpha * voc.v))), 0)
           AS score
  FROM te CROSS JOIN pri CROSS JOIN voc
  LEFT JOIN tf ON tf.key = te.key
  LEFT JOIN cnt ON cnt.target = pri.target AND cnt.label = pri.label AND cnt.token = tf.token
  {"LEFT JOIN dr ON dr.target = pri.target AND dr.label = pri.label AND dr.token = tf.token" if drop else ""}
  GROUP BY te.key, pri.target, pri.label, pri.lp),
pred AS (
  SELECT key, target,
         first(label ORDER BY score DESC, CASE WHEN target = 'turn' THEN CAST(label AS DOUBLE) END,
               label) AS pred
  FROM sc GROUP BY key, target),
truth AS (SELECT key, 'role' AS target, role AS truth FROM d WHERE is_test
          UNION ALL SELECT key, 'turn', CAST(turn_bucket AS VARCHAR) FROM d WHERE is_test)"""


def _conv_pred_sql(drop=0, ngram=1):
    return _nb_conv_core(drop, ngram) + """
SELECT pred.key, pred.target, truth.truth, pred.pred FROM pred JOIN truth USING (key, target)"""


def nb_multi_predict():
    return _conv_pred_sql()


def nb_duplicate_keys():
    return f"""SELECT split_part(key, ':', 1) AS key, target, truth, pred FROM ({_conv_pred_sql()}) p"""


def nb_drop_top():
    return _conv_pred_sql(drop=3)


def nb_bigram_predict():
    return _conv_pred_sql(ngram=2)


def token_counts():
    return f"""WITH {_conv_docs_sql()}
SELECT target, label, token, count(*)::BIGINT AS cnt
FROM (SELECT target, label, unnest(tokens) AS token FROM lab) x GROUP BY ALL"""


def log_priors():
    return f"""WITH {_conv_docs_sql()},
p AS (SELECT target, label, count(*) AS n FROM lab GROUP BY ALL)
SELECT target, label, n::BIGINT AS n_docs,
       round(ln(n::DOUBLE / sum(n) OVER (PARTITION BY target)), 6) AS log_prior FROM p"""


def nb_top_tokens():
    return f"""WITH {_conv_docs_sql()},
c AS (SELECT target, label, token, count(*) AS cnt
      FROM (SELECT target, label, unnest(tokens) AS token FROM lab) x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY cnt DESC, token) AS rank
      FROM c)
SELECT target, label, rank::INTEGER AS rank, token, cnt::BIGINT AS cnt FROM r WHERE rank <= 5"""
