"""Oracle SQL for the record-table queries."""

from __future__ import annotations

from .oracle import _class_report_sql, _nb_conv_core
from .sqltext import in_test, keyed_hash

PRED = "pr AS (SELECT pred.key, pred.target, truth.truth, pred.pred FROM pred JOIN truth USING (key, target))"


def _pred():
    return _nb_conv_core() + ",\n" + PRED


def confusion():
    return _pred() + """,
p AS (SELECT * FROM pr WHERE target = 'role'),
cls AS (SELECT truth AS c FROM p UNION SELECT pred FROM p),
cn AS (SELECT truth, pred, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT a.c AS true_label, b.c AS pred_label, coalesce(cn.n, 0)::BIGINT AS n
      FROM cls a CROSS JOIN cls b LEFT JOIN cn ON cn.truth = a.c AND cn.pred = b.c)
SELECT true_label, pred_label, n,
       round(CASE WHEN sum(n) OVER (PARTITION BY true_label) = 0 THEN 0.0
                  ELSE n::DOUBLE / sum(n) OVER (PARTITION BY true_label) END, 6) AS share FROM g"""


def class_report():
    return _pred() + ",\np AS (SELECT * FROM pr WHERE target = 'role'),\n" + _class_report_sql("p") + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support::BIGINT AS support FROM rep"""


def macro_micro_precision():
    return _pred() + ",\np AS (SELECT * FROM pr WHERE target = 'role'),\n" + _class_report_sql("p") + """
SELECT round(avg(CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END), 6) AS macro_precision,
       round(CASE WHEN sum(predicted) = 0 THEN 0.0 ELSE sum(tp)::DOUBLE / sum(predicted) END, 6)
         AS micro_precision FROM cc"""


def accuracy_by_target():
    return _pred() + """
SELECT target, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*)::BIGINT AS n FROM pr GROUP BY target"""


def off_by_histogram():
    return _pred() + """,
p AS (SELECT abs(CAST(truth AS INT) - CAST(pred AS INT)) AS k FROM pr WHERE target = 'turn'),
g AS (SELECT k, count(*) AS n FROM p GROUP BY k)
SELECT ks.k::BIGINT AS k, round(100.0 * coalesce(g.n, 0) / (SELECT count(*) FROM p), 6)::DOUBLE AS pct
FROM range(0, 6) ks(k) LEFT JOIN g ON g.k = ks.k"""


def mae_by_target():
    return _pred() + """
SELECT target, round(avg(abs(CAST(pred AS INT) - CAST(split_part(key, ':', 2) AS INT))), 6) AS mae
FROM pr WHERE target = 'turn' GROUP BY target"""


def _price_sql():
    return """WITH r AS (SELECT sum(l_extendedprice / 1000.0) / sum(l_quantity) AS r FROM lineitem),
m AS (SELECT l_returnflag, l_extendedprice / 1000.0 AS y, l_quantity * r.r AS p FROM lineitem, r)"""


def regression_metrics():
    return _price_sql() + """
SELECT l_returnflag, count(*)::BIGINT AS n, round(avg((p - y) * (p - y)), 6) AS mse,
       round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
       round(1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)), 6) AS r2
FROM m GROUP BY l_returnflag"""


def mape_score():
    return _price_sql() + "\nSELECT round(100 - 100 * avg(abs(p - y)) / avg(y), 6) AS score FROM m"


FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey",
         "l_orderkey", "l_net", "l_charge"]
LI = """(SELECT *, l_extendedprice * (1 - l_discount) AS l_net,
        l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge FROM lineitem)"""


def _per_feature(fn, target, digits, name):
    parts = [f"SELECT '{f}' AS feature, round({fn}({f}::DOUBLE, {target}), {digits}) AS {name} FROM {LI}"
             for f in FEATS]
    return "\nUNION ALL ".join(parts)


def feature_corr():
    return _per_feature("corr", "l_extendedprice", 6, "corr")


def feature_cov():
    return _per_feature("covar_samp", "l_extendedprice / 1000.0", 4, "cov")


def corr_matrix():
    cols = FEATS + ["l_extendedprice"]
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM {LI}"
             for a in cols for b in cols]
    return "\nUNION ALL ".join(parts)


def corr_top_n():
    return f"SELECT * FROM ({_per_feature('corr', 'l_extendedprice', 6, 'corr')}) ORDER BY corr DESC, feature LIMIT 3"


def corr_threshold():
    return f"SELECT feature, round(corr, 6) AS corr FROM ({_per_feature('corr', 'l_extendedprice', 15, 'corr')}) WHERE corr > 0.3"


def cross_entropy():
    return """WITH s AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS s, label FROM embeddings),
m AS (SELECT s, label, list_max(s) AS mx FROM s)
SELECT round(avg(mx + ln(list_sum(list_transform(s, lambda x: exp(x - mx)))) - s[label + 1]), 6)
         AS cross_entropy, count(*)::BIGINT AS n FROM m"""


def argmax_accuracy():
    return """SELECT round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label
                  THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*)::BIGINT AS n FROM embeddings"""


def _factor_codes_sql():
    return """codes AS (
  SELECT 'event_type' AS "column", CAST(event_type AS VARCHAR) AS value,
         (row_number() OVER (ORDER BY min((ts, event_id)), CAST(event_type AS VARCHAR)) - 1)::BIGINT AS code
  FROM events WHERE event_type IS NOT NULL GROUP BY event_type
  UNION ALL
  SELECT 'user_id', CAST(user_id AS VARCHAR),
         (row_number() OVER (ORDER BY min((ts, event_id)), CAST(user_id AS VARCHAR)) - 1)::BIGINT
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"""


def factorize():
    return f"""WITH {_factor_codes_sql()}
SELECT e.event_id, coalesce(a.code, -1)::BIGINT AS event_type_code,
       coalesce(b.code, -1)::BIGINT AS user_id_code
FROM events e
LEFT JOIN codes a ON a."column" = 'event_type' AND a.value = CAST(e.event_type AS VARCHAR)
LEFT JOIN codes b ON b."column" = 'user_id' AND b.value = CAST(e.user_id AS VARCHAR)"""


def factorize_codes():
    return f"WITH {_factor_codes_sql()}\nSELECT \"column\", value, code FROM codes"


def _scaled_sql(kind):
    if kind == "minmax":
        v = "CASE WHEN mx = mn THEN 0.0 ELSE (x - mn) / (mx - mn) END"
    else:
        v = "CASE WHEN sd = 0 THEN 0.0 ELSE (x - mu) / sd END"
    return f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
                  generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
s AS (SELECT dim, min(x) AS mn, max(x) AS mx, avg(x) AS mu, stddev_pop(x) AS sd FROM x GROUP BY dim)
SELECT vec_id, dim::BIGINT AS dim, round({v}, 6) AS value FROM x JOIN s USING (dim)"""


def minmax_scale():
    return _scaled_sql("minmax")


def standard_scale():
    return _scaled_sql("standard")


def hash_split():
    return f"SELECT event_id, {in_test('event_id', 42, 20)} AS is_test FROM events"


def stratified_folds():
    h = keyed_hash("CAST(vec_id AS VARCHAR) || ':0'")
    return f"""SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {h}, vec_id) - 1) % 5)::BIGINT
  AS fold FROM embeddings"""


def undersample():
    h = keyed_hash("CAST(event_id AS VARCHAR) || ':7'")
    return f"""SELECT event_id, event_type FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {h}, event_id) AS rn
  FROM events WHERE event_type IN ('view', 'click')) x WHERE rn <= 300
UNION ALL SELECT event_id, event_type FROM events
WHERE event_type NOT IN ('view', 'click') OR event_type IS NULL"""


def value_counts():
    return "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type"


def json_decode_defaults():
    return """SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k,
       coalesce(json_extract_string(props, '$.j'), '') AS j FROM events"""


def json_encode():
    return """SELECT event_id, to_json({'event_type': event_type, 'user_id': user_id, 'value': value}) AS json
FROM events"""


def tail_n():
    return "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"


def head_n():
    return "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"


def _d2(a, b):
    return (f"round(list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE))), 9)")


def _knn_sql():
    t = in_test("vec_id", 0, 20)
    return f"""WITH tr AS (SELECT * FROM embeddings WHERE NOT {t}),
te AS (SELECT * FROM embeddings WHERE {t}),
pairs AS (SELECT te.vec_id AS qid, tr.vec_id AS tid, tr.label, {_d2('te.embedding', 'tr.embedding')} AS d2
          FROM te CROSS JOIN tr),
nb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rank FROM pairs
       QUALIFY rank <= 5)"""


def knn_neighbors():
    return _knn_sql() + "\nSELECT qid AS query_id, rank::BIGINT AS rank, tid AS train_id, d2 FROM nb"


def knn_tree_events():
    return """WITH e AS (SELECT event_id, value::DOUBLE AS x, user_id / 100.0::DOUBLE AS y,
  hour(ts) + minute(ts) / 60.0::DOUBLE AS z FROM events),
d AS (SELECT q.event_id AS qid, t.event_id, round((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)
  + (q.z - t.z) * (q.z - t.z), 9) AS d2 FROM e q JOIN e t ON q.event_id % 100 = 0)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, event_id) AS rank, event_id, d2 FROM d
QUALIFY rank <= 5"""


def _knn_vote(weighted):
    if weighted:
        w = """CASE WHEN max(CASE WHEN d2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1
                 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / sqrt(d2) END"""
    else:
        w = "1.0"
    return _knn_sql() + f""",
wv AS (SELECT qid, label, {w} AS w FROM nb),
s AS (SELECT qid, label, sum(w) AS s FROM wv GROUP BY ALL),
p AS (SELECT qid, first(label ORDER BY s DESC, label) AS pred FROM s GROUP BY qid)
SELECT p.qid AS vec_id, te.label::BIGINT AS truth, p.pred::BIGINT AS pred
FROM p JOIN te ON te.vec_id = p.qid"""


def knn_classify():
    return _knn_vote(False)


def knn_classify_weighted():
    return _knn_vote(True)


def _smote_sql():
    hn = keyed_hash("CAST(b.vec_id AS VARCHAR) || ':' || CAST(b.j AS VARCHAR) || ':n'")
    hl = keyed_hash("CAST(b.vec_id AS VARCHAR) || ':' || CAST(b.j AS VARCHAR) || ':l'")
    return f"""WITH sz AS (SELECT label, count(*) AS n_c FROM embeddings GROUP BY label),
sz2 AS (SELECT label, n_c, max(n_c) OVER () - n_c AS deficit FROM sz),
rk AS (SELECT e.*, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) - 1 AS r FROM embeddings e),
base AS (SELECT rk.*, sz2.n_c, sz2.deficit FROM rk JOIN sz2 USING (label)
         WHERE sz2.deficit > 0 AND sz2.n_c > 1 AND rk.r < sz2.deficit),
reps AS (SELECT base.*, base.r + i * base.n_c AS j
         FROM base, LATERAL (SELECT unnest(range(0, (floor((deficit - 1 - r) / n_c) + 1)::BIGINT)) AS i)),
nb AS (SELECT a.vec_id AS qid, b2.vec_id AS tid,
              row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d2('a.embedding', 'b2.embedding')}, b2.vec_id) AS rank
       FROM embeddings a JOIN embeddings b2 ON a.label = b2.label AND a.vec_id <> b2.vec_id
       QUALIFY rank <= 5),
pick AS (SELECT b.label, b.vec_id AS base_id, b.j, b.embedding AS x,
                ({hl})::DOUBLE / 4294967296.0 AS lam,
                ({hn} % least(5, b.n_c - 1)) + 1 AS nn_rank
         FROM reps b),
joined AS (SELECT pick.*, e.embedding AS y FROM pick
           JOIN nb ON nb.qid = pick.base_id AND nb.rank = pick.nn_rank
           JOIN embeddings e ON e.vec_id = nb.tid)"""


def smote():
    return _smote_sql() + """
SELECT label::BIGINT AS label, base_id, j::BIGINT AS j, (d - 1)::BIGINT AS dim,
       round(x[d]::DOUBLE + lam * (y[d]::DOUBLE - x[d]::DOUBLE), 6) AS value
FROM joined, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS d)"""


def smote_class_counts():
    return """SELECT label::BIGINT AS label, max(count(*)) OVER ()::BIGINT AS n FROM embeddings GROUP BY label"""
