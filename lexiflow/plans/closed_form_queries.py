"""Model operators at settings whose result has a closed form, so that an SQL
engine can check them: trees of depth 1 on a feature with few distinct values,
regression on categories, components of two columns."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import models as ML
from ..operators.boosting import BoostedRegressor
from ..operators.search import grid_maps, search
from ..operators.stats import cumulative
from ..sources.readers import read_table
from .sqltext import keyed_hash

CLASSES = ["A", "N", "R"]      # return flags in alphabetical order


def _lines(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"),
        F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    li = StringIndexer(inputCol="l_returnflag", outputCol="label",
                       stringOrderType="alphabetAsc").fit(li).transform(li)
    return VectorAssembler(inputCols=["l_linenumber"], outputCol="features").transform(li)


def _shares(pred):
    """Per line number the rows and the class probabilities of its leaf."""
    p = vector_to_array("probability")
    return pred.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.max(F.get(p, F.lit(i))), 6).alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)])


def tree_stump(spark, sf):
    """M8: the best entropy split of the line number for the return flag."""
    li = _lines(spark, sf)
    return _shares(ML.decision_tree(max_depth=1).fit(li).transform(li))


def forest_stump(spark, sf):
    """M5: a forest of one tree on all rows and features."""
    li = _lines(spark, sf)
    return _shares(ML.random_forest(n_trees=1, max_depth=1, subset="all").setBootstrap(False).fit(li).transform(li))


def _means(pred, column):
    return pred.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"),
                                            F.round(F.max(column), 6).alias("prediction"))


def regressor_stump(spark, sf):
    """M6: the best variance split of the line number for the quantity."""
    li = _lines(spark, sf)
    est = (ML.random_forest_regressor(n_trees=1, max_depth=1, label="l_quantity").setBootstrap(False)
           .setFeatureSubsetStrategy("all"))
    return _means(est.fit(li).transform(li), "prediction")


def gbt_stump(spark, sf):
    """M9: one boosting round of depth 1 is the best variance split."""
    li = _lines(spark, sf)
    model = ML.fit_multi_target(li, ["l_quantity"], max_depth=1, max_iter=1)["l_quantity"]
    return _means(model.transform(li), "pred_l_quantity")


def lr_shares(spark, sf):
    """M4: unregularised regression on a category gives its class shares."""
    li = OneHotEncoder(inputCols=["l_linenumber"], outputCols=["oh"], dropLast=False).fit(_lines(spark, sf)) \
        .transform(_lines(spark, sf)).drop("features").withColumnRenamed("oh", "features")
    est = ML.logistic_regression(1, C=1e12, max_iter=200).setTol(1e-10)
    p = vector_to_array("probability")
    return est.fit(li).transform(li).groupBy("l_linenumber").agg(*[
        F.round(F.max(F.get(p, F.lit(i))), 3).alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)])


def pca_two(spark, sf):
    """F5 + N1: the variance shares of two columns' components are the eigenvalues
    of a 2 x 2 covariance matrix."""
    li = VectorAssembler(inputCols=["l_quantity", "l_linenumber"], outputCol="features").transform(
        _lines(spark, sf).drop("features"))
    model = ML.pca_pipeline(2).fit(li)
    t = spark.createDataFrame(ML.explained_variance(model.stages[-1]), "pc int, ratio double")
    return cumulative(t.withColumn("ratio", F.round("ratio", 6)), "pc", "ratio", "cumulative", round_to=6)


# --- the same in SQL ---------------------------------------------------------------------------

_SIDES = """c AS (SELECT l_linenumber AS x, l_returnflag AS y, count(*) AS n, sum(l_quantity::DOUBLE) AS s,
  sum(l_quantity::DOUBLE * l_quantity::DOUBLE) AS ss FROM lineitem GROUP BY ALL),
cuts AS (SELECT DISTINCT x AS cut FROM c WHERE x < (SELECT max(x) FROM c)),
side AS (SELECT cut, x <= cut AS below, y, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM cuts, c GROUP BY ALL),
leaf AS (SELECT cut, below, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM side GROUP BY ALL)"""


def tree_stump_sql():
    parts = ", ".join(f"round(coalesce(sum(side.n) FILTER (side.y = '{c}'), 0) / max(leaf.n), 6) AS p_{c.lower()}"
                      for c in CLASSES)
    return f"""WITH {_SIDES},
best AS (SELECT cut FROM side JOIN leaf USING (cut, below) GROUP BY cut
         ORDER BY sum(-side.n * log2(side.n / leaf.n)), cut LIMIT 1),
share AS (SELECT leaf.below, {parts} FROM best JOIN leaf USING (cut) JOIN side USING (cut, below) GROUP BY leaf.below),
rows AS (SELECT x, sum(n)::BIGINT AS n FROM c GROUP BY x)
SELECT x AS l_linenumber, n, p_a, p_n, p_r FROM rows JOIN share ON share.below = (x <= (SELECT cut FROM best))"""


def regressor_stump_sql():
    return f"""WITH {_SIDES},
best AS (SELECT cut FROM leaf GROUP BY cut ORDER BY sum(ss - s * s / n), cut LIMIT 1),
rows AS (SELECT x, sum(n)::BIGINT AS n FROM c GROUP BY x)
SELECT x AS l_linenumber, rows.n, round(leaf.s / leaf.n, 6) AS prediction
FROM rows JOIN best ON true JOIN leaf ON leaf.cut = best.cut AND leaf.below = (x <= best.cut)"""


def lr_shares_sql():
    parts = ", ".join(f"round(count(*) FILTER (l_returnflag = '{c}') / count(*), 3) AS p_{c.lower()}" for c in CLASSES)
    return f"SELECT l_linenumber, {parts} FROM lineitem GROUP BY 1"


def pca_two_sql():
    return """WITH m AS (SELECT var_samp(l_quantity::DOUBLE) AS a, var_samp(l_linenumber::DOUBLE) AS c,
  covar_samp(l_quantity::DOUBLE, l_linenumber::DOUBLE) AS b FROM lineitem),
r AS (SELECT sqrt((a - c) ** 2 + 4 * b * b) / (a + c) AS r FROM m),
e AS (SELECT unnest([0, 1]) AS pc, unnest([round((1 + r) / 2, 6), round((1 - r) / 2, 6)]) AS ratio FROM r)
SELECT pc, ratio, round(sum(ratio) OVER (ORDER BY pc), 6) AS cumulative FROM e"""


SQL = {"tree_stump": tree_stump_sql, "forest_stump": tree_stump_sql, "regressor_stump": regressor_stump_sql,
       "gbt_stump": regressor_stump_sql, "lr_shares": lr_shares_sql, "pca_two": pca_two_sql}


# --- two boosting rounds of depth 2 ------------------------------------------------------------

BOOST_FEATURES = ["l_linenumber", "l_discount", "l_tax"]
BOOST = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1, "minSplitLoss": 0.85}


def boost_two_rounds(spark, sf):
    """M9: second-order boosting on few-valued features; the predictions of every cell."""
    li = read_table(spark, sf, "lineitem").select(
        *[F.col(c).cast("double").alias(c) for c in BOOST_FEATURES], F.col("l_quantity").cast("double").alias("label"))
    li = VectorAssembler(inputCols=BOOST_FEATURES, outputCol="features").transform(li)
    out = BoostedRegressor(**BOOST).fit(li).transform(li)
    return out.groupBy(*BOOST_FEATURES).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("prediction"), 6).alias("prediction"))


def boost_two_rounds_sql():
    """Every cut of every feature in every node, level by level, over the cells."""
    ctes = [f"""cell AS (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in BOOST_FEATURES)}, count(*) AS n,
  sum(l_quantity::DOUBLE) AS s FROM lineitem GROUP BY ALL)""",
            "at_0_0 AS (SELECT *, 0 AS node, (SELECT sum(s) / sum(n) FROM cell) AS pred FROM cell)"]
    for tree in range(BOOST["maxIter"]):
        for level in range(BOOST["maxDepth"]):
            name, here, then = f"{tree}_{level}", f"at_{tree}_{level}", f"at_{tree}_{level + 1}"
            values = " UNION ALL ".join(
                f"SELECT node, {i} AS f, {c} AS x, sum(pred * n - s) AS g, sum(n) AS h FROM {here} GROUP BY node, {c}"
                for i, c in enumerate(BOOST_FEATURES))
            own = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(BOOST_FEATURES))
            ctes += [
                f"value_{name} AS ({values})",
                f"""cut_{name} AS (SELECT node, f, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl,
  sum(g) OVER (PARTITION BY node, f) AS g, sum(h) OVER (PARTITION BY node, f) AS h
  FROM value_{name} WINDOW w AS (PARTITION BY node, f ORDER BY x))""",
                f"""best_{name} AS (SELECT node, f, x FROM (SELECT *, row_number() OVER (PARTITION BY node
  ORDER BY gain DESC, f, x) AS r FROM (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1)
  - g * g / (h + 1) AS gain FROM cut_{name} WHERE hl < h) WHERE gain >= {BOOST['minSplitLoss']}) WHERE r = 1)""",
                f"""{then} AS (SELECT a.* REPLACE (CASE WHEN b.f IS NULL THEN a.node
  WHEN CASE b.f {own} END <= b.x THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node)
  FROM {here} a LEFT JOIN best_{name} b USING (node))"""]
        ctes.append(f"""at_{tree + 1}_0 AS (SELECT a.* REPLACE (0 AS node, a.pred - {BOOST['stepSize']} * l.g / (l.h + 1) AS pred)
  FROM at_{tree}_{BOOST['maxDepth']} a JOIN (SELECT node, sum(pred * n - s) AS g, sum(n) AS h
  FROM at_{tree}_{BOOST['maxDepth']} GROUP BY node) l USING (node))""")
    return (f"WITH {', '.join(ctes)} SELECT {', '.join(BOOST_FEATURES)}, n, round(pred, 6) AS prediction "
            f"FROM at_{BOOST['maxIter']}_0")


SQL["boost_two_rounds"] = boost_two_rounds_sql


# --- a search whose folds and trees have a closed form -------------------------------------------

LETTERS = ["é", "ñ", "ß"]
SEARCH_FOLDS = 3


def search_stumps(spark, sf):
    """Trees of depth 0 and 1 on three letters of a text, for its language: the
    accuracy of every (parameters, fold)."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", *[
        F.coalesce(F.contains("text", F.lit(x)), F.lit(False)).cast("double").alias(f"x{i}") for i, x in enumerate(LETTERS)])
    d = StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(d).transform(d)
    d = VectorAssembler(inputCols=[f"x{i}" for i in range(len(LETTERS))], outputCol="features").transform(d)
    est = ML.decision_tree()
    out = search(d, est, grid_maps(est, {"maxDepth": [0, 1]}), "doc_id", "label", SEARCH_FOLDS, metric="accuracy", refit=False)
    return out.scores.select("params", F.col("fold").cast("bigint").alias("fold"), F.round("score", 9).alias("score"))


def search_stumps_sql():
    has = ", ".join(f"coalesce(contains(text, '{x}'), false) AS x{i}" for i, x in enumerate(LETTERS))
    h = keyed_hash("CAST(doc_id AS VARCHAR) || ':0'")
    long = " UNION ALL ".join(f"SELECT doc_id, lang, fold, {i} AS f, x{i} AS v FROM d" for i in range(len(LETTERS)))
    return f"""WITH d AS (SELECT doc_id, lang, {has},
  (row_number() OVER (PARTITION BY lang ORDER BY {h}, doc_id) - 1) % {SEARCH_FOLDS} AS fold FROM documents),
long AS ({long}), held AS (SELECT range AS held FROM range({SEARCH_FOLDS})),
cell AS (SELECT held, f, v, lang, count(*) AS n FROM long, held WHERE fold <> held GROUP BY ALL),
side AS (SELECT *, sum(n) OVER (PARTITION BY held, f, v) AS m FROM cell),
best AS (SELECT held, f FROM side GROUP BY held, f
  QUALIFY row_number() OVER (PARTITION BY held ORDER BY sum(-n * log2(n / m)), f) = 1),
leaf AS (SELECT held, f, v, lang FROM cell JOIN best USING (held, f)
  QUALIFY row_number() OVER (PARTITION BY held, v ORDER BY n DESC, lang) = 1),
root AS (SELECT held, lang FROM cell WHERE f = 0 GROUP BY held, lang
  QUALIFY row_number() OVER (PARTITION BY held ORDER BY sum(n) DESC, lang) = 1)
SELECT 'maxDepth=0' AS params, fold::BIGINT AS fold, round(avg((d.lang = root.lang)::INT), 9) AS score
FROM d JOIN root ON held = fold GROUP BY fold
UNION ALL SELECT 'maxDepth=1', fold::BIGINT, round(avg((long.lang = leaf.lang)::INT), 9)
FROM long JOIN leaf ON held = fold AND long.f = leaf.f AND long.v = leaf.v GROUP BY fold"""


SQL["search_stumps"] = search_stumps_sql
