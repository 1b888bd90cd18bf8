"""End-to-end jobs (E1-E11): compositions of the operators over the
reference's own input formats (review JSON, flow CSV).

Every job returns DataFrames (reports are small aggregates); fitted pieces
(factor codes, scaler statistics, PCA, models) are fitted on the training
part and reused on held-out data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import (DecisionTreeClassificationModel, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import in_test
from ..operators import lexicon as L
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import naive_bayes as nb
from ..operators.boosting import BoostedRegressor
from ..operators.clean import (canonicalize, count_bucket, dedupe, drop_nulls, select_by_position, shift_label,
                               string_columns, strip, to_bool)
from ..operators.features import (apply_factorize, fit_factorize, fit_scaler, minmax_expr, minmax_scale,
                                 standard_expr)
from ..operators.kd_tree import knn_tree
from ..operators.neighbors import knn, vote
from ..operators.sampling import undersample
from ..operators.search import grid_maps, random_maps, search
from ..operators.smote import oversample
from ..operators.stats import corr_with_target, cov_with_target, top_n
from ..operators.vectorizer import TfidfVectorizer
from ..session import cut_lineage
from ..schemas import FEATURE_SETS, FLOW_CLASS_ALIASES, FLOW_FEATURES, REVIEW
from ..sources.readers import (decode_with_defaults, encode_sorted_json, head, read_flows, read_reviews,
                               tail, write_json)
from ..operators.encode import encode
from ..operators.subwords import encode_pieces
from ..sources.checked import issue_counts, read_flows_checked
from ..sources.line_tail import tail_lines


def _review_key(df: DataFrame) -> DataFrame:
    """A stable key: review_id, or a digest of the record when it is missing."""
    digest = F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    return df.withColumn("_key", F.coalesce(F.nullif(F.col("review_id"), F.lit("")), digest))


# ------------------------------------------------------------------------- E1

def naive_bayes_reviews(spark: SparkSession, path: str, alpha_s: float = 0.07,
                        alpha_cuf: float = 1e-14, ngram: int = 1, drop: int = 0, seed: int = 0,
                        model_path: str | None = None, training: bool = True) -> dict:
    """Reviews -> tokens -> split -> multi-target NB (stars + bucketed votes)
    -> predictions and reports."""
    r = _review_key(read_reviews(spark, path))
    d = r.select("_key", "stars", "useful", "funny", "cool",
                 X.normalize_tokens_a(F.coalesce("text", F.lit(""))).alias("tokens"))
    d = d.withColumn("is_test", in_test("_key", seed, 20))
    targets = [nb.Target("stars", F.col("stars"), alpha_s)] + [
        nb.Target(t, count_bucket(t), alpha_cuf, missing_alpha=alpha_s)
        for t in ("useful", "funny", "cool")]
    if training or model_path is None:
        model = nb.fit(d.where(~F.col("is_test")), "_key", "tokens", targets, ngram=ngram, drop=drop)
        if model_path:
            nb.save(model, model_path)
        test = d.where(F.col("is_test"))
    else:
        model = nb.load(spark, model_path)
        test = d
    names = ["stars", "useful", "funny", "cool"]
    pred = nb.predict(model, test, "_key", "tokens", carry=names)
    raw = F.col("target")
    raw = F.when(raw == "stars", F.col("stars")).when(raw == "useful", F.col("useful")) \
        .when(raw == "funny", F.col("funny")).otherwise(F.col("cool"))
    p = pred.select("_key", "target", "pred", raw.cast("int").alias("raw")).withColumn(
        "pred_i", F.col("pred").cast("int"))
    stars = p.where(F.col("target") == "stars")
    votes = p.where(F.col("target") != "stars")
    return {
        "predictions": p,
        "accuracy": M.accuracy(stars, "raw", "pred_i"),
        "class_report": M.class_report(stars, "raw", "pred_i"),
        "confusion": M.confusion(stars, "raw", "pred_i"),
        "off_by": M.off_by_histogram(stars, "raw", "pred_i", max_k=4),
        "vote_mae": M.mean_abs_error_by(votes, "target", "raw", "pred_i"),
        "vote_rmse": votes.groupBy("target").agg(F.sqrt(F.avg(F.pow(F.col("raw") - F.col("pred_i"), 2)))
                                                 .alias("rmse"), F.count(F.lit(1)).alias("n")),
        "model": model,
    }


# ------------------------------------------------------------------------- E2, E3

VOTES = ("useful", "funny", "cool")
# fixed values: the regressor's settings
BOOST = {"maxDepth": 6, "stepSize": 0.1, "minSplitLoss": 0.85}


def review_tokens(reviews: DataFrame, lemma_lexicon: DataFrame | None = None) -> DataFrame:
    """Cleaned, deduplicated reviews: _key, label (stars from 0), the votes, tokens
    without the extra stop words, lemmatised when the lexicon is given."""
    d = _review_key(reviews).select("_key", "stars", *VOTES, X.clean_tokens_b(F.col("text"), extra=True).alias("tokens"))
    d = drop_nulls(d, ["stars", *VOTES, "tokens"])
    d = dedupe(d.withColumn("_t", F.array_join("tokens", " ")), ["_t", "stars", *VOTES]).drop("_t")
    d = cut_lineage(d, "reviews")
    if lemma_lexicon is not None:
        d = L.rewrite(d, "_key", "tokens", lemma_lexicon).join(d.drop("tokens"), "_key")
    return d.withColumn("label", shift_label("stars").cast("double"))


def _tagged(d: DataFrame, tag_lexicon: DataFrame) -> DataFrame:
    return L.annotate(d, "_key", "tokens", tag_lexicon).join(d.drop("tokens"), "_key")


def _adjusted(d: DataFrame, valence_lexicon: DataFrame) -> DataFrame:
    """Labels moved by the text's sentiment, with the counters _down and _up."""
    scored = d.join(L.sentiment(d, "_key", "tokens", valence_lexicon), "_key")
    _, _, moved, down, up = L.adjust_label(F.col("label"), "neg", "compound")
    return scored.withColumns({"label": moved.cast("double"), "_down": down, "_up": up})


def _vote_errors(pred: DataFrame) -> DataFrame:
    """(target, rmse) of the three vote counts."""
    parts = [M.regression_metrics(pred, t, f"pred_{t}").select(F.lit(t).alias("target"), "rmse") for t in VOTES]
    return reduce(DataFrame.unionByName, parts)


def tfidf_reviews(spark: SparkSession, path: str, lemma_lexicon: DataFrame | None = None,
                  tag_lexicon: DataFrame | None = None, valence_lexicon: DataFrame | None = None,
                  seed: int = 42, gbt_iter: int = 100, lr_iter: int = 2000, model_path: str | None = None) -> dict:
    """Clean -> dedupe -> extra stop words -> lemma -> TF-IDF -> LR (stars);
    boosted trees with second-order gains for the vote counts; POS-annotated and
    sentiment-adjusted variants when the lexicons are given.  Vectorisers are fitted
    on the training part only.  Every fitted pipeline is in ``models`` and, with a
    ``model_path``, saved below it (classifier, regression, classifier_pos,
    classifier_adjusted) for ``validate_reviews``."""
    d = review_tokens(read_reviews(spark, path), lemma_lexicon)
    out: dict = {"models": {}}

    def split(df):
        held = in_test("_key", seed, 20)
        return df.where(~held), df.where(held)

    def classify(name, df, C=1.0, penalty="l2", max_iter=lr_iter):
        train, test = split(df)
        vectors = TfidfVectorizer().fit(train)
        rows = cut_lineage(vectors.transform(train).select("features", "label", *VOTES), f"{name}-vectors")
        lr = ML.fit_text_classifier(rows, vectors.size()[0], C=C, penalty=penalty, max_iter=max_iter)
        out["models"][name] = PipelineModel(stages=[vectors, lr])
        return vectors, rows, M.class_report(out["models"][name].transform(test), "label", "prediction")

    vectors, rows, out["lr_report"] = classify("classifier", d)
    trees = [BoostedRegressor(labelCol=t, predictionCol=f"pred_{t}", maxIter=gbt_iter, **BOOST).fit(rows) for t in VOTES]
    out["models"]["regression"] = PipelineModel(stages=[vectors, *trees])
    out["gbt_rmse"] = _vote_errors(out["models"]["regression"].transform(split(d)[1]))
    if tag_lexicon is not None:
        *_, out["pos_report"] = classify("classifier_pos", _tagged(d, tag_lexicon))
    if valence_lexicon is not None:
        moved = cut_lineage(_adjusted(d, valence_lexicon), "adjusted")
        out["adjust_counts"] = moved.agg(F.sum("_down").alias("down"), F.sum("_up").alias("up"))
        *_, out["adjusted_report"] = classify("classifier_adjusted", moved)
    if model_path:
        for name, model in out["models"].items():
            model.write().overwrite().save(f"{model_path}/{name}")
    return out


def validate_reviews(spark: SparkSession, model_path: str, path: str, lemma_lexicon: DataFrame | None = None,
                     tag_lexicon: DataFrame | None = None, valence_lexicon: DataFrame | None = None) -> dict:
    """The saved pipelines, loaded as fitted (nothing is refitted), on held-out
    reviews: accuracy and class report of the classifier, error of each vote count,
    and the same reports for the POS and the sentiment-adjusted classifier when their
    lexicons are given."""
    d = review_tokens(read_reviews(spark, path), lemma_lexicon)

    def report(name, df):
        p = cut_lineage(PipelineModel.load(f"{model_path}/{name}").transform(df).select("_key", "label", "prediction"),
                        name)
        return {f"{name}_accuracy": M.accuracy(p, "label", "prediction"),
                f"{name}_report": M.class_report(p, "label", "prediction"), f"{name}_predictions": p}

    out = report("classifier", d)
    out["regression_rmse"] = _vote_errors(PipelineModel.load(f"{model_path}/regression").transform(d))
    if tag_lexicon is not None:
        out |= report("classifier_pos", _tagged(d, tag_lexicon))
    if valence_lexicon is not None:
        out |= report("classifier_adjusted", _adjusted(d, valence_lexicon))
    return out


# ------------------------------------------------------------------------- E4

def apply_model(df: DataFrame, make_predict_fn, input_col: str, n_classes: int | None = None,
                batch_size: int = 256, width: int | None = None) -> DataFrame:
    """Bulk inference with a user-supplied model through Arrow batches
    (``predict_batch_udf``); adds ``scores`` and, for classifiers, ``pred``.  The input
    column holds arrays of one length, ``width`` (looked up where it isn't given)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T
    if width is None:
        width = df.agg(F.max(F.size(input_col))).first()[0] or 1
    kind = T.ArrayType(T.FloatType()) if n_classes else T.FloatType()
    udf = predict_batch_udf(make_predict_fn, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[width]])
    out = df.withColumn("scores", udf(input_col))
    return out.withColumn("pred", M.argmax_index("scores")) if n_classes else out


def evaluate_model(df: DataFrame, make_predict_fn, input_col: str, target: str, n_classes: int = 5,
                   batch_size: int = 256) -> dict:
    """Score a user-supplied model and report by target.  ``stars`` (1-based classes)
    gives the class report, accuracy and mean cross-entropy; a vote count gives mse, rmse,
    mae and r2.  Rows without a label take no part."""
    df = df.where(F.col(target).isNotNull())
    if target == "stars":
        scored = apply_model(df.withColumn("label", shift_label(target)), make_predict_fn, input_col, n_classes, batch_size)
        scored = cut_lineage(scored.select("label", "pred", "scores"), "scored")     # the model runs once
        return {"class_report": M.class_report(scored, "label", "pred"), "accuracy": M.accuracy(scored, "label", "pred"),
                "loss": M.cross_entropy(scored, "scores", "label")}
    scored = apply_model(df, make_predict_fn, input_col, None, batch_size)
    return {"errors": M.regression_metrics(scored, target, "scores")}


# ------------------------------------------------------------------------- E5

def newest_encoded(spark: SparkSession, path: str, vocab: DataFrame, out_path: str | None = None,
                   n: int = 5000, max_len: int = 512, seq_col: str | None = None) -> DataFrame:
    """E5: newest n reviews -> records with defaults -> fixed-length ids -> JSON.

    Newest are the last n lines by their place in the files, read from the files' ends;
    with a ``seq_col``, the n largest of that column.  A ``vocab`` (piece, id) gives
    sub-word pieces of the cased text, one with (token, id) whole lower-case words."""
    if seq_col is None:
        raw = tail_lines(spark, path, n).select(F.col("place").cast("string").alias("_key"), F.col("value").alias("json"))
        newest = raw.select("_key", decode_with_defaults("json", REVIEW).alias("r")).select("_key", "r.*")
    else:
        raw = spark.read.text(path).select(F.col("value").alias("json"))
        rec = _review_key(raw.select(decode_with_defaults("json", REVIEW).alias("r")).select("r.*"))
        newest = tail(rec.withColumn("_tie", F.md5(F.to_json(F.struct(*rec.columns)))), n, seq_col, ["_tie"]).drop("_tie")
    if "piece" in vocab.columns:
        enc = encode_pieces(newest.select("_key", X.written_words("text").alias("tokens")), "_key", "tokens", vocab, max_len)
    else:
        enc = encode(newest.select("_key", X.split_ws(F.lower("text")).alias("tokens")), "_key", "tokens", vocab, max_len)
    out = newest.join(enc, "_key").select("stars", "useful", "funny", "cool", "text", "input_ids", "attention_mask")
    if out_path:
        write_json(out.select(encode_sorted_json(out).alias("value")), out_path)
    return out


# ------------------------------------------------------------------------- E6

def clean_flows(df: DataFrame, dialect: str = "create_model") -> DataFrame:
    """The three cleaning dialects of the flow scripts.

    * ``create_model``: strip + alias the class, null -> Benign, booleans by
      truthiness (factorising happens in ``FlowPrep`` so codes are fitted once).
    * ``lr``: exact aliases, null class -> Benign, nullable counters -> 0.
    * ``listed``: like ``create_model`` without the boolean casts.
    """
    cat = F.col("attack_cat")
    if dialect in ("create_model", "listed"):
        cat = canonicalize(strip(cat), FLOW_CLASS_ALIASES, "Benign")
        cat = F.when(cat == "", F.lit("Benign")).otherwise(cat)
    else:
        cat = canonicalize(cat, FLOW_CLASS_ALIASES, "Benign")
    out = df.withColumn("attack_cat", cat)
    if dialect == "create_model":
        out = (out.withColumn("is_ftp_login", to_bool("is_ftp_login"))
               .withColumn("is_sm_ips_ports", to_bool("is_sm_ips_ports"))
               .withColumn("Label", to_bool("Label")))
    if dialect == "lr":
        out = out.na.fill({"ct_flw_http_mthd": "0", "is_ftp_login": "0"})
    return out


TARGETS = 2          # attack_cat and Label, the last two columns


def coded_flows(df: DataFrame, dialect: str = "create_model", order_cols=("row_id",), codes: DataFrame | None = None,
                stats: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """E6 as a whole: (numeric table, codes, scaler statistics) of flow records plus the
    ``order_cols`` that say which value comes first.  Codes and statistics are fitted
    here unless those of the training records are given.

    * ``create_model``: clean, booleans as 0 / 1, the listed columns coded.
    * ``lr``: clean, every string column coded, every column but the two targets min-max.
    * ``listed``: clean, the listed columns coded and nothing else."""
    names = [c for c in df.columns if c not in order_cols]
    out = clean_flows(df, dialect)
    coded = string_columns(out.select(*names)) if dialect == "lr" else [c for c in CATEGORICAL if c in names]
    if codes is None:
        codes = fit_factorize(out, coded, list(order_cols))
    out = apply_factorize(out, codes, coded)
    if dialect == "create_model":
        flags = [c for c, t in out.dtypes if t == "boolean" and c not in order_cols]
        out = out.withColumns({c: F.col(c).cast("int") for c in flags})
    if dialect == "lr":
        features = select_by_position(out.select(*names), stop=-TARGETS).columns
        out = out.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features], *names[-TARGETS:], *order_cols)
        stats = stats or fit_scaler(out, features)
        out = minmax_scale(out, features, stats)
    return out.select(*[F.col(f"`{c}`") for c in names], *order_cols), codes, stats or {}


CATEGORICAL = ["srcip", "sport", "dstip", "dsport", "proto", "state", "service",
               "ct_flw_http_mthd", "ct_ftp_cmd", "attack_cat"]


@dataclass
class FlowPrep:
    """Fitted preprocessing (M16): factor codes, scaler statistics, family.
    ``scaler`` is minmax, standard or none; ``pca`` reduces the vectors, if given."""
    family: str
    features: list
    codes: DataFrame
    stats: dict = field(default_factory=dict)
    order_cols: list = field(default_factory=list)
    scaler: str = "none"
    pca: object = None

    def save(self, path: str) -> None:
        """Codes as a Parquet table, the rest as one JSON row."""
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        meta = json.dumps([self.family, self.features, self.stats, self.order_cols, self.scaler, self.pca is not None])
        self.codes.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/meta")
        if self.pca is not None:
            self.pca.write().overwrite().save(f"{path}/pca")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FlowPrep":
        *about, reduced = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        family, features, stats, order_cols, scaler = about
        pca = PipelineModel.load(f"{path}/pca") if reduced else None
        return cls(family, features, spark.read.parquet(f"{path}/codes"), stats, order_cols, scaler, pca)

    def transform(self, df: DataFrame) -> DataFrame:
        cats = [c for c in CATEGORICAL if c in df.columns]
        out = apply_factorize(df, self.codes, cats)
        for b in ("is_ftp_login", "is_sm_ips_ports", "Label"):
            if b in out.columns:
                out = out.withColumn(b, to_bool(b).cast("int"))
        # nulls left after cleaning become 0, as the flow dialects fill them
        num = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.features]
        out = out.select(*num, F.col("attack_cat").cast("double").alias("attack_cat"),
                         F.col("Label").cast("double").alias("Label"), *self.order_cols)
        if self.scaler == "minmax":
            out = out.select(*[minmax_expr(c, self.stats[c]["min"], self.stats[c]["max"]).alias(c)
                               for c in self.features], "attack_cat", "Label", *self.order_cols)
        elif self.scaler == "standard":
            out = out.select(*[standard_expr(c, self.stats[c]["mean"], self.stats[c]["std"]).alias(c)
                               for c in self.features], "attack_cat", "Label", *self.order_cols)
        out = VectorAssembler(inputCols=self.features, outputCol="features").transform(out)
        if self.pca is not None:
            out = self.pca.transform(out).drop("features", "_centred").withColumnRenamed("pca", "features")
        return out


SCALERS = {"lr": "minmax", "knn": "standard", "rf": "none", "tree": "none"}


def fit_flow_prep(train: DataFrame, family: str, order_cols: list, scaler: str | None = None,
                  reduce_dimensions: bool = False, components: int = 10) -> FlowPrep:
    """Feature set by family (lr: 15 min-max; knn: 47 standardised; rf: 17 raw;
    tree: 47 raw), factor codes fitted on the training rows only (D7).
    ``reduce_dimensions`` gives knn its principal components and the tree 15 columns;
    ``scaler`` overrides the family's."""
    feats = {"lr": FEATURE_SETS["feat15"], "knn": FLOW_FEATURES, "rf": FEATURE_SETS["rf17"],
             "tree": FEATURE_SETS["feat15"] if reduce_dimensions else FLOW_FEATURES}[family]
    scaler = scaler or SCALERS[family]
    cats = [c for c in CATEGORICAL if c in train.columns]
    codes = fit_factorize(train, cats, order_cols)
    prep = FlowPrep(family, list(feats), codes, order_cols=list(order_cols), scaler=scaler)
    if scaler != "none":
        base = FlowPrep(family="raw", features=list(feats), codes=codes, order_cols=list(order_cols))
        prep.stats = fit_scaler(base.transform(train), list(feats))
    if reduce_dimensions and family == "knn":
        prep.pca = ML.pca_pipeline(components).fit(prep.transform(train))
    return prep


# ------------------------------------------------------------------------ E7-E10

def _balance(df: DataFrame, label: str, key: str, sample: str, samples: int, features: list):
    """F7 then F8 (chained, D8) on a prepared flow table."""
    if sample in ("under", "both"):
        classes = [r[0] for r in df.select(label).distinct().limit(M.MAX_CLASSES + 1).collect()]
        if len(classes) > M.MAX_CLASSES:
            raise ValueError("too many classes to under-sample")
        df = undersample(df, key, label, {c: samples for c in classes})
    if sample in ("smote", "both"):
        arr = df.select(key, label, vector_to_array("features").alias("vec"))
        o = oversample(arr, key, "vec", label)
        df = o.select(F.col("label").alias(label), array_to_vector("vec").alias("features"))
    return df


def lr_flows(df: DataFrame, target: str = "Label", order_cols=("row_id",), sample: str = "none",
             samples: int = 100_000, seed: int = 21) -> dict:
    """LR on 15 min-max features for Label or attack_cat."""
    key = order_cols[0]
    d = df.withColumn("is_test", in_test(key, seed, 20))
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    prep = fit_flow_prep(train, "lr", list(order_cols))
    tr = _balance(prep.transform(train), target, key, sample, samples, prep.features)
    m = ML.logistic_regression(tr.count(), max_iter=10000, label=target).fit(tr)
    p = m.transform(prep.transform(test))
    return {"accuracy": M.accuracy(p, target, "prediction"),
            "class_report": M.class_report(p, target, "prediction"),
            "confusion": M.confusion(p, target, "prediction")}


def forest_flows(df: DataFrame, target: str = "Label", order_cols=("row_id",), n_features: int = 18,
                 use_correlation: bool = True, folds: int = 0, seed: int = 21) -> dict:
    """Forest on the features most correlated (or co-varying) with the target."""
    key = order_cols[0]
    held = in_test(key, seed, 20)
    prep = fit_flow_prep(df.where(~held), "knn", list(order_cols), scaler="none")   # codes of the training rows
    coded = prep.transform(df).withColumn("is_test", held)
    others, seen = list(FLOW_FEATURES), coded.where(~F.col("is_test"))
    score = corr_with_target(seen, others, target) if use_correlation else \
        cov_with_target(seen, others, target)
    col = "corr" if use_correlation else "cov"
    chosen = [r["feature"] for r in top_n(score.where(F.col(col).isNotNull()), col, n_features)
              .collect()]
    va = VectorAssembler(inputCols=chosen, outputCol="feat_sel")
    data = va.transform(coded)
    rf = ML.random_forest(n_trees=100, max_depth=None, features="feat_sel", label=target)
    m = rf.fit(data.where(~F.col("is_test")))
    p = m.transform(data.where(F.col("is_test")))
    out = {"features": chosen, "accuracy": M.accuracy(p, target, "prediction"),
           "class_report": M.class_report(p, target, "prediction")}
    if folds:
        out["cv"] = ML.fold_scores(data, rf, key, target, k=folds)
    return out


def knn_flows(df: DataFrame, target: str = "attack_cat", order_cols=("row_id",), k: int = 5,
              pca_k: int = 10, seed: int = 0) -> dict:
    """Min-max -> split 70/30 -> PCA(10) fitted on train -> exact kNN ->
    macro/micro precision and class report."""
    key = order_cols[0]
    d = df.withColumn("is_test", in_test(key, seed, 30))
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    prep = fit_flow_prep(train, "knn", list(order_cols), scaler="minmax")
    pca = ML.pca_pipeline(pca_k).fit(prep.transform(train))
    tr = pca.transform(prep.transform(train)).select(
        F.col(key).alias("id"), vector_to_array("pca").alias("vec"), F.col(target).alias("label"))
    te = pca.transform(prep.transform(test)).select(
        F.col(key).alias("qid"), vector_to_array("pca").alias("vec"), F.col(target).alias("truth"))
    nbrs = knn_tree(tr, te.select("qid", "vec"), k)         # few dimensions: the tree skips most blocks
    pred = vote(nbrs, tr.select("id", "label"), weighted=False).join(te.select("qid", "truth"), "qid")
    return {"precision": M.macro_micro_precision(pred, "truth", "pred"),
            "class_report": M.class_report(pred, "truth", "pred")}


def with_row_digest(df: DataFrame) -> DataFrame:
    """A key that depends on the record alone, not on the file layout."""
    return df.withColumn("row_id", F.sha2(F.to_json(F.struct(*df.columns)), 256))


@dataclass
class FlowModel:
    """A fitted flow classifier with its preprocessing: an MLlib model, or for
    ``knn`` the training vectors (id, vec, label)."""
    prep: FlowPrep
    target: str
    model: object
    k: int = 5

    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, target, prediction) of flow records."""
        d = self.prep.transform(df)
        if self.prep.family != "knn":
            return self.model.transform(d).select("row_id", self.target, "prediction")
        q = d.select(F.col("row_id").alias("qid"), vector_to_array("features").alias("vec"), self.target)
        search_ = knn if self.prep.pca is None else knn_tree          # few dimensions: blocks can be skipped
        votes = vote(search_(self.model, q.select("qid", "vec").dropDuplicates(["qid"]), self.k),
                     self.model.select("id", "label"))
        return q.join(votes, "qid").select(F.col("qid").alias("row_id"), self.target,
                                           F.col("pred").cast("double").alias("prediction"))

    def save(self, path: str) -> None:
        """Preprocessing and model below one folder."""
        self.prep.save(f"{path}/prep")
        if self.prep.family == "knn":
            self.model.write.mode("overwrite").parquet(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark = self.prep.codes.sparkSession
        spark.createDataFrame([(self.target, self.k)], "target string, k int").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FlowModel":
        prep, about = FlowPrep.load(spark, f"{path}/prep"), spark.read.json(f"{path}/about").first()
        if prep.family == "knn":
            model = spark.read.parquet(f"{path}/model")
        else:
            model = {"lr": LogisticRegressionModel, "rf": RandomForestClassificationModel,
                     "tree": DecisionTreeClassificationModel}[prep.family].load(f"{path}/model")
        return cls(prep, about["target"], model, about["k"])


def train_flow_model(df: DataFrame, family: str = "rf", target: str = "Label", k: int = 5, sample: str = "none",
                     samples: int = 100_000, reduce_dimensions: bool = False) -> FlowModel:
    """Fit the family's preprocessing and model on cleaned records with ``row_id``."""
    prep = fit_flow_prep(df, family, ["row_id"], reduce_dimensions=reduce_dimensions)
    t = prep.transform(df)
    if sample != "none":
        t = _balance(t, target, "row_id", sample, samples, prep.features)
    if family == "knn":
        # equal records keep a vote each: the stored row number tells them apart
        ids = F.concat_ws(":", F.col("row_id") if "row_id" in t.columns else F.lit("new"),
                          F.monotonically_increasing_id().cast("string"))
        rows = t.select(ids.alias("id"), vector_to_array("features").alias("vec"), F.col(target).alias("label"))
        return FlowModel(prep, target, cut_lineage(rows, "knn-train"), k)
    if family == "lr":
        est = ML.logistic_regression(t.count(), max_iter=1000, label=target)
    elif family == "rf":
        est = ML.random_forest(n_trees=10, max_depth=30, label=target)
    else:
        est = ML.decision_tree(max_depth=30, label=target)
    return FlowModel(prep, target, est.fit(t), k)


def validate_saved(spark: SparkSession, model_path: str, heldout_path: str) -> dict:
    """Load a saved model and report on a held-out file."""
    m = FlowModel.load(spark, model_path)
    rows, issues = read_flows_checked(spark, heldout_path)
    p = m.predict(with_row_digest(clean_flows(rows)))
    return {"class_report": M.class_report(p, m.target, "prediction"),
            "accuracy": M.accuracy(p, m.target, "prediction"), "issues": issue_counts(issues)}


def train_and_validate(spark: SparkSession, train_path: str, heldout_path: str, family: str = "rf",
                       target: str = "Label", sample: str = "none", samples: int = 100_000) -> dict:
    """Fit the family's preprocessing and model (lr, rf, tree or knn) on the
    training file, then score the held-out file with the same fitted pieces."""
    rows, issues = read_flows_checked(spark, train_path)
    held, more = read_flows_checked(spark, heldout_path)
    tr, ho = with_row_digest(clean_flows(rows)), with_row_digest(clean_flows(held))
    p = train_flow_model(tr, family, target, sample=sample, samples=samples).predict(ho)
    return {"class_report": M.class_report(p, target, "prediction"),
            "accuracy": M.accuracy(p, target, "prediction"), "issues": issue_counts(issues.unionByName(more))}


# fixed values: the original searches (100 draws, 108 points).  MLlib has no least size of
# a node to split, so the grid varies the bins instead, and depths end at its limit of 30
TUNE_SPACE = {"numTrees": [20, 51, 82, 113, 144, 175, 206, 237, 268, 300], "maxDepth": [10, 20, 30],
              "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["log2", "sqrt", "all"],
              "bootstrap": [True, False]}
TUNE_GRID = {"numTrees": [30, 100, 200], "maxDepth": [5, 10, 20, 30], "minInstancesPerNode": [1, 2, 3],
             "maxBins": [32, 64, 128]}


def tune_forest(df: DataFrame, features: list, target: str, key: str, head_rows: int | None = None,
                seed: int = 42, space: dict | None = None, grid: dict | None = None, draws: int = 100,
                folds: int = 3, base_trees: int = 10) -> dict:
    """Baseline vs randomised vs grid-searched forest regressor, scored by the
    MAPE-style score (A12) on a held-out part, with improvement in percent (A16), and
    every search's score per (parameters, fold).  All rows take part unless
    ``head_rows`` asks for the first by ``key``; the search sizes are parameters."""
    spark = df.sparkSession
    d = df if head_rows is None else head(df, head_rows, key)
    d = VectorAssembler(inputCols=features, outputCol="features").transform(d)
    d = d.withColumn("is_test", in_test(key, seed, 20))
    train, test = cut_lineage(d.where(~F.col("is_test")), "tune-train"), cut_lineage(d.where(F.col("is_test")), "tune-test")

    def score(model):
        return M.mape_score(model.transform(test), target, "prediction").first()["score"]

    est = ML.random_forest_regressor(label=target)
    variants = {"random": random_maps(est, space or TUNE_SPACE, draws, seed), "grid": grid_maps(est, grid or TUNE_GRID)}
    rows, folds_of = [("baseline", score(ML.random_forest_regressor(n_trees=base_trees, label=target).fit(train)))], {}
    for name, maps in variants.items():
        # regression has no classes to share out: folds by the key's hash alone
        found = search(train.withColumn("_one", F.lit(1)), est, maps, key, target, folds, seed, "mape", strata="_one")
        rows.append((name, score(found.best_model)))
        folds_of[name] = found.scores
    out = spark.createDataFrame(rows, "variant string, score double")
    out = out.withColumn("improvement_pct", M.improvement_pct(F.lit(rows[0][1]), F.col("score")))
    return {"variants": out, "random_folds": folds_of["random"], "grid_folds": folds_of["grid"]}
