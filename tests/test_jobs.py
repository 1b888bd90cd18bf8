"""End-to-end jobs on small hand-written review and flow files."""

import json
import os
import random

from pyspark.sql import functions as F

from lexiflow.plans import jobs as J
from lexiflow.schemas import _DOUBLE, FLOW_FEATURES, FLOW_TARGETS
from lexiflow.sources.readers import read_flows


def _reviews(path, n=300):
    rng = random.Random(5)
    good, bad = ["great", "tasty", "friendly", "love"], ["awful", "cold", "rude", "never"]
    with open(path, "w") as f:
        for i in range(n):
            stars = rng.randint(1, 5)
            words = rng.choices(good if stars >= 3 else bad, k=6) + ["the", "food", "123!"]
            rec = {"review_id": f"r{i}", "user_id": "u", "business_id": "b", "stars": stars,
                   "useful": rng.choice([0, 1, 2, 4, 5, 6]), "funny": rng.randint(0, 3),
                   "cool": rng.randint(0, 7), "text": " ".join(words), "date": f"2020-01-{i % 28 + 1:02d}"}
            if i == 0:
                rec = {}    # every field missing
            f.write(json.dumps(rec) + "\n")


def test_naive_bayes_job(spark, tmp_dir):
    p = os.path.join(tmp_dir, "reviews.json")
    _reviews(p)
    out = J.naive_bayes_reviews(spark, p, alpha_s=0.07, alpha_cuf=1e-14,
                                model_path=os.path.join(tmp_dir, "nb"))
    acc = out["accuracy"].first()["accuracy"]
    assert acc > 0.3
    assert out["off_by"].count() == 5
    assert {r["target"] for r in out["vote_mae"].collect()} == {"useful", "funny", "cool"}
    again = J.naive_bayes_reviews(spark, p, model_path=os.path.join(tmp_dir, "nb"), training=False)
    assert again["predictions"].count() == 4 * 300


def _flows(path, n=240):
    rng = random.Random(7)
    header = FLOW_FEATURES + FLOW_TARGETS
    cats = ["Generic", " Fuzzers ", "Backdoor", "Exploits", None]  # Label 0 at the top end: linearly separable
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for i in range(n):
            c = cats[i % len(cats)]
            row = []
            for name in FLOW_FEATURES:
                if name in ("srcip", "dstip"):
                    row.append(f"10.0.0.{rng.randint(1, 5)}")
                elif name in ("proto", "state", "service"):
                    row.append(rng.choice(["tcp", "udp", "-"]))
                elif name in ("is_ftp_login", "ct_flw_http_mthd"):
                    row.append("" if i % 7 == 0 else str(rng.randint(0, 1)))
                elif name in _DOUBLE:
                    base = (i % len(cats)) * 10
                    row.append(str(base + rng.random()))
                else:
                    row.append(str((i % len(cats)) * 10 + rng.randint(0, 3)))
            row.append("" if c is None else c)
            row.append("0" if c is None else "1")
            f.write(",".join(row) + "\n")


def test_flow_jobs(spark, tmp_dir):
    p = os.path.join(tmp_dir, "flows.csv")
    _flows(p)
    df = J.clean_flows(read_flows(spark, p)).withColumn("row_id", F.monotonically_increasing_id())
    cats = {r["attack_cat"] for r in df.select("attack_cat").distinct().collect()}
    assert cats == {"Generic", "Fuzzers", "Backdoors", "Benign", "Exploits"}
    df = df.cache()
    lr = J.lr_flows(df, target="Label")
    assert lr["accuracy"].first()["accuracy"] > 0.9
    kn = J.knn_flows(df, target="attack_cat", pca_k=5)
    assert kn["precision"].first()["micro_precision"] > 0.5
    res = J.train_and_validate(spark, p, p, family="rf", target="Label")
    assert res["accuracy"].first()["accuracy"] > 0.9


def test_saved_flow_models_score_alike(spark, tmp_dir):
    p = os.path.join(tmp_dir, "flows.csv")
    _flows(p, n=120)
    df = J.with_row_digest(J.clean_flows(read_flows(spark, p))).cache()
    for family in ("lr", "tree", "knn"):
        m = J.train_flow_model(df, family, "Label", k=3)
        m.save(f"{tmp_dir}/{family}")
        before = sorted(map(tuple, m.predict(df).collect()))
        after = sorted(map(tuple, J.FlowModel.load(spark, f"{tmp_dir}/{family}").predict(df).collect()))
        assert before == after and len(before) == 120
        acc = J.validate_saved(spark, f"{tmp_dir}/{family}", p)["accuracy"].first()["accuracy"]
        assert acc > 0.9


def test_review_models_are_saved_and_validated(spark, tmp_dir, monkeypatch):
    monkeypatch.setitem(J.BOOST, "maxDepth", 1)
    p, held = os.path.join(tmp_dir, "reviews.json"), os.path.join(tmp_dir, "held.json")
    _reviews(p)
    _reviews(held, 120)
    lemma = spark.createDataFrame([("tasty", "taste")], "form string, lemma string")
    tags = spark.createDataFrame([("love", "VB"), ("cold", "JJ")], "token string, tag string")
    valence = spark.createDataFrame([("great", 3.1), ("love", 3.2), ("awful", -2.0), ("rude", -2.0)],
                                    "token string, valence double")
    out = J.tfidf_reviews(spark, p, lemma, tags, valence, gbt_iter=1, lr_iter=20, model_path=f"{tmp_dir}/models")
    assert set(out["models"]) == {"classifier", "regression", "classifier_pos", "classifier_adjusted"}
    words = {r.token for r in out["models"]["classifier"].stages[0].vocabulary.collect()}
    assert "taste" in words and "tasty" not in words
    assert {"love_VB", "cold_JJ", "food_NN"} <= {
        r.token for r in out["models"]["classifier_pos"].stages[0].vocabulary.collect()}
    again = J.validate_reviews(spark, f"{tmp_dir}/models", held, lemma, tags, valence)
    d = J.review_tokens(J.read_reviews(spark, held), lemma)
    direct = out["models"]["classifier"].transform(d)
    a, b = (sorted(map(tuple, x.select("_key", "prediction").collect())) for x in (direct, again["classifier_predictions"]))
    assert a == b and len(a) > 100
    assert again["classifier_accuracy"].first()["accuracy"] > 0.3
    assert {r.target for r in again["regression_rmse"].collect()} == set(J.VOTES)
    assert again["classifier_pos_report"].count() > 3 and again["classifier_adjusted_report"].count() > 3


def test_newest_reviews_by_place_as_pieces(spark, tmp_dir):
    for name, texts in (("a.json", ["Old one", "older"]), ("b.json", ["Tasty food!", None, "un-known"])):
        with open(os.path.join(tmp_dir, name), "w") as f:
            for t in texts:
                f.write(json.dumps({"stars": 4, "text": t} if t else {}) + "\n")
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "T", "##asty", "food", "!", "un", "-", "known"]
    vocab = spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, id int")
    out = J.newest_encoded(spark, tmp_dir, vocab, f"{tmp_dir}/out", n=3, max_len=8)
    got = {r.text: (r.input_ids, sum(r.attention_mask), r.stars) for r in out.collect()}
    assert got == {"Tasty food!": ([2, 4, 5, 6, 7, 3, 0, 0], 6, 4), "un-known": ([2, 8, 9, 10, 3, 0, 0, 0], 5, 4),
                   "": ([2, 3, 0, 0, 0, 0, 0, 0], 2, 0)}
    written = [json.loads(json.loads(r.value)["value"]) for r in spark.read.text(f"{tmp_dir}/out").collect()]
    assert sorted(w["text"] for w in written) == ["", "Tasty food!", "un-known"]
    words = spark.createDataFrame([("tasty", 2), ("old", 3)], "token string, id bigint")
    by_column = J.newest_encoded(spark, tmp_dir, words, n=5, max_len=3, seq_col="stars").collect()
    assert len(by_column) == 5 and [2, 1, 0] in [r.input_ids for r in by_column]


def test_dirty_flows_are_reported(spark, tmp_dir):
    p = os.path.join(tmp_dir, "flows.csv")
    _flows(p, n=120)
    lines = open(p).read().split("\n")
    at = lines[0].split(",").index("dur")
    cells = lines[3].split(",")
    cells[at] = "1.2.3"
    lines[3] = ",".join(cells)
    lines[7] = "cut,short"
    with open(p, "w") as f:
        f.write("\n".join(lines))
    out = J.train_and_validate(spark, p, p, family="tree", target="Label")
    issues = {(r["column"], r.reason): r.n for r in out["issues"].collect()}
    assert issues["dur", "not a double"] == 2 and issues[None, "malformed"] == 2 and len(issues) == 2
    assert out["accuracy"].first()["accuracy"] > 0.9


def test_cleaning_dialects(spark, tmp_dir):
    p = os.path.join(tmp_dir, "flows.csv")
    _flows(p, n=60)
    df = read_flows(spark, p).withColumn("row_id", F.monotonically_increasing_id()).cache()
    strings = {}
    for dialect in ("create_model", "lr", "listed"):
        out, codes, stats = J.coded_flows(df, dialect)
        assert out.columns == df.columns and out.count() == 60
        strings[dialect] = {c for c, t in out.dtypes if t == "string"}
        first = codes.where("column = 'attack_cat' AND code = 0").first()["value"]
        assert first == "Generic" and {r[0] for r in out.select("attack_cat").distinct().collect()} == set(range(5))
        again = J.coded_flows(df.where("row_id % 2 = 0"), dialect, codes=codes, stats=stats)[0]
        whole = {r.row_id: r for r in out.collect()}
        assert all(whole[r.row_id] == r for r in again.collect())
        if dialect == "lr":
            low, high = out.agg(*[f(c) for f in (F.min, F.max) for c in ("dur", "sport")]).first()[0::2]
            assert (low, high) == (0.0, 1.0)
        if dialect == "create_model":
            assert {r[0] for r in out.select("Label").distinct().collect()} == {0, 1}
    assert strings["lr"] <= {"Label"} and "is_ftp_login" in strings["listed"]


def test_reduced_dimensions_and_forest_and_tuning(spark, tmp_dir):
    p = os.path.join(tmp_dir, "flows.csv")
    _flows(p, n=120)
    df = J.with_row_digest(J.clean_flows(read_flows(spark, p))).cache()
    m = J.train_flow_model(df, "knn", "Label", k=3, reduce_dimensions=True)
    m.save(f"{tmp_dir}/knn")
    again = J.FlowModel.load(spark, f"{tmp_dir}/knn")
    before, after = (sorted(map(tuple, x.predict(df).collect())) for x in (m, again))
    assert before == after and again.prep.pca is not None
    assert sum(t == q for _, t, q in before) / len(before) > 0.9
    tree = J.fit_flow_prep(df, "tree", ["row_id"], reduce_dimensions=True)
    assert len(tree.features) == 15 and len(J.fit_flow_prep(df, "tree", ["row_id"]).features) == 47
    smote = J._balance(tree.transform(df), "Label", "row_id", "both", 20, tree.features)
    assert {r["Label"]: r["count"] for r in smote.groupBy("Label").count().collect()} == {0.0: 20, 1.0: 20}
    numbers = df.select("row_id", F.col("dur").cast("double").alias("a"), F.col("sbytes").cast("double").alias("b"),
                        (F.col("dur") * 2 + 1).cast("double").alias("y"))
    tuned = J.tune_forest(numbers, ["a", "b"], "y", "row_id", space={"maxDepth": [2, 4], "numTrees": [3, 5]},
                          grid={"maxDepth": [3], "numTrees": [4, 6]}, draws=3, folds=2, base_trees=3)
    assert [r.variant for r in tuned["variants"].collect()] == ["baseline", "random", "grid"]
    assert tuned["random_folds"].count() == 6 and tuned["grid_folds"].count() == 4
    base = tuned["variants"].first()
    assert base.improvement_pct == 0.0 and base.score > 50
