"""A5-A12, A15 on hand-made predictions."""

import math

from lexiflow.operators import metrics as M


def test_class_report_with_predicted_only_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")],
                               "t string, p string")
    rep = {r["class"]: r for r in M.class_report(df, "t", "p").collect()}
    assert rep["a"]["precision"] == 1.0 and rep["a"]["recall"] == 0.5
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0 and rep["c"]["support"] == 0
    assert rep["accuracy"]["f1"] == 0.5 and rep["accuracy"]["support"] == 4
    assert abs(rep["macro avg"]["recall"] - (0.5 + 0.5 + 0.0) / 3) < 1e-12


def test_confusion_keeps_zero_cells_and_shares(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "b")], "t string, p string")
    c = {(r["true_label"], r["pred_label"]): (r["n"], r["share"])
         for r in M.confusion(df, "t", "p").collect()}
    assert c == {("a", "a"): (2, 2 / 3), ("a", "b"): (1, 1 / 3), ("b", "a"): (0, 0.0),
                 ("b", "b"): (0, 0.0)}


def test_off_by_histogram_and_regression(spark):
    df = spark.createDataFrame([(1, 1), (2, 4), (5, 1), (3, 3)], "t int, p int")
    h = {r["k"]: r["pct"] for r in M.off_by_histogram(df, "t", "p").collect()}
    assert h == {0: 50.0, 1: 0.0, 2: 25.0, 3: 0.0, 4: 25.0}
    r = M.regression_metrics(df, "t", "p").first()
    assert abs(r["mse"] - (0 + 4 + 16 + 0) / 4) < 1e-12 and abs(r["mae"] - 1.5) < 1e-12


def test_cross_entropy(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([math.log(3.0), 0.0], 0)],
                               "s array<double>, y int")
    r = M.cross_entropy(df, "s", "y").first()
    assert abs(r["cross_entropy"] - (math.log(2) + math.log(4 / 3)) / 2) < 1e-12
