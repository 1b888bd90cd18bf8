"""Model-family queries (rows-only) and their invariants."""

import pytest

import __spark_entry__ as E
from conftest import SF0001
from lexiflow.plans.registry import NO_ORACLE

NAMES = [n for _m, n in NO_ORACLE]


@pytest.mark.parametrize("name", NAMES)
def test_model_query_runs(spark, name):
    rows = E.queries()[name](spark, SF0001).collect()
    assert len(rows) > 0


def test_pca_cumulative_increases(spark):
    rows = E.queries()["pca_explained"](spark, SF0001).orderBy("pc").collect()
    cum = [r["cumulative"] for r in rows]
    assert cum == sorted(cum) and cum[-1] <= 1.0 + 1e-9


def test_rfe_rounds(spark):
    rows = E.queries()["rfe_select"](spark, SF0001).orderBy("round").collect()
    assert [r["n_features"] for r in rows] == [9, 7, 5]
