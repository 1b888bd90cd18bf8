"""The space-partition tree: the same rows as brute force, most pairs of blocks unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.operators.kd_tree import KdSearch, knn_tree, leaf_of, split_planes


def brute(train, queries, k, exclude_self=False):
    for qid, q in queries:
        d = sorted((round(float(((np.array(t) - np.array(q)) ** 2).sum()), 9), i) for i, t in train
                   if not (exclude_self and i == qid))[:k]
        yield from ((qid, rank + 1, i, d2) for rank, (d2, i) in enumerate(d))


def frame(spark, rows, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} bigint, vec array<double>")


def test_planes_halve_the_rows():
    x = np.random.default_rng(1).normal(size=(4096, 3))
    counts = np.bincount(leaf_of(x, *split_planes(x, 5)), minlength=32)
    assert counts.min() >= 100 and counts.sum() == 4096


def test_equals_brute_force_and_skips_blocks(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 10)) * 8
    train = [(i, centres[i % 12] + rng.normal(size=10) * 0.3) for i in range(3000)]
    train += [(3000 + i, np.ones(10)) for i in range(900)]              # a hot point
    queries = [(i, centres[i % 12] + rng.normal(size=10) * 0.3) for i in range(40)] + [(99, np.ones(10)), (98, np.full(10, 50.))]
    search = KdSearch(frame(spark, train, "id"), frame(spark, queries, "qid"), 5, leaf_rows=128)
    got = sorted((r.qid, r["rank"], r.id, r.d2) for r in search.result.collect())
    assert got == sorted(brute(train, queries, 5))
    blocks = search.blocks.count()
    met = search.visits.select(F.explode("q")).count() + len(queries)
    skipped = 1 - met / (len(queries) * blocks)
    assert skipped > 0.7, skipped


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_few_rows_and_self(spark, n):
    rng = np.random.default_rng(n)
    train = [(i, rng.integers(0, 3, 2)) for i in range(n)]
    df = frame(spark, train, "id").unionByName(spark.createDataFrame([(77, None), (None, [1.0, 1.0])], "id bigint, vec array<double>"))
    got = knn_tree(df, df.withColumnRenamed("id", "qid"), 2, leaf_rows=4, exclude_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(brute(train, train, 2, True))
