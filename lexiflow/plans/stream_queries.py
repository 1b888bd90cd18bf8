"""Registered streaming queries: the conversations table read as a file stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import naive_bayes as nb
from ..streaming.incremental_nb import read_counts, scratch_folder, stream_counts, stream_predict
from . import bindings as B


ARRIVALS = 4      # files a one-file table arrives in, so that several batches merge


def _stream(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    n_files, path = len(table.inputFiles()), f"{sf}/conversations.parquet"
    if n_files < ARRIVALS:
        path, n_files = scratch_folder(spark, "arrivals"), ARRIVALS
        table.repartition(ARRIVALS, "conv_id").write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", n_files // ARRIVALS).parquet(path)


def _prepare(batch):
    from ..functions.text import normalize_tokens_a
    from ..operators.clean import count_bucket
    from ..functions.hashing import in_test
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    d = batch.select(key.alias("key"), "role", "turn", count_bucket("turn").alias("turn_bucket"),
                     normalize_tokens_a("text").alias("tokens"))
    return d.withColumn("is_test", in_test("key", B.SEED, B.TEST_PCT))


def nb_incremental(spark, sf):
    """Token counts maintained over micro-batches (equal to the batch A3)."""
    root = scratch_folder(spark, "nb-incremental")
    q = stream_counts(_stream(spark, sf), _prepare, "tokens", B._conv_targets(),
                      os.path.join(root, "counts"), os.path.join(root, "checkpoint"), compact_every=3)
    q.awaitTermination()
    c = read_counts(spark, os.path.join(root, "counts"))
    return c.where(F.col("token").isNotNull()).select("target", "label", "token", "cnt")


def nb_stream_predict(spark, sf):
    """New turns scored against a static model as they arrive."""
    d = B._conv_docs(spark, sf)
    model = nb.fit(d.where(~F.col("is_test")), "key", "tokens", B._conv_targets())
    root = scratch_folder(spark, "nb-stream-predict")

    def with_truth(pred, b):
        truth = F.when(F.col("target") == "role", F.col("role")).otherwise(
            F.col("turn_bucket").cast("string"))
        return pred.select("key", "target", truth.alias("truth"), "pred")

    q = stream_predict(_stream(spark, sf), lambda b: _prepare(b).where(F.col("is_test")), model,
                       "key", "tokens", os.path.join(root, "pred"), os.path.join(root, "checkpoint"),
                       extra=with_truth, carry=["role", "turn_bucket"])
    q.awaitTermination()
    return spark.read.parquet(os.path.join(root, "pred")).select("key", "target", "truth", "pred")
