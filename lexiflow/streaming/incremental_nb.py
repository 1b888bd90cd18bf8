"""Incremental Naive Bayes (W1) and streaming scoring.

Naive Bayes statistics are sums, so a model over a growing input is the sum
of per-batch statistics.  Each micro-batch runs the same single aggregation as
the batch fit and adds it to a ``CountsStore``: a snapshot and the deltas since,
compacted as batches come, so reading costs the same after any number of batches
and a retried batch counts once.  There is no in-memory state that grows with the
vocabulary.

Scoring a stream against a static model runs the batch predict plan on every
micro-batch and appends the predictions by batch id in the same way.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import naive_bayes as nb
from ..session import ensure_checkpoint_dir
from .counts_store import CountsStore


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


KEYS = ["target", "label", "token"]


def stream_counts(stream: DataFrame, prepare, tokens_col: str, targets, out_dir: str,
                  checkpoint: str, ngram: int = 1, available_now: bool = True, compact_every: int = 16):
    """Start the W1 query: per batch, ``prepare(batch)`` -> label statistics -> the
    counts store at ``out_dir``.  Returns the StreamingQuery."""
    store = CountsStore(stream.sparkSession, out_dir, KEYS, compact_every=compact_every)

    def write_batch(batch: DataFrame, batch_id: int):
        store.write_batch(nb.label_stats(prepare(batch), tokens_col, targets, ngram), batch_id)

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The model statistics so far: (target, label, token, cnt); token NULL rows
    hold document counts per label."""
    return CountsStore(spark, out_dir, KEYS).read("target string, label string, token string, cnt bigint")


def stream_predict(stream: DataFrame, prepare, model: nb.NBModel, id_col: str, tokens_col: str,
                   out_dir: str, checkpoint: str, extra=None, carry=()):
    """Start the W2 query: score every micro-batch with a static model;
    ``carry`` columns of the prepared batch ride along with the predictions."""
    def write_batch(batch: DataFrame, batch_id: int):
        b = prepare(batch)
        p = nb.predict(model, b, id_col, tokens_col, carry=carry)
        if extra is not None:
            p = extra(p, b)
        p.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    return (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
