"""Exact k-nearest neighbours by block products.

In many dimensions no bound on distances prunes anything, so the work is every
query against every training row of its group; what matters is the shape of it:

1. Training rows and query rows fall into blocks of bounded size by the hash of
   their id, inside their group; a group gets as many blocks as its size asks for.
2. Every query block meets every training block of its group in an equi-join on
   (group, training block): one row per pair of blocks, not per pair of rows.
   The pairs of a hot group spread over all tasks.
3. A pair of blocks is one matrix product in an Arrow batch (``|q|^2 - 2 q.t +
   |t|^2``), cut to the block's k best before anything leaves the task; the
   kept candidates get their distance from the coordinates' differences.
4. The k best of a query over its blocks: at most k rows per training block,
   ranked in salted sub-groups first.

Distances are squared Euclidean in double precision, rounded to 9 decimals;
order is (d2, train id), so ties are deterministic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ranking import top_k_per_group

TRAIN_BLOCK, QUERY_BLOCK = 2048, 512
SLACK = 1e-6


def _blocks(df: DataFrame, group: str | None, rows_per_block: int, id_name: str, vec: str, out: str) -> DataFrame:
    """([group,] block, blocks of the group, ids and vectors): at most about
    ``rows_per_block`` rows each."""
    if group is None:                      # the number of blocks is a constant: no join
        n = max(1, -(-df.count() // rows_per_block))
        return (df.groupBy(F.pmod(F.xxhash64(id_name), F.lit(n)).alias(f"{out}_b"))
                .agg(F.collect_list(F.struct(id_name, vec)).alias(out)).withColumn(f"{out}_n", F.lit(n).cast("bigint")))
    sizes = df.groupBy(F.col(group).alias("_s")).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_block)).alias(f"{out}_n"))
    keyed = df.join(sizes, F.col(group).eqNullSafe(F.col("_s")))       # a null group is a group too
    return (keyed.withColumn(f"{out}_b", F.pmod(F.xxhash64(id_name), F.col(f"{out}_n")))
            .groupBy(group, f"{out}_b", f"{out}_n")
            .agg(F.collect_list(F.struct(id_name, vec)).alias(out)))


def _matrix(column) -> tuple[list, np.ndarray]:
    rows = column.as_py()
    return [next(iter(r.values())) for r in rows], np.array([list(r.values())[1] for r in rows], dtype=np.float64)


def _block_top(q: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """For each query the mask of training rows that can be among its k nearest."""
    near = (q * q).sum(axis=1)[:, None] - 2 * (q @ t.T) + (t * t).sum(axis=1)[None, :]
    if near.shape[1] <= k:
        return np.ones(near.shape, bool)
    edge = np.partition(near, k - 1, axis=1)[:, k - 1:k]
    scale = 1 + np.abs(near).max()
    return near <= edge + SLACK * scale


def knn(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
        qid_col: str = "qid", group_col: str | None = None, exclude_self: bool = False,
        train_block: int = TRAIN_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, rank, id, d2): the k nearest training rows of every query row.

    ``group_col`` restricts neighbours to the query's own group (SMOTE's
    within-class search); ``exclude_self`` drops the pair qid == id."""
    idt, qidt = train.schema[id_col].dataType, queries.schema[qid_col].dataType
    g = [F.col(group_col).alias("_g")] if group_col else []
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    tr = train.select(*g, F.col(id_col).alias("_tid"), vec.alias("_tv"))
    qs = queries.select(*g, F.col(qid_col).alias("_qid"), vec.alias("_qv"))
    group = "_g" if group_col else None
    tb = _blocks(tr, group, train_block, "_tid", "_tv", "t")
    qb = _blocks(qs, group, query_block, "_qid", "_qv", "q")
    same_block = F.col("t_b") == F.col("_tb")
    if group_col:
        counts = tb.select(F.col("_g").alias("_c"), "t_n").distinct()
        pairs = qb.join(counts, F.col("_g").eqNullSafe(F.col("_c"))).select("_g", "q", "t_n")
        same_block = same_block & F.col("_g").eqNullSafe(F.col("_h"))
        tb = tb.withColumnRenamed("_g", "_h")
    else:
        n_blocks = max(1, -(-tr.count() // train_block))
        pairs = qb.select("q", F.lit(n_blocks).cast("bigint").alias("t_n"))
    pairs = pairs.withColumn("t_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t_n") - 1))).drop("t_n")
    met = pairs.join(tb.withColumnRenamed("t_b", "_tb").drop("t_n"), same_block).select("q", "t")
    want = k + (1 if exclude_self else 0)
    types = [to_arrow_type(qidt), to_arrow_type(idt), pa.float64()]

    def products(batches):
        for b in batches:
            for i in range(b.num_rows):
                qid, q = _matrix(b.column(0)[i])
                tid, t = _matrix(b.column(1)[i])
                a, c = np.nonzero(_block_top(q, t, want))
                d = np.round(((q[a] - t[c]) ** 2).sum(axis=1), 9)
                best: dict[int, list] = {}
                for x, y, z in zip(a.tolist(), c.tolist(), d.tolist()):
                    if not (exclude_self and qid[x] == tid[y]):
                        best.setdefault(x, []).append((z, tid[y]))
                rows = [(qid[x], tid_, z) for x, hits in best.items() for z, tid_ in sorted(hits)[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], type=types[j]) for j in range(3)],
                    names=["_qid", "_tid", "d2"])

    hits = met.mapInArrow(products, f"_qid {qidt.simpleString()}, _tid {idt.simpleString()}, d2 double")
    top = top_k_per_group(hits, ["_qid"], [F.col("d2"), F.col("_tid")], k, salt_buckets=8,
                          salt_on=F.xxhash64("_tid"))
    return top.select(F.col("_qid").alias(qid_col), F.col("rank"), F.col("_tid").alias(id_col), "d2")


def vote(neighbors: DataFrame, train_labels: DataFrame, qid_col: str = "qid", id_col: str = "id",
         label_col: str = "label", weighted: bool = False) -> DataFrame:
    """(qid, pred): majority (or 1/d weighted) vote; if any neighbour is at
    distance 0 only those vote; ties go to the lowest label."""
    nl = neighbors.join(train_labels.select(F.col(id_col), F.col(label_col)), id_col)
    if weighted:
        has0 = F.max((F.col("d2") == 0).cast("int")).over(Window.partitionBy(qid_col))
        w = F.when(has0 == 1, F.when(F.col("d2") == 0, 1.0).otherwise(0.0)).otherwise(
            1.0 / F.sqrt(F.col("d2")))
    else:
        w = F.lit(1.0)
    s = nl.withColumn("_w", w).groupBy(qid_col, label_col).agg(F.sum("_w").alias("_s"))
    best = s.groupBy(qid_col).agg(F.max(F.struct(F.col("_s").alias("s"),
                                                 (-F.col(label_col)).alias("nl"))).alias("_b"))
    return best.select(qid_col, (-F.col("_b.nl")).alias("pred"))
