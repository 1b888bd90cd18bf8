"""Exact k-nearest neighbours with a space-partition tree (M7, E9), for few dimensions.

1. Split planes: a bounded sample of the training rows (the smallest hashes of their
   ids) is cut at the median of its widest dimension, again and again.  Only the
   planes depend on the sample; every row is indexed.
2. Every training row walks to its leaf; a leaf's rows form blocks of bounded size,
   so a leaf of many equal rows spreads.  One aggregation gives each leaf its
   bounding box and number of blocks: at most ``MAX_LEAVES`` rows, which every task gets.
3. First round: a query meets the blocks of its own leaf; its k-th distance there
   bounds the search.
4. Second round: of all leaves, those whose box is no farther than the bound are
   visited; the others are skipped unread.  A visit is an equi-join on (leaf, block).
5. The k best of both rounds, ranked in salted sub-groups first.

Distances are squared Euclidean in double precision, rounded to 9 decimals; order is
(d2, train id).  In many dimensions no box is far enough: use ``neighbors.knn``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import Scratch
from .ranking import top_k_per_group

MAX_LEAVES, SAMPLE_PER_LEAF = 1 << 13, 16
LEAF_ROWS, QUERY_ROWS = 1024, 512
SLACK = 1e-8


def split_planes(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of every inner node of a complete tree; children of n are 2n+1, 2n+2."""
    n = (1 << depth) - 1
    dims, values = np.zeros(n, np.int64), np.full(n, np.inf)
    held = {0: sample}
    for node in range(n):
        rows = held.pop(node)
        if len(rows):
            dim = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            dims[node], values[node] = dim, np.median(rows[:, dim])
        left = rows[:, dims[node]] <= values[node] if len(rows) else np.empty(0, bool)
        held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
    return dims, values


def leaf_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, dims[node]] > values[node])
    return node - len(dims)


def _points(column, n_dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), n_dims)


def _with_leaf(df: DataFrame, planes, n_dims: int) -> DataFrame:
    """Adds the leaf of (id, vec)."""
    def run(batches):
        dims, values = planes.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(leaf_of(_points(b.column(1), n_dims), dims, values))], names=["id", "vec", "leaf"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, vec array<double>, leaf bigint")


class KdSearch:
    """``result``: (qid, rank, id, d2).  ``visits``: a row per group of queries and (leaf,
    block) of the second round, with the queries ``q``; ``n_leaves`` leaves have rows."""

    def __init__(self, train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
                 qid_col: str = "qid", leaf_rows: int = LEAF_ROWS, exclude_self: bool = False):
        """Query ids are distinct and vectors have one length; rows with a null id or vector
        are no neighbours and have none.  A query finds fewer than k rows only if there are
        fewer."""
        spark, scratch = train.sparkSession, Scratch(train.sparkSession)
        self.want, self.exclude_self, self.leaf_rows = k + exclude_self, exclude_self, leaf_rows
        vec = F.transform(vec_col, lambda x: x.cast("double"))
        rows = train.select(F.col(id_col).alias("id"), vec.alias("vec")).na.drop()
        asks = queries.select(F.col(qid_col).alias("id"), vec.alias("vec")).na.drop()
        self.idt, self.qidt = rows.schema["id"].dataType, asks.schema["id"].dataType
        n, n_dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
        self.n_dims = n_dims
        depth = max(0, min(MAX_LEAVES.bit_length() - 1, int(np.ceil(np.log2(max(1, n / leaf_rows))))))
        sample = (rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_LEAF << depth).select("vec")
                  .toArrow().column("vec").to_pylist())                  # bounded by MAX_LEAVES
        planes = spark.sparkContext.broadcast(split_planes(np.array(sample, np.float64).reshape(-1, n_dims), depth))
        indexed = scratch.cut(_with_leaf(rows, planes, n_dims), "kd-rows")
        corners = [f(F.get("vec", F.lit(d))).alias(f"{side}{d}")
                   for side, f in (("lo", F.min), ("hi", F.max)) for d in range(n_dims)]
        boxes = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *corners).orderBy("leaf").toPandas()
        self.n_leaves = len(boxes)                                       # at most MAX_LEAVES rows
        leaves, corner = boxes["leaf"].to_numpy(np.int64), boxes.iloc[:, 2:].to_numpy(np.float64)
        n_blocks = np.zeros(1 << depth, np.int64)
        n_blocks[leaves] = -(-boxes["n"].to_numpy(np.int64) // leaf_rows)
        shared = spark.sparkContext.broadcast((n_blocks, leaves, corner[:, :n_dims], corner[:, n_dims:]))
        self.blocks = scratch.cut(self._blocks(indexed, shared), "kd-blocks")
        scratch.drop(indexed)

        asks = scratch.cut(_with_leaf(asks, planes, n_dims).repartitionByRange("leaf", F.xxhash64("id"))
                           .sortWithinPartitions("leaf"), "kd-queries")
        first = scratch.cut(self._products(self._visits(
            asks.withColumn("bound", F.lit(float("inf"))), shared, own=True)), "kd-first")
        edge = (self._top(first, self.want).where(F.col("rank") == self.want)
                .select(F.col("qid").alias("id"), F.col("d2").alias("bound")))
        bounded = asks.join(edge, "id", "left").select("id", "vec", "leaf", F.coalesce("bound", F.lit(float("inf")))
                                                       .alias("bound"))
        self.visits = scratch.cut(self._visits(bounded.repartitionByRange("leaf", F.xxhash64("id"))
                                               .sortWithinPartitions("leaf"), shared, own=False), "kd-visits")
        self.result = self._top(first.unionByName(self._products(self.visits)), k).select(
            F.col("qid").alias(qid_col), "rank", F.col("tid").alias(id_col), "d2")

    @staticmethod
    def _top(hits: DataFrame, k: int) -> DataFrame:
        return top_k_per_group(hits, ["qid"], [F.col("d2"), F.col("tid")], k, salt_buckets=8, salt_on=F.xxhash64("tid"))

    def _blocks(self, indexed: DataFrame, shared) -> DataFrame:
        """(leaf, block, t): a leaf's rows dealt to its blocks by the hash of their id."""
        def run(batches):
            for b in batches:
                n = shared.value[0][b.column(2).to_numpy(zero_copy_only=False)]
                block = b.column(3).to_numpy(zero_copy_only=False) % n
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(block)], names=["id", "vec", "leaf", "block"])

        dealt = indexed.withColumn("h", F.xxhash64("id")).mapInArrow(
            run, f"id {self.idt.simpleString()}, vec array<double>, leaf bigint, block bigint")
        return dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct("id", "vec")).alias("t"))

    def _visits(self, asks: DataFrame, shared, own: bool) -> DataFrame:
        """(leaf, block, q) for queries (id, vec, leaf, bound): the own leaf, or every other
        leaf whose box reaches within the bound."""
        n_dims = self.n_dims
        query = pa.struct([("id", to_arrow_type(self.qidt)), ("vec", pa.list_(pa.float64())), ("bound", pa.float64())])

        def groups(points, leaf, bound):
            n_blocks, leaves, low, high = shared.value
            if own:
                for x in np.unique(leaf):
                    yield x, np.flatnonzero(leaf == x)
                return
            far = np.zeros((len(points), len(leaves)))
            for d in range(n_dims):
                x = points[:, d:d + 1]
                gap = np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d]))
                far += gap * gap
            near = (far <= bound[:, None] * (1 + SLACK) + SLACK) & (leaf[:, None] != leaves[None, :])
            for column in np.flatnonzero(near.any(axis=0)):
                yield leaves[column], np.flatnonzero(near[:, column])

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, QUERY_ROWS):
                    b = whole.slice(at, QUERY_ROWS)
                    points = _points(b.column(1), n_dims)
                    leaf, bound = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                    structs = pa.StructArray.from_arrays([b.column(0), b.column(1), b.column(3)],
                                                         names=["id", "vec", "bound"])
                    for to, members in groups(points, leaf, bound):
                        some = structs.take(pa.array(members)).to_pylist()
                        n = int(shared.value[0][to])
                        for first in range(0, n, 64):
                            blocks = list(range(first, min(n, first + 64)))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([int(to)] * len(blocks)), pa.array(blocks, pa.int64()),
                                 pa.array([some] * len(blocks), pa.list_(query))], names=["leaf", "block", "q"])

        return asks.select("id", "vec", "leaf", "bound").mapInArrow(
            run, f"leaf bigint, block bigint, q array<struct<id:{self.qidt.simpleString()},vec:array<double>,bound:double>>")

    def _products(self, visits: DataFrame) -> DataFrame:
        """(qid, tid, d2): of every block met, the k nearest within the query's bound."""
        n_dims, want, exclude = self.n_dims, self.want, self.exclude_self
        types = [to_arrow_type(self.qidt), to_arrow_type(self.idt), pa.float64()]

        def run(batches):
            for b in batches:
                for q, t in zip(b.column(0), b.column(1)):
                    qid, qv, bound = (q.values.field(i) for i in range(3))
                    tid, tv = (t.values.field(i) for i in range(2))
                    qid, tid, bound = qid.to_pylist(), tid.to_pylist(), bound.to_numpy()
                    qv, tv = _points(qv, n_dims), _points(tv, n_dims)
                    rows = []
                    for first in range(0, len(qv), 64):                  # bounded products
                        part = qv[first:first + 64]
                        d = np.round(((part[:, None, :] - tv[None, :, :]) ** 2).sum(axis=2), 9)
                        edge = bound[first:first + 64, None]
                        if d.shape[1] > want:
                            edge = np.minimum(edge, np.partition(d, want - 1, axis=1)[:, want - 1:want])
                        for i in np.flatnonzero((d <= edge).any(axis=1)):
                            hits = sorted((d[i, j], tid[j]) for j in np.flatnonzero(d[i] <= edge[i])
                                          if not (exclude and tid[j] == qid[first + i]))
                            rows += [(qid[first + i], x, y) for y, x in hits[:want]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in range(3)],
                                                     names=["qid", "tid", "d2"])

        return visits.join(self.blocks, ["leaf", "block"]).select("q", "t").mapInArrow(
            run, f"qid {self.qidt.simpleString()}, tid {self.idt.simpleString()}, d2 double")


def knn_tree(train: DataFrame, queries: DataFrame, k: int, **kw) -> DataFrame:
    """(qid, rank, id, d2): the k nearest training rows of every query row, as
    ``neighbors.knn`` gives them."""
    return KdSearch(train, queries, k, **kw).result
