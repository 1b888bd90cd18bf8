"""Boosted regression trees with second-order gains (M9), on sparse or dense vectors.

Squared error: a row's gradient is prediction - label, its hessian 1.  A split of a
node is worth GL^2/(HL + reg) + GR^2/(HR + reg) - G^2/(H + reg) and is made if that
reaches ``minSplitLoss``; a leaf weighs -G/(H + reg), scaled by the step.

1. Quantile bins: the cuts of every feature's non-zero values come from one
   aggregation over the stored entries; few-valued features keep each value.  Bins
   below zero are negative, above positive; 0 is the bin of absent entries.
2. Rows are binned once and written; a row keeps its entries as two arrays.  While the
   cuts' bytes are within a bound, tasks bin their rows in place and nothing is
   shuffled; beyond it entries meet the cuts in a join and come together by row.
3. A level of a tree is one aggregation keyed (node, feature, bin) over the stored
   entries, combined map-side; a node's totals are one more cell of it.  The zero bin of a feature is the node's total less the
   others, so no pass ever touches a row's absent features.  Running sums over the bins
   of (node, feature) give the gains, and a level's best splits, one row a node, come
   to the driver.
4. Rows find their child by an expression over their arrays; after a tree the new
   predictions are written and the tree's old table goes.

The model is a table of nodes, bounded by trees x 2^depth, scored by numpy in Arrow
batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .joins import checked_broadcast

SHARED_CUTS = 4 << 20       # bytes of cuts that every Python worker gets
NODES = "tree int, node int, feature int, threshold double, value double"     # feature null: a leaf


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "weight of every tree", TypeConverters.toFloat)
    minSplitLoss = Param(Params._dummy(), "minSplitLoss", "least gain of a split", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "added to a leaf's rows", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature on each side of zero", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100,
                         maxDepth=6, stepSize=0.1, minSplitLoss=0.0, regLambda=1.0, maxBins=64)


def _entries(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the non-zero entries of a vector column, in that order."""
    kind, _, indices, values = column.flatten()
    kind = kind.to_numpy(zero_copy_only=False)
    count = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    value = values.flatten().to_numpy(zero_copy_only=False)
    index = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)       # dense: by place
    sparse = np.isin(row, np.flatnonzero(kind == 0))
    index[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    keep = value != 0
    return row[keep], index[keep], value[keep]


def _arrays(df: DataFrame, keys: list[str], features: str) -> DataFrame:
    """keys and the non-zero entries as two arrays, index and value."""
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("index", T.ArrayType(T.IntegerType())),
                        T.StructField("value", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            row, index, value = _entries(b.column(len(keys)))
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], *lists], names=out.names)

    return df.select(*keys, features).mapInArrow(run, out)


def fit_cuts(entries: DataFrame, max_bins: int) -> DataFrame:
    """(feature, below, above): the upper ends of the bins of the negative and of the
    positive values of each feature, the largest value last."""
    shares = [i / max_bins for i in range(1, max_bins + 1)]
    cuts = [F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(
        F.when(side, F.col("value")), shares, 100 * max_bins), F.array().cast("array<double>")))).alias(name)
        for name, side in (("below", F.col("value") < 0), ("above", F.col("value") > 0))]
    return entries.groupBy("feature").agg(*cuts)


def _binned_by_join(raw: DataFrame, entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """y and the entries of each row as two arrays, features and bins."""
    bins = F.when(F.col("value") > 0, F.least(F.size("above"), F.size(
        F.filter("above", lambda c: c < F.col("value"))) + 1)).otherwise(
        F.size(F.filter("below", lambda c: c < F.col("value"))) - F.size("below"))
    binned = (entries.join(checked_broadcast(cuts), "feature")
              .select("row", "feature", bins.cast("int").alias("bin")).groupBy("row")
              .agg(F.collect_list(F.struct("feature", "bin")).alias("e")))
    return raw.select("row", "y").join(binned, "row", "left").select(
        "y", F.coalesce("e.feature", F.array().cast("array<int>")).alias("features"),
        F.coalesce("e.bin", F.array().cast("array<int>")).alias("bins"))


def _binned_in_place(raw: DataFrame, cuts: DataFrame) -> DataFrame:
    """The same without a shuffle, by cuts that every task gets (bounded by the caller)."""
    ends = {r["feature"]: (np.array(r["below"], float), np.array(r["above"], float)) for r in cuts.collect()}
    shared = raw.sparkSession.sparkContext.broadcast(ends)

    def run(batches):
        ends = shared.value
        for b in batches:
            index = b.column(1).flatten().to_numpy(zero_copy_only=False)
            value = b.column(2).flatten().to_numpy(zero_copy_only=False)
            bins, order = np.zeros(len(index), np.int32), np.argsort(index, kind="stable")
            first = np.flatnonzero(np.diff(index[order], prepend=-1))
            for at in np.split(order, first[1:]) if len(order) else ():
                below, above = ends[int(index[at[0]])]
                v = value[at]
                bins[at] = np.where(v < 0, np.searchsorted(below, v) - len(below),
                                    np.minimum(len(above), np.searchsorted(above, v) + 1))
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (index, bins))],
                names=["y", "features", "bins"])

    return raw.select("y", "index", "value").mapInArrow(run, "y double, features array<int>, bins array<int>")


class BoostedRegressor(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Rows with a null label take no part; without any the model predicts 0."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100,
                 maxDepth=6, stepSize=0.1, minSplitLoss=0.0, regLambda=1.0, maxBins=64):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BoostedModel":
        spark = dataset.sparkSession
        scratch = Scratch(spark)
        labelled = dataset.select(self.getFeaturesCol(), F.col(self.getLabelCol()).cast("double").alias("y")) \
            .where(F.col("y").isNotNull())
        raw = scratch.cut(_arrays(labelled, ["y"], self.getFeaturesCol())
                          .withColumn("row", F.monotonically_increasing_id()), "boost-raw")
        entries = raw.select("row", F.inline(F.arrays_zip("index", "value")).alias("feature", "value"))
        cuts = scratch.cut(fit_cuts(entries, self.getOrDefault(self.maxBins)), "boost-cuts")
        held = cuts.agg(F.sum(16 + 8 * (F.size("below") + F.size("above")))).first()[0] or 0
        binned = _binned_in_place(raw, cuts) if held <= SHARED_CUTS else _binned_by_join(raw, entries, cuts)
        base = raw.agg(F.avg("y")).first()[0] or 0.0
        rows = scratch.cut(binned.withColumn("pred", F.lit(base)), "boost-rows")
        scratch.drop(raw)
        nodes = []
        for tree in range(self.getOrDefault(self.maxIter)):
            grown, splits, leaves = self._grow(rows, scratch)
            nodes += [(tree, n, f, t, None) for n, f, t in self._thresholds(cuts, splits)]
            nodes += [(tree, n, None, None, v) for n, v in leaves.items()]
            value = F.element_at(_table(leaves, "double"), F.col("node"))
            new = scratch.cut(grown.select("y", "features", "bins", (F.col("pred") + value).alias("pred")), "boost-rows")
            scratch.drop(rows)
            rows = new
            if not splits:                    # no split is worth it, and the mean is fitted already
                break
        scratch.drop(rows, cuts)
        return self._copyValues(BoostedModel(nodes, base))

    def _grow(self, rows: DataFrame, scratch: Scratch):
        """One tree: the rows with their leaf, the splits {node: (feature, bin)}, the leaves' weights."""
        reg, least, step = (self.getOrDefault(p) for p in (self.regLambda, self.minSplitLoss, self.stepSize))
        at, splits, open_nodes = rows.withColumn("node", F.lit(0)), {}, [0]
        g = F.col("pred") - F.col("y")
        for level in range(self.getOrDefault(self.maxDepth)):
            members = at.where(F.col("node").isin(open_nodes)).select("node", g.alias("g"), "features", "bins")
            cells = scratch.cut(_cells(members), "boost-cells")
            best = _best_splits(cells, reg).where(F.col("gain") >= least).collect()        # one row a node
            scratch.drop(cells)
            found = {r["node"]: (r["feature"], r["bin"]) for r in best}
            if not found:
                break
            splits |= found
            at = rows.withColumn("node", _walk(splits, level + 1))
            open_nodes = [2 * n + side for n in found for side in (1, 2)]
        totals = at.groupBy("node").agg(F.sum(g).alias("g"), F.count(F.lit(1)).alias("h")).collect()   # one a leaf
        return at, splits, {r["node"]: -step * r["g"] / (r["h"] + reg) for r in totals}

    @staticmethod
    def _thresholds(cuts: DataFrame, splits: dict):
        """(node, feature, largest value that goes left)."""
        wanted = sorted({f for f, _ in splits.values()})
        ends = {r["feature"]: r for r in cuts.where(F.col("feature").isin(wanted)).collect()} if wanted else {}
        for n, (f, b) in splits.items():
            below, above = ends[f]["below"], ends[f]["above"]
            yield n, f, 0.0 if b == 0 else above[b - 1] if b > 0 else below[b + len(below)]


def _table(values: dict, kind: str):
    """node -> value as a bounded constant."""
    if not values:
        return F.create_map().cast(f"map<int,{kind}>")
    return F.map_from_arrays(F.array(*[F.lit(n) for n in values]),
                             F.array(*[F.lit(v).cast(kind) for v in values.values()]))


def _walk(splits: dict, levels: int):
    """The node a row reaches from the root in so many steps."""
    features, bounds = (_table({n: s[i] for n, s in splits.items()}, "int") for i in (0, 1))

    def step(node, _):
        feature = F.element_at(features, node)
        place = F.array_position("features", feature)
        own = F.when(place > 0, F.get("bins", (place - 1).cast("int"))).otherwise(0)
        return F.when(feature.isNull(), node).otherwise(
            2 * node + F.when(own <= F.element_at(bounds, node), 1).otherwise(2))

    return F.aggregate(F.array_repeat(F.lit(0), levels), F.lit(0), step)


def _cells(level: DataFrame) -> DataFrame:
    """(node, feature, bin, g, h): sums of the gradients and counts of the rows; feature -1
    is the whole node.  ``level`` has node, g, features, bins."""
    whole = [F.concat(F.array(F.lit(x)), name).alias(name) for x, name in ((-1, "features"), (0, "bins"))]
    return (level.select("node", "g", *whole)
            .select("node", "g", F.inline(F.arrays_zip("features", "bins")).alias("feature", "bin"))
            .groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("h")))


def _best_splits(every: DataFrame, reg: float) -> DataFrame:
    """(node, feature, bin, gain): the best split of every node, ties to the smaller
    feature and bin, from the node's cells."""
    totals = every.where(F.col("feature") < 0).select("node", F.col("g").alias("tg"), F.col("h").alias("th"))
    cells = every.where(F.col("feature") >= 0)
    joined = cells.join(F.broadcast(totals), "node")          # at most 2^depth nodes
    by_feature = Window.partitionBy("node", "feature")
    whole = joined.withColumns({"zg": F.col("tg") - F.sum("g").over(by_feature),
                                "zh": F.col("th") - F.sum("h").over(by_feature),
                                "zh": F.col("th") - F.sum("h").over(by_feature)})
    run = by_feature.orderBy("bin")
    sums = whole.withColumns({"cg": F.sum("g").over(run), "ch": F.sum("h").over(run),
                              "bin_before": F.lag("bin").over(run), "bin_after": F.lead("bin").over(run)})
    # the left side of a cut after a bin takes in the zero bin when that lies below
    after = F.struct(F.col("bin").alias("bin"), (F.col("cg") + F.when(F.col("bin") > 0, F.col("zg")).otherwise(0.0))
                     .alias("lg"), (F.col("ch") + F.when(F.col("bin") > 0, F.col("zh")).otherwise(0)).alias("lh"))
    # the cut after the zero bin: once a feature, behind its last negative bin or before its first bin
    zero = F.when((F.col("bin") < 0) & (F.col("bin_after").isNull() | (F.col("bin_after") > 0)), F.struct(
        F.lit(0).alias("bin"), (F.col("cg") + F.col("zg")).alias("lg"), (F.col("ch") + F.col("zh")).alias("lh"))) \
        .when(F.col("bin_before").isNull() & (F.col("bin") > 0), F.struct(
            F.lit(0).alias("bin"), F.col("zg").alias("lg"), F.col("zh").alias("lh")))
    cut = sums.select("node", "feature", "tg", "th", F.explode(F.array_compact(F.array(after, zero))).alias("c"))
    cut = cut.select("node", "feature", "tg", "th", "c.*").where((F.col("lh") > 0) & (F.col("lh") < F.col("th")))
    rg, rh = F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")
    gain = (F.col("lg") * F.col("lg") / (F.col("lh") + reg) + rg * rg / (rh + reg)
            - F.col("tg") * F.col("tg") / (F.col("th") + reg))
    best = F.min(F.struct((-gain).alias("loss"), "feature", "bin"))
    return (cut.groupBy("node").agg(best.alias("b"))
            .select("node", "b.feature", "b.bin", (-F.col("b.loss")).alias("gain")))


class BoostedModel(Model, _BoostParams, MLReadable, MLWritable):
    """``nodes``: (tree, node, feature, threshold, value); children of n are 2n+1 and 2n+2."""

    def __init__(self, nodes=(), base: float = 0.0):
        super().__init__()
        self.nodes, self.base = sorted(nodes, key=lambda n: n[:2]), base

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = T.StructType([*dataset.schema.fields, T.StructField(self.getPredictionCol(), T.DoubleType())])
        at, base = dataset.columns.index(self.getFeaturesCol()), self.base
        trees: dict[int, dict[int, tuple]] = {}
        for tree, node, *rest in self.nodes:
            trees.setdefault(tree, {})[node] = rest
        depth = max([n.bit_length() for _, n in ((t, x + 1) for t, x, *_ in self.nodes)], default=1)
        tables = []
        for tree in trees.values():
            size = (1 << depth) - 1
            feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            for n, (f, t, v) in tree.items():
                feature[n], threshold[n], value[n] = (-1, 0, v) if f is None else (f, t, 0)
            tables.append((feature, threshold, value))

        def run(batches):
            for b in batches:
                row, index, entry = _entries(b.column(at))
                width = 1 + max([int(index.max(initial=0)), *(int(f.max(initial=0)) for f, _, _ in tables)])
                code = np.append(row * width + index, np.iinfo(np.int64).max)
                entry = np.append(entry, 0.0)
                pred, rows = np.full(b.num_rows, base), np.arange(b.num_rows)
                for feature, threshold, value in tables:
                    node = np.zeros(b.num_rows, np.int64)
                    for _ in range(depth - 1):
                        f = feature[node]
                        key = rows * width + f
                        place = np.searchsorted(code, key)
                        x = np.where(code[place] == key, entry[place], 0.0)
                        node = np.where(f < 0, node, 2 * node + 1 + (x > threshold[node]))
                    pred = pred + value[node]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred)], names=out.names)

        return dataset.mapInArrow(run, out)

    def write(self) -> MLWriter:
        return _BoostWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostReader(cls)


class _BoostWriter(MLWriter):
    def __init__(self, model: BoostedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc, extraMetadata={"base": self.model.base})
        self.sparkSession.createDataFrame(self.model.nodes, NODES).write.parquet(f"{path}/nodes")


class _BoostReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> BoostedModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        nodes = self.sparkSession.read.schema(NODES).parquet(f"{path}/nodes").collect()      # a row a node
        model = BoostedModel([tuple(r) for r in nodes], meta["base"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
