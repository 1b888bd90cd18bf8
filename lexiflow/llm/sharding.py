"""Sharding by fixed virtual slots, in DataFrame functions only.

Records hash into a fixed number of virtual slots by their text, so equal texts
share a slot.  One hash aggregation sums the bytes of each slot (two numbers per
slot leave a task).  A versioned map gives each slot a shard.  Version 1 deals the
slots in turn; every change after it is an edit that is stored as the next version:

* rebalancing: the largest slots first, each to the least loaded shard;
* splitting: while a shard is more than ``slack`` over its fair share, its slots
  heavier than the slack -- a text that holds a large part of all bytes -- are split by
  the record id and the map is rebalanced (a single record stays whole);
* growing: slots move from loaded shards into new ones and nowhere else.

The map is a table in the shared folder, one row per (version, slot); rows are sharded
by the version read back from it.  It is bounded by the number of slots: rows look it
up as a constant, and get their place in the shard from a range exchange on
(shard, slot, id) of a few numbers per row; no task holds a shard."""

from __future__ import annotations

import heapq
import os
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..session import Scratch, ensure_checkpoint_dir
from .common import constant_array, table

LAW = "bytes"
SLACK = 0.01


@dataclass
class SlotMap:
    """Slot -> shard with a version.  ``split[s]`` is the first of the ``parts``
    slots that replace slot s, or -1."""

    slots: int
    n_shards: int
    shard: list[int]
    weight: list[int]
    split: list[int] = field(default_factory=list)
    parts: int = 64
    version: int = 1

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, w in zip(self.shard, self.weight):
            out[s] += w
        return out

    def grown(self, n_shards: int) -> "SlotMap":
        """The next version, with more shards: new ones take slots from the most
        loaded old ones, heaviest slot that still fits first; no other slot moves."""
        shard, loads = list(self.shard), self.loads() + [0] * (n_shards - self.n_shards)
        share = sum(loads) / n_shards
        by_shard: dict[int, list[int]] = {}
        for s in sorted(range(len(shard)), key=lambda s: self.weight[s]):
            by_shard.setdefault(shard[s], []).append(s)
        for new in range(self.n_shards, n_shards):
            old = [(-loads[o], o) for o in range(self.n_shards)]
            heapq.heapify(old)
            while old and loads[new] < share:
                load, o = heapq.heappop(old)
                fits = [s for s in by_shard.get(o, []) if self.weight[s] <= share - loads[new]]
                if -load <= share or not fits:
                    continue
                s = fits[-1]
                by_shard[o].remove(s)
                shard[s] = new
                loads[o] -= self.weight[s]
                loads[new] += self.weight[s]
                heapq.heappush(old, (-loads[o], o))
        return SlotMap(self.slots, n_shards, shard, self.weight, self.split, self.parts, self.version + 1)

    def store(self, spark, path: str) -> "SlotMap":
        """Write this version beside the others; versions are never changed."""
        split = [*self.split, *[-1] * (len(self.shard) - len(self.split))]
        slot = F.col("slot").cast("int")
        about = spark.range(len(self.shard)).withColumnRenamed("id", "slot").select(
            slot.alias("slot"), F.get(constant_array(self.shard, "array<int>"), slot).alias("shard"),
            F.get(constant_array(self.weight, "array<bigint>"), slot).alias("bytes"),
            F.get(constant_array(split, "array<int>"), slot).alias("split"), F.lit(self.slots).alias("slots"),
            F.lit(self.n_shards).alias("n_shards"), F.lit(self.parts).alias("parts"))
        about.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")
        return self

    @classmethod
    def load(cls, spark, path: str, version: int | None = None) -> "SlotMap":
        """A stored version, by default the newest."""
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).orderBy("slot").collect()      # a row a slot
        split = [r["split"] for r in rows]
        slots = rows[0]["slots"]
        return cls(slots, rows[0]["n_shards"], [r["shard"] for r in rows], [r["bytes"] for r in rows],
                   split[:slots] if max(split) >= 0 else [], rows[0]["parts"], version)

    def edited(self, shard: list[int], weight: list[int], split: list[int] | None = None) -> "SlotMap":
        return SlotMap(self.slots, self.n_shards, shard, weight, self.split if split is None else split, self.parts,
                       self.version + 1)


def assign(weights: list[int], n_shards: int) -> list[int]:
    """Heaviest slot first, each to the least loaded shard."""
    shard, heap = [0] * len(weights), [(0, i) for i in range(n_shards)]
    for s in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        load, i = heapq.heappop(heap)
        shard[s] = i
        heapq.heappush(heap, (load + weights[s], i))
    return shard


def _weights(rows: DataFrame, slot, n: int) -> list[int]:
    out = [0] * n
    for r in rows.groupBy(slot.alias("s")).agg(F.sum("size").alias("w")).collect():
        out[r["s"]] = r["w"]
    return out


def slot_of(m: SlotMap):
    """The final slot of a row with ``base_slot`` and ``id``."""
    if not m.split:
        return F.col("base_slot")
    start = F.get(constant_array(m.split, "array<int>"), F.col("base_slot"))
    return F.when(start < 0, F.col("base_slot")).otherwise(
        start + F.pmod(F.xxhash64("id"), F.lit(m.parts)).cast("int"))


def build_map(rows: DataFrame, slots: int, n_shards: int, path: str, parts: int = 64, slack: float = SLACK) -> SlotMap:
    """The map for rows (id, size, base_slot), every version stored below ``path``."""
    spark = rows.sparkSession
    m = SlotMap(slots, n_shards, [s % n_shards for s in range(slots)], [0] * slots, [], parts).store(spark, path)
    weights = _weights(rows, F.col("base_slot"), slots)
    m = m.edited(assign(weights, n_shards), weights).store(spark, path)
    most = (1 + slack) * sum(weights) / n_shards
    while True:
        loads, split = m.loads(), m.split or [-1] * slots
        heavy = [s for s in range(slots) if split[s] < 0 and loads[m.shard[s]] > most
                 and m.weight[s] > slack * sum(weights) / n_shards]
        if not heavy:
            return m
        split, n = list(split), len(m.weight)
        for s in heavy:
            split[s], n = n, n + parts
        m = m.edited([0] * n, [0] * n, split)
        m.weight = _weights(rows, slot_of(m), n)
        m.shard = assign(m.weight, n_shards)
        m.store(spark, path)


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_shards: int = 8,
               slots: int = 4096, map_path: str | None = None) -> DataFrame:
    """One row per input row: the id, size (UTF-8 bytes and 1), text_crc32, law,
    shard, slot (place in the shard, gapless from 0), grown_shard (null under this
    law), virtual_slot and map_version.  The newest map below ``map_path`` is used; where
    there is none, or without a path, the map is built and stored.

    A null text has the size 1 and shares a slot with the empty text; repeated
    rows each take a place; null ids are one id; an empty table gives an empty
    result.  Other columns are not read."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("base_slot")), "rows")
    spark = docs.sparkSession
    path = map_path or os.path.join(ensure_checkpoint_dir(spark), f"slot-map-{uuid.uuid4().hex}")
    try:
        m = SlotMap.load(spark, path)
    except AnalysisException:                         # no map yet
        build_map(rows, slots, n_shards, path)
        m = SlotMap.load(spark, path)
    placed = (rows.withColumn("virtual_slot", slot_of(m))
              .withColumn("shard", F.get(constant_array(m.shard, "array<int>"), F.col("virtual_slot"))))
    ranked = rank_within(placed, ["shard"], ["virtual_slot", "id", "text_crc32", "size"], "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         "virtual_slot", F.lit(m.version).alias("map_version"))


def op4_virtual_slots(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
