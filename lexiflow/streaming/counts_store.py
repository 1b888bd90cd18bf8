"""Additive counts of a stream, kept as a snapshot and a few newer deltas.

A micro-batch writes its own counts (``delta/batch_id=<n>``, overwritten by a retry).
After every ``compact_every`` batches the snapshot and the deltas are summed into a
new snapshot.  Which snapshot counts, and up to which batch, is said by the newest
file of ``versions``; such a file is created in one step and never changed, so a
reader sees the old state or the new one.  A batch at or below that mark is not
written again: a replay counts once, whenever it comes.  A reader meets one snapshot
and at most ``compact_every`` deltas, however many batches there were."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Files:
    """Listing, creating and deleting below one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self._path(os.path.join(self.root, folder))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def create(self, name: str, text: str) -> None:
        """Write a small file aside and rename it: it appears whole, and never over another."""
        aside, path = (self._path(os.path.join(self.root, x)) for x in (name + ".new", name))
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(path.getParent())
        if self.fs.exists(path) or not self.fs.rename(aside, path):
            raise FileExistsError(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(os.path.join(self.root, name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(os.path.join(self.root, name)), True)


class CountsStore:
    """Sums of ``value`` by ``keys`` over all batches written."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], value: str = "cnt", compact_every: int = 16):
        self.spark, self.root, self.keys, self.value = spark, root, keys, value
        self.compact_every = compact_every
        self.files = _Files(spark, root)

    def _state(self) -> tuple[int, str | None, int]:
        """(version, snapshot, last batch in it)."""
        names = [n for n in self.files.names("versions") if n.endswith(".json")]
        if not names:
            return 0, None, -1
        d = json.loads(self.files.read(f"versions/{names[-1]}"))
        return d["version"], d["snapshot"], d["upto"]

    def _deltas(self, after: int) -> list[int]:
        found = [int(n.split("=")[1]) for n in self.files.names("delta") if n.startswith("batch_id=")]
        return sorted(b for b in found if b > after)

    def inputs(self) -> list[str]:
        """The folders a reader meets now."""
        _, snapshot, upto = self._state()
        return [x for x in [snapshot] if x] + [f"delta/batch_id={b}" for b in self._deltas(upto)]

    def read(self, schema: str | None = None) -> DataFrame:
        """keys and value; without any batch an empty table needs the ``schema``."""
        paths = [os.path.join(self.root, p) for p in self.inputs()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # each folder is a table of its own, so that batch_id isn't taken for a column
        parts = [self.spark.read.parquet(p) for p in paths]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.groupBy(*self.keys).agg(F.sum(self.value).cast("bigint").alias(self.value))

    def write_batch(self, counts: DataFrame, batch_id: int) -> None:
        """Add a batch's counts, once."""
        _, _, upto = self._state()
        if batch_id <= upto:
            return
        counts.select(*self.keys, self.value).write.mode("overwrite").parquet(
            os.path.join(self.root, f"delta/batch_id={batch_id}"))
        if len(self._deltas(upto)) >= self.compact_every:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Sum what is there into the next snapshot and switch to it; the state before the
        switch stays for readers that have begun, older ones go."""
        version, snapshot, before = self._state()
        merged = [b for b in self._deltas(before) if b <= upto]
        new = f"snapshot/v={version + 1}"
        self.read().write.mode("overwrite").parquet(os.path.join(self.root, new))
        mark = json.dumps({"version": version + 1, "snapshot": new, "upto": upto, "merged": merged, "old": snapshot})
        self.files.create(f"versions/{version + 1:012d}.json", mark)
        last = f"versions/{version:012d}.json"
        if version and last.split("/")[1] in self.files.names("versions"):
            gone = json.loads(self.files.read(last))
            for name in [gone["old"], *(f"delta/batch_id={b}" for b in gone["merged"])]:
                if name:
                    self.files.delete(name)
            self.files.delete(f"versions/{version - 1:012d}.json")
