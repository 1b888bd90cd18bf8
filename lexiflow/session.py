"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans shuffles at runtime, coalesces
# small partitions and splits skewed join partitions; Arrow batches Python data.
# The planner never broadcasts on its own estimates (an exploded or filtered
# table can be far larger than the file it came from): only our size-checked
# broadcast hints are planned, and AQE converts a join to a broadcast join
# only from the measured size of a finished shuffle stage.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lexiflow", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", memory))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system); only a local-mode session gets a fresh scratch folder here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="lexiflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Owner of the intermediate Parquet tables of one computation.

    ``cut`` writes a table below the shared checkpoint folder and returns the
    re-read table (survives executor loss, unlike a local checkpoint); ``drop``
    deletes tables no returned plan reads any more; ``release`` deletes the
    rest once their readers are done.  Every owner of a session is also
    released by ``release_scratch``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = ensure_checkpoint_dir(spark)
        self.tables: dict[int, str] = {}
        _OWNERS.append(self)

    def cut(self, df, name: str = "table"):
        path = os.path.join(self.base, f"{name}-{uuid.uuid4().hex}")
        df.write.mode("overwrite").parquet(path)
        # the written schema is known: no schema inference job, and an empty table still reads
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = path
        table._scratch_path = path
        return table

    def drop(self, *tables):
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path and self.tables.pop(id(t), None):
                _delete(self.spark, path)

    def release(self):
        for path in self.tables.values():
            _delete(self.spark, path)
        self.tables.clear()


_OWNERS: list[Scratch] = []


def _delete(spark, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this session still owns; call when the
    results that read them have been written or collected."""
    for owner in _OWNERS:
        if owner.spark is spark:
            owner.release()
    _OWNERS[:] = [o for o in _OWNERS if o.spark is not spark]


def cut_lineage(df, name: str = "table"):
    """Materialise ``df`` as a Parquet table in a fresh folder under the shared
    checkpoint folder and return the re-read table (owned by the session:
    ``release_scratch`` deletes it)."""
    return Scratch(df.sparkSession).cut(df, name)
