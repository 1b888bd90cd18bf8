"""SMOTE over-sampling (F8, J6, U2), deterministic and exact.

Each class c with n_c < n_max receives D_c = n_max - n_c synthetic rows.
Synthetic row j (0 <= j < D_c) starts from the class's row number
``j mod n_c`` (rows numbered by id), picks its neighbour of rank
``h(id:j:n) mod min(k, n_c - 1) + 1`` among the k nearest rows of the same
class (excluding itself), and lies at ``x + lam * (nn - x)`` with
``lam = h(id:j:l) / 2^32``.  A class of one row gets no synthetic rows.

Work: one within-class kNN of the base rows of classes with a deficit (the
largest class takes no part), one distributed rank inside each class, a
replication of base rows by their share of the deficit in two levels with an
exchange between (a class of few rows against billions doesn't explode in one
task), and one join to the chosen neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash, unit_interval
from .neighbors import knn
from .ranking import rank_within


def synthesize(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5,
               chunk: int = 4096) -> DataFrame:
    """Synthetic rows only: (label, base_id, j, vec)."""
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                     F.col(label_col).alias("label"))
    sizes = base.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    sizes = sizes.withColumn("deficit", F.max("n_c").over(Window.partitionBy()) - F.col("n_c"))
    ranked = rank_within(base, ["label"], [F.col("id")], "r")
    rows = (ranked.join(sizes, "label")
            .where((F.col("deficit") > 0) & (F.col("n_c") > 1) & (F.col("r") < F.col("deficit"))))
    cnt = F.floor((F.col("deficit") - 1 - F.col("r")) / F.col("n_c")) + 1
    rows = rows.withColumn("cnt", cnt.cast("bigint"))
    parts = rows.withColumn("part", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("cnt") - 1) / chunk)))).repartition("id", "part")
    reps = parts.withColumn("i", F.explode(F.sequence(
        F.col("part") * chunk, F.least(F.col("cnt"), (F.col("part") + 1) * chunk) - 1))).drop("part", "cnt")
    reps = reps.withColumn("j", (F.col("r") + F.col("i") * F.col("n_c")).cast("bigint"))
    kk = F.least(F.lit(k), F.col("n_c") - 1)
    reps = reps.withColumn("nn_rank", (F.pmod(keyed_hash(F.col("id"), F.col("j"), "n"), kk) + 1)
                           .cast("int"))
    reps = reps.withColumn("lam", unit_interval(F.col("id"), F.col("j"), "l"))
    short = base.join(sizes.where(F.col("deficit") > 0).select("label"), "label", "left_semi")
    nb = knn(short, rows.select(F.col("id").alias("qid"), "vec", "label"), k, id_col="id",
             vec_col="vec", qid_col="qid", group_col="label", exclude_self=True)
    picked = reps.join(nb.select(F.col("qid").alias("id"), F.col("rank").alias("nn_rank"),
                                 F.col("id").alias("nn_id")), ["id", "nn_rank"])
    nn_vec = base.select(F.col("id").alias("nn_id"), F.col("vec").alias("nn_vec"))
    out = picked.join(nn_vec, "nn_id")
    new = F.zip_with("vec", "nn_vec", lambda x, y: x.cast("double")
                     + F.col("lam") * (y.cast("double") - x.cast("double")))
    return out.select("label", F.col("id").alias("base_id"), "j", new.alias("vec"))


def oversample(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5) -> DataFrame:
    """Original rows plus synthetic rows (synthetic ids are null)."""
    syn = synthesize(df, id_col, vec_col, label_col, k)
    orig = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                     F.transform(vec_col, lambda x: x.cast("double")).alias("vec"),
                     F.lit(False).alias("synthetic"))
    return orig.unionByName(syn.select(F.lit(None).cast(orig.schema["id"].dataType).alias("id"),
                                       "label", "vec", F.lit(True).alias("synthetic")))
