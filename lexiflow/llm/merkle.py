"""Merkle manifest of a dataset, in DataFrame functions only.

Every row becomes a leaf, the hash of its fields.  Leaves are ranked inside their
group; runs of two consecutive nodes hash into their parent until one node, the
group's subroot, remains; the subroots, in the order of their groups, hash into
the root the same way.

A node at level L stands at the row of its first leaf.  Over the rows in their
order, the lag and the lead column of the fixed offset 2^L, masked by the slot in
the run (left or right child) and by the run's length (one child or two), give
the node's sibling, and the first child's row hashes the parent.  A leaf's
siblings are the last ones seen at or before its row.

Runs never cross an aligned block of 2^BITS rows, so the windows are partitioned
by (group, block): one exchange serves BITS levels, a window holds 2^BITS rows
whatever the group's size, and a group of any share spreads over all tasks.  The
blocks' roots are the next round's rows (a 2^BITS-th of them), and so on; paths go
back down by equi-joins on (group, block), which a leaf's row meets in the
partitioning it already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..operators.ranking import rank_within
from ..session import Scratch
from .common import crc_of_id, table

BITS = 8
STEPS = "array<struct<slot:int,sibling:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the joined parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields) -> Column:
    """The digest of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), F.lit("-"))
                    .otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its path (slot of the own side and the
    sibling's digest, empty if the run has no other node)."""
    return F.aggregate(steps, leaf, lambda h, x: F.when(x["slot"] == 1, digest(x["sibling"], h))
                       .otherwise(digest(h, x["sibling"])))


def proof_digest(steps: Column) -> Column:
    """The digest of a path's siblings from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(steps, lambda x: x["sibling"]), ""), 256)


def _climb(nodes: DataFrame) -> DataFrame:
    """BITS levels over nodes (g, pos, n, hash; n nodes in the group): adds ``top``,
    the block's root on its first row, and ``own``, each row's path inside the block."""
    order = "OVER (PARTITION BY g, block ORDER BY pos)"
    df = nodes.selectExpr("*", f"shiftright(pos, {BITS}) AS block", "hash AS top")
    kept, paths = df.columns[:-1], []
    for level in range(BITS):
        width = 1 << level
        slot = f"shiftright(pos, {level}) & 1"
        df = df.selectExpr("*", f"lag(top, {width}) {order} AS before", f"lead(top, {width}) {order} AS after")
        df = df.selectExpr(
            *kept, f"CASE WHEN pos % {width} = 0 AND n > {width} THEN "
                   f"coalesce(IF({slot} = 1, before, after), '') END AS sibling",
            f"CASE WHEN pos % {2 * width} = 0 THEN "
            f"IF(n > {width}, sha2(concat(top, coalesce(after, '')), 256), top) END AS top")
        df = df.selectExpr(*kept, "top", f"IF(n > {width}, last(sibling, true) {order}, NULL) AS s{level}")
        kept.append(f"s{level}")
        paths.append(f"struct(CAST({slot} AS INT) AS slot, s{level} AS sibling)")
    return df.selectExpr(*nodes.columns, "block", "top", f"CAST(filter(array({', '.join(paths)}), "
                                                         f"x -> x.sibling IS NOT NULL) AS {STEPS}) AS own")


def _rounds(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """The nodes and, round by round, the roots of their blocks, down to one row a group."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tops = _climb(out[-1]).where(F.col("pos") % (1 << BITS) == 0).select(
            "g", F.col("block").alias("pos"),
            F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n"), F.col("top").alias("hash"))
        out.append(scratch.cut(tops, "tops"))
        most = (most + (1 << BITS) - 1) >> BITS
    return out


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with ``steps``: their path inside the block and their block's (above: g, block, up, ...)."""
    return (_climb(nodes).join(above, ["g", "block"])
            .withColumn("steps", F.concat("own", "up")).drop("own", "up", "block", "top"))


def _descend(scratch: Scratch, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's nodes with their whole paths; ``above`` continues the last round's row."""
    if len(rounds) == 1:
        return rounds[0].join(above.drop("block"), "g").withColumnRenamed("up", "steps")
    for nodes in reversed(rounds[1:-1]):
        above = scratch.cut(_paths(nodes, above).drop("n", "hash")
                            .withColumnsRenamed({"pos": "block", "steps": "up"}), "paths")
    return _paths(rounds[0], above)


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             fields=("doc_id", "source", "lang", "n_chars", "text"), claimed: Column | None = None) -> DataFrame:
    """One row per input row: the id, the group, leaf, claimed (the leaf of another state
    of the row, by default the leaf), steps (the path: slot and sibling per level), subroot
    and root.

    Leaves ascend by id in their group, null ids first, equal ids by leaf; repeated
    rows are leaves of their own.  A null group is a group and comes first; a null
    field differs from an empty one; a row alone in its group is its subroot, and a
    single subroot is the root; an empty table has no rows.  Other columns are not
    read."""
    scratch = Scratch(rows.sparkSession)
    leaf = leaf_hash(fields)
    leaves = scratch.cut(rows.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("hash"),
        (leaf if claimed is None else claimed).alias("claimed"),
        F.monotonically_increasing_id().alias("copy")), "leaves")     # splits rows that are all alike
    groups = scratch.cut(rank_within(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), [], ["grp"], "g"),
                         "groups")
    ranked = rank_within(leaves, ["grp"], ["id", "hash", "copy"], "pos").drop("copy")
    lookup = checked_broadcast(groups.withColumnRenamed("grp", "grp_"))
    nodes = ranked.join(lookup, F.col("grp").eqNullSafe(F.col("grp_"))).drop("grp_")
    rounds = _rounds(scratch, nodes)
    subroots = rounds[-1].select("g", F.col("hash").alias("subroot"))
    tree = _rounds(scratch, scratch.cut(subroots.crossJoin(groups.agg(F.count(F.lit(1)).alias("n"))).select(
        F.lit(0).alias("g"), F.col("g").alias("pos"), "n", F.col("subroot").alias("hash")), "subroots"))
    root = tree[-1].select("g", F.lit(0).cast("bigint").alias("block"), F.array().cast(STEPS).alias("up"),
                           F.col("hash").alias("root"))
    top = scratch.cut(_descend(scratch, tree, root).select(
        F.col("pos").alias("g"), F.lit(0).cast("bigint").alias("block"), F.col("steps").alias("up"), "root",
        F.col("hash").alias("subroot")), "top")
    return _descend(scratch, rounds, top).select(
        F.col("id").alias(id_col), F.col("grp").alias(group_col), F.col("hash").alias("leaf"), "claimed", "steps",
        "subroot", "root")


def op13_lag_lead_merkle(spark, sf_dir: str) -> DataFrame:
    one_more = F.col("n_chars") + F.when(crc_of_id("doc_id") % 7 == 0, 1).otherwise(0)
    tampered = leaf_hash(["doc_id", "source", "lang", F.when(F.col("doc_id").isNull(), F.col("n_chars"))
                          .otherwise(one_more), "text"])
    out = manifest(table(spark, sf_dir, "documents"), claimed=tampered)
    return (out.withColumn("folded_root", fold(F.col("claimed"), F.col("steps")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# crc32 bit by bit over the digits' bits, least significant first
SQL = f"""
WITH RECURSIVE
docs AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))),
      lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384 ELSE 0 END)) AS folded_crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
         CASE WHEN xor(folded_crc, 4294967295) % 7 = 0 THEN {_sql_leaf("n_chars + 1")}
              ELSE {_sql_leaf("n_chars")} END AS claimed
  FROM docs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
nodes(g, level, pos, hash, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM ranked
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2),
subroots AS (SELECT g, hash AS subroot, level AS height, count(*) OVER () AS n_groups FROM nodes WHERE n = 1),
tops(level, pos, hash, n) AS (
  SELECT 0, g, subroot, n_groups FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM tops WHERE n > 1 GROUP BY level, pos // 2),
walk(doc_id, claimed, leaf, g, pos, level, height, place, proof, folded) AS (
  SELECT doc_id, claimed, leaf, g, pos, 0, height, CASE WHEN height = 0 THEN g ELSE pos END, '', claimed FROM ranked JOIN subroots USING (g)
  UNION ALL
  SELECT w.doc_id, w.claimed, w.leaf, w.g, w.pos, w.level + 1, w.height,
         CASE WHEN w.level + 1 = w.height THEN w.g ELSE w.place // 2 END, w.proof || coalesce(s.hash, t.hash, ''),
         CASE WHEN w.place % 2 = 1 THEN sha256(coalesce(s.hash, t.hash) || w.folded)
              ELSE sha256(w.folded || coalesce(s.hash, t.hash, '')) END
  FROM (SELECT *, (SELECT max(level) FROM tops) AS more FROM walk) w
  LEFT JOIN nodes s ON w.level < w.height AND s.g = w.g AND s.level = w.level AND s.pos = xor(w.place, 1)
  LEFT JOIN tops t ON w.level >= w.height AND t.level = w.level - w.height AND t.pos = xor(w.place, 1)
  WHERE w.level < w.height + w.more),
ends AS (SELECT * FROM walk WHERE level = height + (SELECT max(level) FROM tops))
SELECT e.doc_id, e.leaf, s.subroot, r.hash AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
       e.folded = r.hash AS verified
FROM ends e JOIN subroots s USING (g) CROSS JOIN (SELECT hash FROM tops WHERE n = 1) r
"""
