"""Near-duplicate detection with a MinHash LSH forest.

1. One pass over the texts gives each document its number of distinct word
   shingles, a digest of the whole shingle set and a MinHash sketch.  Documents
   with equal sets form a class; only its smallest id goes on, so a group of
   exact copies costs one hash aggregation.
2. The forest: ``trees`` sorted orders over ``depth`` sketch values each.  A
   region is the run of one order that shares the first ``min_depth`` values.
   Candidates of a row are its longest-common-prefix neighbours: the ``near``
   rows before it, and the first row of the run at every deeper prefix length,
   so a crowded region is compared at a greater depth and no group is expanded
   into all pairs.
3. Candidates whose sketches agree far less than the threshold asks for are
   passed over; all others are confirmed on the full sets.
4. Connected components of the confirmed links.  Every region's members are first
   compared with one leader.  In regions larger than the neighbour window the
   members outside the component of the region's best-linked row (the hub) are
   compared with it, round after round, until no round finds a link.  Then come
   the neighbours that are not yet in one component, and the hubs once more.
5. Regions larger than the window that are still not one component go on by an
   exact join on the rarest shingles of their members (prefixes with a bound by
   position), so no pair of a crowded region is left untried.

The pass, the sets of region members and every round's table are written to
the shared checkpoint folder; no ids, links or sketches reach the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import in_parts, mix64, small_batches, table, utf8, window_hashes, word_hashes, words_of
from .components import connected_components

UNIT = 4            # bytes of one sketch value


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    return np.unique(window_hashes(word_hashes(words_of(text)), shingle))


def _permutations(n: int):
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n].astype(np.uint32) | np.uint32(1))[:, None], seeds[n:].astype(np.uint32)[:, None]


def minhash(hashes: np.ndarray, mul: np.ndarray, xor: np.ndarray, block: int = 4096) -> np.ndarray:
    """Minimum of every permutation over the set, block by block."""
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), block):
        v = (low[i:i + block][None, :] ^ xor) * mul
        np.minimum(out, (v ^ (v >> np.uint32(15))).min(axis=1), out=out)
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, trees: int,
                depth: int, min_depth: int) -> DataFrame:
    width = trees * depth

    def run(batches):
        mul, xor = _permutations(width)
        for b in in_parts(batches):
            n, cls, sketch, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, shingle)
                n.append(len(s))
                if not len(s):
                    cls.append(None), sketch.append(None), keys.append(None)
                    continue
                m = minhash(s, mul, xor).reshape(trees, depth)
                acc = np.arange(trees, dtype=np.uint64)
                for j in range(min_depth):
                    acc = mix64(acc ^ m[:, j]) + np.uint64(j)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(m.astype(">u4").tobytes())
                keys.append(acc.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "cls", "sketch", "keys"])

    idt = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text_col)).mapInArrow(
        run, f"id {idt}, n bigint, cls binary, sketch binary, keys array<bigint>")


def _set_table(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for b in in_parts(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["id", "hs"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hs array<bigint>")


def _forest_neighbours(members: DataFrame, near: int, floor: float) -> DataFrame:
    """Candidate pairs of the sorted orders whose sketches agree enough, without
    those known to be in one component.  ``members`` (key, label, id, c, sketch):
    one row per tree; sorted by key and label, equal prefixes are adjacent."""

    def run(batches):
        key, label, last, heads = None, b"", [], []
        for batch in batches:
            a_out, b_out = [], []
            for k, lab, i, c, sk in zip(*(x.to_pylist() for x in batch.columns)):
                levels, sk = len(lab) // UNIT, np.frombuffer(sk, np.uint32)
                here = (i, c, sk)
                if k != key:
                    key, last, heads = k, [], [here] * levels
                else:
                    d = 0
                    while d < levels and lab[d * UNIT:(d + 1) * UNIT] == label[d * UNIT:(d + 1) * UNIT]:
                        d += 1
                    heads[d:] = [here] * (levels - d)
                    others = {p: x for p, pc, x in (*last, *heads[:d]) if pc != c}
                    if others:
                        alike = (np.array(list(others.values())) == sk).mean(axis=1) >= floor
                        found = [p for p, good in zip(others, alike) if good]
                        a_out += found
                        b_out += [i] * len(found)
                    if len(last) == near:
                        last.pop(0)
                label = lab
                last.append(here)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, batch.column(2).type),
                                              pa.array(b_out, batch.column(2).type)], names=["a", "b"])

    idt = members.schema["id"].dataType.simpleString()
    ordered = (members.select("key", "label", "id", "c", "sketch").repartitionByRange("key", "label", "id")
               .sortWithinPartitions("key", "label", "id"))
    return _pairs(ordered.mapInArrow(run, f"a {idt}, b {idt}"))


def _pairs(df: DataFrame) -> DataFrame:
    return (df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct())


def _similar_sketches(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1)
                        for c in (2, 3))
                keep = (x == y).mean(axis=1) >= floor
                b = b.filter(pa.array(keep))
            yield b.select([0, 1])

    idt = pairs.schema["a"].dataType.simpleString()
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, f"a {idt}, b {idt}"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hs").alias(f"h{c}"))
    both = (pairs.join(side("a"), "a").join(side("b"), "b")
            .withColumn("common", F.size(F.array_intersect("ha", "hb")).cast("bigint")))
    union = F.size("ha") + F.size("hb") - F.col("common")
    found = both.where(F.col("common") * 100 >= union * percent).select("a", "b").distinct()
    return found.coalesce(pairs.sparkSession.sparkContext.defaultParallelism)      # few rows: few files


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with the component ``c`` of their ``id`` (itself when unlinked)."""
    return rows.join(comp, F.col("id") == F.col("u"), "left").select(
        *rows.columns, F.coalesce("v", "id").alias("c"))


def _join_hubs(crowded: DataFrame, links: DataFrame, comp: DataFrame, tried: DataFrame, confirm, scratch):
    """Compare the members of crowded regions that are outside of the component of
    the region's best-linked row with that row, until no round finds a link."""
    while not links.isEmpty():
        rows = scratch.cut(_with_component(crowded, comp), "crowded")
        degree = (links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id")
                  .agg(F.count(F.lit(1)).alias("deg")))
        hubs = (rows.join(degree, "id").groupBy("key").agg(F.max_by("id", "deg").alias("hub"))
                .join(comp, F.col("hub") == F.col("u")).select("key", "hub", F.col("v").alias("hc")))
        fresh = _pairs(rows.join(hubs, "key").where("c <> hc").select(F.col("id").alias("a"),
                                                                     F.col("hub").alias("b")))
        fresh = scratch.cut(fresh.join(tried, ["a", "b"], "left_anti"), "tried")
        more = confirm(fresh)
        if more.isEmpty():
            break
        tried = scratch.cut(tried.unionByName(fresh), "tried")
        links = scratch.cut(links.unionByName(more), "links")
        comp = connected_components(links, scratch)
    return links, comp, tried


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(h, i, head, id, n): the first shingles of each of ``rows`` (id, c, hs) in one order
    of all shingles, those of a single component first, then rarest first.  Sets that
    reach the threshold share a shingle among the first n - ceil(percent n / 100) + 1 of
    both, and the smaller one has it in its ``head``: its overlap is larger yet."""
    shingles = rows.select("id", "c", F.explode("hs").alias("h"))
    spread = (shingles.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi"))
              .where("lo <> hi").select("h", "f"))
    listed = (shingles.join(spread, "h", "left").groupBy("id")
              .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h"))).alias("hs")))
    probe = f"size(hs) - ({percent} * size(hs) + 99) div 100 + 1"
    index = f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1"
    return (listed.select("id", F.size("hs").alias("n"), F.posexplode(F.expr(f"slice(hs, 1, int({probe}))")).alias("i", "x"))
            .where("x.f > 0").select("x.h", "i", F.expr(f"i < {index}").alias("head"), "id", "n"))


def _join_rest(crowded: DataFrame, sets: DataFrame, links: DataFrame, comp: DataFrame, percent: int, scratch):
    """Every link between members of crowded regions that are not one component.  The
    rows of a shingle's heads come in rounds, a few first and then sixteenfold, so that
    what they link is one component before the many come; the last round has all."""
    mixed = (_with_component(crowded, comp).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
             .where("lo <> hi").select("key"))
    ids = scratch.cut(crowded.join(mixed, "key").select("id").distinct(), "open")
    if ids.isEmpty():
        return links, comp
    prefixes = scratch.cut(_prefixes(_with_component(sets.join(ids, "id"), comp), percent), "prefixes")
    most = prefixes.where("head").groupBy("h").count().agg(F.max("count")).first()[0] or 1
    turn, last = F.xxhash64("id", F.lit("turn")), None
    part = 16 ** max(0, (most.bit_length() - 1) // 4)
    while part:
        now = F.col("head") & (F.pmod(turn, F.lit(part)) == 0)
        if last:
            now &= F.pmod(turn, F.lit(last)) != 0
        rows = _with_component(prefixes, comp)
        x, y = (rows.where(w).select("h", *[F.col(v).alias(v + s) for v in ("i", "id", "n", "c")])
                for w, s in ((now, "x"), (F.lit(True), "y")))
        reach = (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) * (100 + percent)
                 >= (F.col("nx") + F.col("ny")) * percent)
        pairs = _pairs(x.join(y, (x["h"] == y["h"]) & (F.col("nx") <= F.col("ny")) & (F.col("cx") != F.col("cy")) & reach)
                       .select(F.col("idx").alias("a"), F.col("idy").alias("b")))
        more = scratch.cut(_confirmed(pairs, sets, percent), "links")
        if not more.isEmpty():
            links = scratch.cut(links.unionByName(more), "links")
            comp = connected_components(links, scratch)
        part, last = part // 16, part
    scratch.drop(ids, prefixes)
    return links, comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shingle: int = 5, percent: int = 80, trees: int = 20, depth: int = 8,
                    min_depth: int = 4, near: int = 8) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Words are A-Z lower-cased ``[^\\x20\\x09-\\x0D]+``; a text with fewer words
    than ``shingle`` has its whole sequence as its only shingle; a null, empty or
    blank text has none and links with nothing (its component is itself).
    Documents are linked when ``100 * |A & B| >= percent * |A | B|``.  Rows with
    a null id keep their class's smallest id as component, or null when the
    class has none (then kept).  Repeated rows are returned as often as they
    come.  Other columns are not read."""
    small_batches(docs)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = scratch.cut(_signatures(docs, "id", "text", shingle, trees, depth, min_depth), "sig")
    full = sig.where("cls is not null")
    classes = full.groupBy("cls").agg(F.min("id").alias("rep"))
    reps = (full.join(classes, "cls").where("id = rep")
            .select("id", "sketch", "keys"))

    # regions of the forest with more than one row, and their rows
    size = depth * UNIT
    rows = reps.select("id", "sketch", F.posexplode("keys").alias("t", "key")).select(
        "id", "key", F.substring("sketch", F.col("t") * size + 1 + min_depth * UNIT,
                                 F.lit(size - min_depth * UNIT)).alias("label"))
    regions = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"),
                                       F.min_by("id", F.xxhash64("id")).alias("leader")).where("m > 1"))
    members = scratch.cut(rows.join(regions, "key"), "members")
    nodes = scratch.cut(members.select("id").distinct(), "nodes")
    sketches = scratch.cut(reps.join(nodes, "id").select("id", "sketch").dropDuplicates(["id"]), "sketches")
    sets = scratch.cut(_set_table(docs.join(nodes, "id").select("id", utf8("text")), shingle), "sets")

    floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (trees * depth)) ** 0.5

    def confirm(pairs):
        return scratch.cut(_confirmed(_similar_sketches(pairs, sketches, floor), sets, percent), "links")

    # one leader per region, then hubs, the sorted orders' neighbours, hubs again, and the exact join
    crowded = members.where(F.col("m") > near + 1).select("key", "id")
    tried = scratch.cut(_pairs(members.select(F.col("id").alias("a"), F.col("leader").alias("b"))), "tried")
    links = confirm(tried)
    comp = connected_components(links, scratch)
    links, comp, tried = _join_hubs(crowded, links, comp, tried, confirm, scratch)
    rows = _with_component(members.select("key", "label", "id"), comp).join(sketches, "id")
    fresh = scratch.cut(_forest_neighbours(rows, near, floor).join(tried, ["a", "b"], "left_anti"), "tried")
    more = scratch.cut(_confirmed(fresh, sets, percent), "links")
    if not more.isEmpty():
        links = scratch.cut(links.unionByName(more), "links")
        comp = connected_components(links, scratch)
        links, comp, tried = _join_hubs(crowded, links, comp, scratch.cut(tried.unionByName(fresh), "tried"),
                                        confirm, scratch)
    links, comp = _join_rest(crowded, sets, links, comp, percent, scratch)
    comp = scratch.cut(comp, "comp")

    # classes, then components, back to every row; rows without shingles stand alone
    named = classes.join(comp, F.col("rep") == F.col("u"), "left").select(
        "cls", F.coalesce("v", "rep").alias("component_id"))
    out = (full.select("id", "n", "cls").join(named, "cls").select("id", "n", "component_id")
           .unionByName(sig.where("cls is null").select("id", "n", F.col("id").alias("component_id"))))
    scratch.drop(members, nodes, sketches, sets, tried, links)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
                      .alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group (the smallest id; one of rows that
    repeat an id), with its own columns only.  Rows without an id can't be named
    in a group: one row of each of their distinct texts stays."""
    found = near_duplicates(docs, id_col, text_col, **options)
    ids = found.where("kept").select(F.col(id_col).alias("_kept_id")).where("_kept_id is not null").distinct()
    named = docs.join(ids, docs[id_col] == ids["_kept_id"], "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()).dropDuplicates([text_col]))


def op8_minhash_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w) - 1)], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
           GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
          WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
          SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(reach.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(reach.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
"""
