"""Operator 4: the stored map, its edits, and shards of near equal bytes with heavy texts."""

from collections import Counter

from edge import documents
from lexiflow.llm import sharding


def test_eleven_heavy_texts_spread(spark, tmp_dir):
    rows = [(1000 * k + i, chr(97 + k) * 900) for k in range(11) for i in range(100)]
    rows += [(100_000 + i, f"small {i} " + "z" * 80) for i in range(1200)]
    got = sharding.shard_rows(documents(spark, rows), map_path=tmp_dir + "/m").collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert len(got) == len(rows) and max(loads.values()) <= 1.03 * sum(loads.values()) / 8
    versions = {r.map_version for r in got}
    assert versions == {spark.read.parquet(tmp_dir + "/m").selectExpr("max(version)").first()[0]} and max(versions) >= 3


def test_versions_are_stored_and_used(spark, tmp_dir):
    docs, path = documents(spark, [(i, f"text {i % 70} " * (i % 9)) for i in range(300)]), tmp_dir + "/m"
    first = {r.doc_id: (r.shard, r.virtual_slot) for r in sharding.shard_rows(docs, map_path=path).collect()}
    m = sharding.SlotMap.load(spark, path)
    assert sharding.SlotMap.load(spark, path, 1).shard == [s % 8 for s in range(4096)]
    assert m.version >= 2 and sum(m.weight) == sum(len((f"text {i % 70} " * (i % 9)).encode()) + 1 for i in range(300))
    grown = m.grown(9).store(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown
    again = {r.doc_id: (r.shard, r.virtual_slot) for r in sharding.shard_rows(docs, map_path=path).collect()}
    assert all(b[1] == a[1] and b[0] in (a[0], 8) for a, b in ((first[i], again[i]) for i in first))
    assert {s for s, _ in again.values()} == set(range(9))


def test_one_heavy_row_stays_whole(spark):
    rows = [(1, "x" * 100_000)] + [(i, f"y{i}" * 20) for i in range(2, 200)]
    got = sharding.shard_rows(documents(spark, rows)).collect()
    heavy = next(r.shard for r in got if r.doc_id == 1)
    assert len(got) == 199 and sum(r.shard == heavy for r in got) == 1
