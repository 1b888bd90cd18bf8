"""The compacted streaming state: sums, replays, bounded reads, a switch that fails."""

import pytest

from lexiflow.streaming.counts_store import CountsStore

SCHEMA = "k string, cnt bigint"


def rows(df):
    return sorted((r.k, r.cnt) for r in df.collect())


def test_many_batches_replays_and_bounded_inputs(spark, tmp_dir):
    store = CountsStore(spark, tmp_dir, ["k"], compact_every=3)
    assert store.read(SCHEMA).collect() == []
    total, sent = {}, []
    for b in range(11):
        part = {"a": b, f"k{b % 4}": 1, "": 2}
        for k, n in part.items():
            total[k] = total.get(k, 0) + n
        df = spark.createDataFrame(list(part.items()), SCHEMA)
        sent.append(df)
        store.write_batch(df, b)
        if b % 2:
            store.write_batch(df, b)                       # a retry of the newest batch
        store.write_batch(sent[max(0, b - 5)], max(0, b - 5))     # a replay, later of one that is compacted
        assert len(store.inputs()) <= 4
    assert rows(store.read()) == sorted(total.items())
    assert rows(CountsStore(spark, tmp_dir, ["k"]).read()) == sorted(total.items())
    assert len(store.files.names("snapshot")) <= 2 and len(store.files.names("delta")) <= 6


def test_a_reader_keeps_its_state_over_one_compaction(spark, tmp_dir):
    store = CountsStore(spark, tmp_dir, ["k"], compact_every=100)
    for b in range(3):
        store.write_batch(spark.createDataFrame([("a", 1)], SCHEMA), b)
    before = store.read()
    store.compact(2)
    assert rows(before) == [("a", 3)] == rows(store.read()) and store.inputs() == ["snapshot/v=1"]


def test_a_compaction_that_dies_changes_nothing(spark, tmp_dir, monkeypatch):
    store = CountsStore(spark, tmp_dir, ["k"], compact_every=2)
    one = spark.createDataFrame([("a", 1)], SCHEMA)
    store.write_batch(one, 0)

    def dies(*_):
        raise OSError("lost")
    monkeypatch.setattr(store.files, "create", dies)
    with pytest.raises(OSError):
        store.write_batch(one, 1)
    monkeypatch.undo()
    assert rows(store.read()) == [("a", 2)]
    store.write_batch(one, 1)                              # the retry of the batch compacts
    assert rows(store.read()) == [("a", 2)] and store.inputs() == ["snapshot/v=1"]
    with pytest.raises(FileExistsError):
        store.files.create("versions/000000000001.json", "x")
