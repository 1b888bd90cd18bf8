"""Last lines by position and checked reads."""

import os
import random

import pytest
from pyspark.sql import types as T

from lexiflow.sources import line_tail
from lexiflow.sources.checked import issue_counts, read_csv_checked, read_json_checked
from lexiflow.sources.line_tail import tail_lines, tail_ranges


def plain(data: bytes):
    lines = data.split(b"\n")
    if data.endswith(b"\n") or not data:
        lines.pop()
    return lines


def test_ranges_hold_the_last_lines():
    rng = random.Random(1)
    for _ in range(3000):
        data = "".join(rng.choice("ab\n\r") for _ in range(rng.randint(0, 30))).encode()
        n = rng.randint(1, 8)
        ranges, found = tail_ranges(lambda at, k: data[at:at + k], len(data), n, rng.randint(1, 5), rng.randint(1, 8))
        got = [x for a, b, _ in reversed(ranges) for x in plain(data[a:b])]
        assert got == plain(data)[-n:] and found == len(got) == sum(k for *_, k in ranges)


def test_reading_stops_early():
    data, seen = b"line\n" * 100_000, []

    def read(at, k):
        seen.append(k)
        return data[at:at + k]
    assert tail_ranges(read, len(data), 10, 1024)[1] == 10 and sum(seen) <= 1025


@pytest.mark.parametrize("n", [1, 5, 12, 100])
def test_tail_over_files(spark, tmp_dir, n, monkeypatch):
    texts = {"a.txt": "a1\na2\n\na4\n", "b.txt": "", "c.txt": "c1\r\nc2\nlast ü without end", "_skip": "no\n"}
    for name, text in texts.items():
        with open(os.path.join(tmp_dir, name), "w", newline="") as f:
            f.write(text)
    want = ["a1", "a2", "", "a4", "c1", "c2", "last ü without end"][::-1][:n]
    got = sorted(map(tuple, tail_lines(spark, tmp_dir, n).select("place", "value").collect()))
    assert got == list(enumerate(want))
    one = tail_lines(spark, "file://" + os.path.join(tmp_dir, "a.txt"), 2).orderBy("place").collect()
    assert [(r.value, r.offset) for r in one] == [("a4", 7), ("", 6)]
    empty = os.path.join(tmp_dir, "b.txt")
    assert tail_lines(spark, empty, 3).collect() == []
    assert line_tail.list_files(empty) == [(empty, 0)]


SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])


def test_checked_csv(spark, tmp_dir):
    path = os.path.join(tmp_dir, "f.csv")
    with open(path, "w") as f:
        f.write("id,x,s\n1, 2.5 ,a\nx,3,b\n2,,c\n3,y,\n4,1\n5,1,a,more\n\n")
    rows, issues = read_csv_checked(spark, path, SCHEMA)
    got = sorted(map(tuple, rows.collect()), key=repr)
    assert got == sorted([(1, 2.5, "a"), (None, 3.0, "b"), (2, None, "c"), (3, None, None)], key=repr)
    found = sorted((r["column"], r.reason, r["value"]) for r in issues.where("column is not null").collect())
    assert found == [("id", "not a int", "x"), ("x", "not a double", "y")]
    assert {r["value"] for r in issues.where("column is null").collect()} == {"4,1", "5,1,a,more"}
    counts = issue_counts(issues).collect()
    assert {r.file.split("/")[-1] for r in counts} == {"f.csv"} and sum(r.n for r in counts) == 4


def test_checked_json(spark, tmp_dir):
    path = os.path.join(tmp_dir, "f.json")
    with open(path, "w") as f:
        f.write('{"id": 1, "x": 2.5, "s": {"k": 1}}\n{"id": "q", "s": null}\nno json\n{"id": 7\n[]\n{}\n')
    rows, issues = read_json_checked(spark, path, SCHEMA)
    got = {tuple(r) for r in rows.collect()}
    assert {(1, 2.5, '{"k": 1}'), (None, None, None)} <= got
    reasons = sorted((r["column"] or "", r.reason, r["value"]) for r in issues.collect())
    assert ("id", "not a int", "q") in reasons
    assert {v for c, _, v in reasons if not c} >= {"no json", '{"id": 7'}
