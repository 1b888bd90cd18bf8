"""The last lines of text files by their position in the file.

``spark.read.format("line_tail").option("path", ...).option("lines", n).load()`` gives
the last n lines of the files, taken in the order of their names, without a sort and
without reading the rest: the planner steps backwards from the end of the last file, a
block at a time, only counting line ends, until it has n lines or the files are
exhausted; each found range of bytes, cut at line starts, is a partition that a task
reads again by its offsets.

Columns: place (0 is the newest line), file, offset (of the line's first byte), value.
A last line without a line end counts, a trailing line end opens no further line, empty
lines are lines, and a carriage return before the line end is cut off.  Files whose
names begin with ``_`` or ``.`` are skipped, as Spark does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, RANGE = 1 << 16, 1 << 20


def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file or of the files right below a folder, by name."""
    from pyarrow import fs
    system, base = _open(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(base))
    return sorted((f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def tail_ranges(read, size: int, lines: int, block: int = BLOCK, span: int = RANGE) -> tuple[list[tuple[int, int, int]], int]:
    """Ranges (start, stop, lines in it), newest first, that hold the last ``lines`` lines
    of ``size`` bytes, and how many lines that is.  ``read(offset, n)`` gives bytes."""
    out, taken, stop, inside = [], 0, size, 0
    at = size
    if size and read(size - 1, 1) == b"\n":
        at = size - 1                              # the last line's own end
    while at > 0 and taken + inside < lines:
        start = max(0, at - block)
        data = read(start, at - start)
        end = len(data)
        while taken + inside < lines and (end := data.rfind(b"\n", 0, end)) >= 0:
            inside += 1
            line = start + end + 1
            if stop - line >= span or taken + inside == lines:
                out.append((line, stop, inside))
                taken, stop, inside = taken + inside, line, 0
        at = start
    if taken + inside < lines and stop > 0:        # the first line of the file
        out.append((0, stop, inside + 1))
        taken, inside = taken + inside + 1, 0
    elif inside:
        out.append((line, stop, inside))
        taken += inside
    return out, taken


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, newest: int):
        self.path, self.start, self.stop, self.newest = path, start, stop, newest


class _TailReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.lines = options["path"], int(options.get("lines", "1000"))

    def partitions(self):
        system, _ = _open(self.path)
        out, newest = [], 0
        for path, size in reversed(list_files(self.path)):
            if newest >= self.lines or not size:
                continue
            with system.open_input_file(path) as f:
                ranges, n = tail_ranges(lambda at, k: f.read_at(k, at), size, self.lines - newest)
            for start, stop, inside in ranges:
                out.append(_Range(path, start, stop, newest))
                newest += inside
        return out or [_Range("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.path) as f:
            data = f.read_at(part.stop - part.start, part.start)
        lines = data.split(b"\n")
        if data.endswith(b"\n"):
            lines.pop()
        at = part.start
        for i, line in enumerate(lines):
            yield (part.newest + len(lines) - 1 - i, part.path, at,
                   line.removesuffix(b"\r").decode("utf-8", "replace"))
            at += len(line) + 1


class LineTail(DataSource):
    @classmethod
    def name(cls):
        return "line_tail"

    def schema(self):
        return "place bigint, file string, offset bigint, value string"

    def reader(self, schema):
        return _TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(place, file, offset, value) of the last n lines below ``path``."""
    spark.dataSource.register(LineTail)
    return spark.read.format("line_tail").option("path", path).option("lines", n).load()
