"""Token files: ids of whole documents in fixed-width bit packing.

A file is one segment, little-endian:

* header, 64 bytes: magic, version, bits an id, ids a block, documents, ids, the
  writing task and the segment's number in it;
* the byte offset of every block and of the end (int64);
* per document the end of its ids (int64), its number (int64) and whether it has
  one (a byte);
* the blocks: id k of a block occupies the bits from k * bits on, least significant
  first, with as few bits as the vocabulary needs; a block is padded to 32 bits;
* one line feed.

As ids have one width, 32 of them fill ``bits`` 32-bit words, and both directions
are a shift and a mask a column.  A range of ids is read from its blocks alone.

Documents are ordered by a range exchange on (number, text hash, row), tokenised
after it, and cut into segments of whole documents: a segment closes once it has
``segment_ids`` ids, so memory is bounded by that and the longest document.  Spark's
own text sink writes each segment as a file (a row is its bytes), so tasks commit
their files as a whole, in any store that Spark writes to; the reader takes them
from the binary-file source.  Places before a segment come from sums over (task,
segment), never from a list of documents."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..session import Scratch, ensure_checkpoint_dir
from . import vocab
from .common import in_parts, small_batches, table, utf8
from .word_ids import word_ids

MAGIC, VERSION, HEADER = b"LXTOKENS", 1, struct.Struct("<8sIIIxxxxqqqq8x")
BLOCK_IDS, SEGMENT_IDS, END_ID = 4096, 1 << 22, 2
U32 = np.dtype("<u4")


def width_of(vocabulary: int) -> int:
    """The bits that every id below ``vocabulary`` fits in."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, padded to whole 32-bit words."""
    rows = -(-len(ids) // 32)
    v = np.zeros((rows, 32), np.uint64)
    v.reshape(-1)[:len(ids)] = ids
    out = np.zeros((rows, bits + 1), np.uint64)
    for k in range(32):
        word, shift = divmod(k * bits, 32)
        wide = v[:, k] << np.uint64(shift)
        out[:, word] |= wide & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= wide >> np.uint64(32)
    return out[:, :bits].astype(U32).tobytes()[:4 * -(-len(ids) * bits // 32)]


def unpack_bits(packed, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    rows = -(-count // 32)
    words = np.zeros(rows * bits, np.uint64)
    have = np.frombuffer(packed, U32, count=-(-count * bits // 32))
    words[:len(have)] = have
    words = np.column_stack([words.reshape(rows, bits), np.zeros(rows, np.uint64)])
    out = np.empty((rows, 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(32):
        word, shift = divmod(k * bits, 32)
        both = words[:, word] | words[:, word + 1] << np.uint64(32)
        out[:, k] = both >> np.uint64(shift) & mask
    return out.reshape(-1)[:count]


def write_segment(ids: np.ndarray, ends: np.ndarray, numbers: list, bits: int, task: int, place: int) -> bytes:
    """The bytes of one file, but for its line feed."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    # a full block of 4096 ids ends on a word, so all blocks are packed at once
    blocks = pack_bits(ids, bits)
    n_blocks = -(-len(ids) // BLOCK_IDS)
    fixed = HEADER.size + 8 * (n_blocks + 1) + 17 * len(numbers)
    fixed += -fixed % 4
    offsets = fixed + np.arange(n_blocks + 1, dtype="<i8") * (BLOCK_IDS * bits // 8)
    offsets[-1] = fixed + len(blocks)
    head = b"".join([
        HEADER.pack(MAGIC, VERSION, bits, BLOCK_IDS, len(numbers), len(ids), task, place), offsets.tobytes(),
        ends.astype("<i8").tobytes(), np.array([n or 0 for n in numbers], "<i8").tobytes(),
        bytes(n is not None for n in numbers)])
    return head.ljust(fixed, b"\0") + blocks


class Segment:
    """Random access to a segment's bytes (also a memory map of a file)."""

    def __init__(self, data):
        self.data = memoryview(data)
        (magic, version, self.bits, self.block_ids, self.n_docs, self.n_ids, self.task,
         self.place) = HEADER.unpack_from(self.data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token file")
        n_blocks, at = -(-self.n_ids // self.block_ids), HEADER.size
        self.offsets = np.frombuffer(self.data, "<i8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.ends = np.frombuffer(self.data, "<i8", self.n_docs, at)
        numbers = np.frombuffer(self.data, "<i8", self.n_docs, at + 8 * self.n_docs)
        known = np.frombuffer(self.data, np.uint8, self.n_docs, at + 16 * self.n_docs)
        self.numbers = [n if k else None for n, k in zip(numbers.tolist(), known)]
        self.starts = np.append(0, self.ends[:-1]) if self.n_docs else self.ends

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop; only the blocks that hold them are read."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        base = first * self.block_ids
        count = min(self.n_ids, (last + 1) * self.block_ids) - base
        packed = self.data[self.offsets[first]:self.offsets[last + 1]]
        return unpack_bits(packed, self.bits, count)[start - base:stop - base]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.ends[i]))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *,
                 tokenizer: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all texts, each closed by ``end_id``, in ascending order of the
    integer ``id_col``, to token files below ``path``.

    A null or empty text is the closing id alone; null numbers come first; rows that
    repeat a number are ordered by their text's hash, and rows that are all alike stay
    apart; an empty table leaves a folder without segments.  Other columns are not read."""
    small_batches(docs)
    tokenizer = tokenizer or vocab.default_path("word_bpe_49k.json")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("text"))
               .withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
               .repartitionByRange(parts, "id", "hash", "row").sortWithinPartitions("id", "hash", "row"))

    def run(batches):
        model, task, place = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        bits = width_of(max(model.size, end_id + 1))
        held, ends, numbers, total = [], [], [], 0

        def segment():
            data = write_segment(np.concatenate(held), np.array(ends, np.int64), numbers, bits, task, place)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for b in in_parts(batches):
            numbers_of, (ids, n) = b.column(0).to_pylist(), model.batch(b.column(1).to_pylist())
            stops = np.cumsum(n)
            ids, lasts = np.insert(ids, stops, end_id), stops + np.arange(1, len(n) + 1)
            first = 0
            while first < len(numbers_of):
                # the whole documents up to the one that fills the segment
                base = int(lasts[first - 1]) if first else 0
                stop = min(len(numbers_of), 1 + int(np.searchsorted(lasts, base + segment_ids - total)))
                end = int(lasts[stop - 1])
                held.append(ids[base:end].astype(np.uint32))
                ends.extend((lasts[first:stop] - base + total).tolist())
                numbers.extend(numbers_of[first:stop])
                total, first = total + end - base, stop
                if total >= segment_ids:
                    yield segment()
                    held, ends, numbers, total, place = [], [], [], 0, place + 1
        if numbers:
            yield segment()

    rows = ordered.select("id", "text").mapInArrow(run, "segment binary")
    (rows.select(F.col("segment").cast("string")).write.mode("overwrite")
     .option("maxRecordsPerFile", 1).option("compression", "none").text(path))


def read_segments(spark, path: str) -> DataFrame:
    """One row per token file below ``path``: path, length and content."""
    return (spark.read.format("binaryFile").load(path).where(F.col("length") >= HEADER.size)
            .select("path", "length", "content"))


def read_documents(spark, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the token files below ``path``: doc_id, start (the ids of
    all documents before it), n_tokens, ids_crc32 and, on demand, ids (little-endian
    32-bit).  A folder without segments gives no rows."""
    scratch = Scratch(spark)
    names = ["task", "place", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for b in batches:
            for data in b.column(0):
                s = Segment(data.as_buffer())
                ids = memoryview(s.ids().astype(U32)).cast("B")
                bounds = list(zip((4 * s.starts).tolist(), (4 * s.ends).tolist()))
                cols = [pa.array([x] * s.n_docs, pa.int64()) for x in (s.task, s.place)]
                cols += [pa.array(x, pa.int64()) for x in (
                    s.numbers, s.starts, s.ends - s.starts, [zlib.crc32(ids[a:e]) for a, e in bounds])]
                if with_ids:
                    cols.append(pa.array([bytes(ids[a:e]) for a, e in bounds], pa.binary()))
                yield from in_parts([pa.RecordBatch.from_arrays(cols, names=names)], 1000)

    schema = "task bigint, place bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    content = read_segments(spark, path).select("content")
    small_batches(content)
    docs = scratch.cut(content.mapInArrow(run, schema + ", ids binary" * with_ids), "token_index")
    segments = scratch.cut(docs.groupBy("task", "place").agg(F.sum("n_tokens").alias("n")), "segments")
    earlier = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tasks = segments.groupBy("task").agg(F.sum("n").alias("n"))        # one row a task
    before = tasks.select("task", F.coalesce(F.sum("n").over(
        Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = (segments.withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
              .join(checked_broadcast(before), "task")
              .select("task", "place", (F.col("base") + F.col("inner")).alias("first")))
    return docs.join(checked_broadcast(starts), ["task", "place"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op11_fixed_width_ids(spark, sf_dir: str) -> DataFrame:
    path = os.path.join(ensure_checkpoint_dir(spark), f"token-files-{uuid.uuid4().hex}")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
