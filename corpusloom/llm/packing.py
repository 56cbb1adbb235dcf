"""Online packing of token ids into windows, in bounded space.

A task keeps a fixed number of open windows. A document's ids (its text's, then one end id) are cut at the window size;
full cuts are windows of their own, and the rest goes to the open window that it fills best. When it fits none and all
are open, the fullest is emitted. What is open at a task's end is not padded but written with the rest and packed once
more, long pieces first: leftovers of 32 tasks at a time, a bounded amount, meet in one task.

Ids are little-endian unsigned 32-bit integers. A window of fewer ids than its size is padded to it, unless its length is
a power of two. Window ids come from the number of the input partition, whose rows a repeated task reads again in the same order, and the
result of the first pass is written to the shared folder before it is used.

Defined results: a null or empty text is a document of the end id alone. Repeated rows are packed each. A null id stays
null. Only the text and the key are read. An empty table gives no windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ByteBpe, loaded, packed, table, texts_of, vocabulary
from corpusloom.session import ship
from corpusloom.storage import work_dir

SIZE, OPEN, END = 1024, 64, 0
#: Tasks whose leftovers are packed together, and rows in an output batch.
TOGETHER, ROWS = 32, 2048
#: Bits of a window id that count within a task.
_SHIFT = 36

_COLUMNS = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


class Windows:
    """A fixed number of open windows; pieces are (key, start, length, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.room: list[tuple[int, int]] = []  # (room left, window), fullest first
        self.held: dict[int, list[tuple]] = {}

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Rows of the windows that this closes."""
        length = piece[2]
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                yield self._close(self.room.pop(0)[1], False)
            room, window = self.size, self.next_id
            self.held[window] = []
            self.next_id += 1
        self.held[window].append(piece)
        if room == length:
            yield self._close(window, False)
        else:
            insort(self.room, (room - length, window))

    def finish(self, is_open: bool) -> Iterator[list[tuple]]:
        for _, window in self.room:
            yield self._close(window, is_open)
        self.room = []

    def _close(self, window: int, is_open: bool) -> list[tuple]:
        rows, offset = [], 0
        for piece in self.held.pop(window):
            rows.append((*piece, window, offset, is_open))
            offset += piece[2]
        return rows


def _batches(groups: Iterator[list[tuple]], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for group in groups:
        rows += group
        if len(rows) >= ROWS:
            yield _batch(rows, key_type)
            rows = []
    if rows:
        yield _batch(rows, key_type)


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [key_type, *_KINDS], strict=True)], _COLUMNS)


def pack(docs: DataFrame, vocab: str, key: str = "doc_id", size: int = SIZE, most: int = OPEN, end: int = END) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of every piece."""
    width = 4 * size

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, windows = loaded(ByteBpe, vocab), Windows(size, most, TaskContext.get().partitionId() << _SHIFT)

        def groups(batch):
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                ids = bpe.encode(text) if text else []
                ids.append(end)
                raw, n = packed(ids), len(ids)
                for start in range(0, n, size):
                    yield from windows.place((doc, start, min(size, n - start), raw[4 * start:4 * start + width], n))

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            yield from _batches(groups(batch), kind)
        if kind is not None:
            yield from _batches(windows.finish(True), kind)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"part": None, "windows": None}

        def groups(batch):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[-1] != state["part"]:
                    if state["windows"]:
                        yield from state["windows"].finish(False)
                    state["part"], state["windows"] = row[-1], Windows(size, most, 1 << 62 | row[-1] << _SHIFT)
                yield from state["windows"].place(row[:5])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            yield from _batches(groups(batch), kind)
        if state["windows"]:
            yield from _batches(state["windows"].finish(False), kind)

    field = lambda n, t: T.StructField(n, t)
    long = T.LongType()
    kind = T.StructType([field("key", docs.schema[key].dataType), field("start", long), field("length", long), field("ids", T.BinaryType()),
                         field("doc_tokens", long), field("sequence_id", long), field("offset", long), field("open", T.BooleanType())])
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/windows"
    docs.select(F.col(key).alias("key"), "text").mapInArrow(first, kind).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(kind).parquet(path)
    part = F.expr(f"(sequence_id >> {_SHIFT}) div {TOGETHER}").alias("part")
    left = written.where("open").select("key", "start", "length", "ids", "doc_tokens", part)
    packed_again = (left.repartition("part").sortWithinPartitions("part", F.desc("length"), "key", "start", F.crc32("ids"))
                    .mapInArrow(again, kind))
    return written.where("not open").union(packed_again).drop("open").withColumnRenamed("key", key)


def op4_online_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    ship(spark)
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
