"""Token-id matrices by best-fit-decreasing packing.

A document's ids, then one end id, are cut at the row width without loss. A task gathers pieces up to a fixed number of
ids, sorts them by falling length, and puts each into the row whose room it leaves smallest. Rows are found by a segment
tree over the possible rooms, whose nodes count the open rows below them: the smallest sufficient room takes a walk of
log(width) steps, however many rows are open. Blocks are independent, so nothing is shuffled, and a block of thousands of
rows leaves few unfilled.

A result row is one matrix: its ids row by row (little-endian unsigned 32-bit, padded by ``pad``), the cumulative segment lengths over the flat
matrix (padding at a row's end is a segment of its own), the flat offsets at which positions restart, and for every
segment its document and the place of its first id there (null for padding).

Defined results: a null or empty text is a document of the end id alone. Repeated rows are packed each; ties in length
keep the order of rows. Other columns are ignored. An empty table gives no matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ByteBpe, loaded, table, texts_of, vocabulary
from corpusloom.session import ship

WIDTH, END, PAD = 1024, 50256, 50256
#: Ids sorted together in a task, and rows of a matrix.
BLOCK, MATRIX = 1 << 22, 256


class Rooms:
    """Segment tree over rooms 0..width that counts open rows; finds the smallest room that suffices."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of a row with the smallest room of at least so much, taken out."""
        at = least + self.leaves
        while not self.count[at]:
            # up to the next subtree on the right
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            if at == 0:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            at += not self.count[at]
        room = at - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of piece indexes."""
    rooms, rows = Rooms(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        room, row = found if found else (width, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


def pack(docs: DataFrame, vocab: str, key: str = "doc_id", width: int = WIDTH, end: int = END, pad: int = PAD) -> DataFrame:
    """(matrix_id, n_rows, ids, cu_seqlens, position_resets, docs, starts) of every matrix."""
    def matrices(pieces: list[tuple], first_id: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(p[2]) for p in pieces], width)
        for number, at in enumerate(range(0, len(rows), MATRIX)):
            some = rows[at:at + MATRIX]
            ids = np.full((len(some), width), pad, "<u4")
            ends, of, starts = [0], [], []
            for r, row in enumerate(some):
                place = 0
                for doc, start, piece in (pieces[i] for i in row):
                    ids[r, place:place + len(piece)] = piece
                    place += len(piece)
                    ends.append(r * width + place)
                    of.append(doc)
                    starts.append(start)
                if place < width:
                    ends.append((r + 1) * width)
                    of.append(None)
                    starts.append(None)
            yield pa.RecordBatch.from_arrays([
                pa.array([first_id + number], pa.int64()), pa.array([len(some)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([ends], pa.list_(pa.int32())),
                pa.array([ends[:-1]], pa.list_(pa.int32())), pa.array([of], pa.list_(kind)), pa.array([starts], pa.list_(pa.int64()))],
                ["matrix_id", "n_rows", "ids", "cu_seqlens", "position_resets", "docs", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held, size, next_id, kind = loaded(ByteBpe, vocab), [], 0, TaskContext.get().partitionId() << 36, None
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                ids = np.array([*(bpe.encode(text) if text else []), end], "<u4")
                held += [(doc, start, ids[start:start + width]) for start in range(0, len(ids), width)]
                size += len(ids)
                if size >= BLOCK:
                    for out in matrices(held, next_id, kind):
                        next_id += 1
                        yield out
                    held, size = [], 0
        if held:
            yield from matrices(held, next_id, kind)

    field = lambda n, t: T.StructField(n, t)
    ints, of = T.ArrayType(T.IntegerType()), T.ArrayType(docs.schema[key].dataType)
    kind = T.StructType([field("matrix_id", T.LongType()), field("n_rows", T.IntegerType()), field("ids", T.BinaryType()), field("cu_seqlens", ints),
                         field("position_resets", ints), field("docs", of), field("starts", T.ArrayType(T.LongType()))])
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, kind)


def position_ids(resets: list[int], n_rows: int, width: int = WIDTH) -> np.ndarray:
    """Positions of a matrix, which start again at every reset."""
    flat = np.arange(n_rows * width)
    starts = np.asarray(resets)
    return (flat - starts[np.searchsorted(starts, flat, "right") - 1]).reshape(n_rows, width)


def op1_id_matrices(spark, sf_dir: str) -> DataFrame:
    """All documents as matrices of 256 rows of 1024 ids."""
    ship(spark)
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("docs", "doc_ids")
