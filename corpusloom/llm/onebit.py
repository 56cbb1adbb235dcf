"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector's direction is turned by a random orthogonal matrix of ``code_bits`` dimensions (zero-padded, so short vectors get
longer codes and tighter bounds), and only the signs are kept: a corner of the cube. Two scalars correct it: the vector's norm and the inner
product of its direction with the corner. With them the corner's inner product with a turned query estimates the true
one, and ``reach`` times its deviation bounds the error.

Of rows with equal vectors only those are indexed that can be returned. The index is written once to the shared folder, in blocks of bounded size, vectors in a column of their own. Queries are cut into
blocks as well, and a block of queries and a group of data blocks are one unit of work, to which only codes and scalars travel:

1. every unit names the k rows of best estimate for each query; the k best of all are read in full, and the least of their
   exact scores is what a row has to reach;
2. every unit lists the rows whose upper bound reaches that score; only these are read in full.

To be read in full, lists of places go to the group that holds the vectors. A group's vectors travel once (once for each
million queries), whatever the number of query blocks, and a query's list holds a few rows of a group. Exact scores are sums in
double precision in the order of components.

Defined results: rows with a null id, or vectors that are null, empty, zero or hold null or non-finite components, take no
part. Vectors of different lengths are never compared. A row with the query's id is its own, also if ids repeat; of queries
that share an id the smallest vector is used. Equal scores go to the smaller id; fewer candidates give fewer rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import loaded, table
from corpusloom.session import ship
from corpusloom.storage import stage

SEED, CODE_BITS, REACH, NEAREST = 7, 512, 4.0, 20
#: Vectors of a data block (at most 2 ** PLACE), queries of a query block, data blocks of a group, queries that share a copy of a group's vectors.
DATA, QUERIES, GROUP, SHARED = 4096, 1024, 32, 1 << 20
#: A row's place is its block's number, shifted by so many bits, and its position in there.
PLACE = 12

_BLOCKS = "dim int, block long, n int, ids binary, vectors binary, codes binary, norms binary, corners binary"
_ASKED = "dim int, q_block long, q_ids binary, q_vectors binary, q_least binary"
_GUESSED = "query_id long, g int, place long, guess float"
_LISTED = "query_id long, g int, places array<long>"
_SCORED = "query_id long, place long, vec_id long, score double"


class Rotation:
    """The first ``dim`` columns of a random orthogonal matrix."""

    def __init__(self, dim: int, code_bits: int):
        self.bits = max(code_bits, -(-dim // 8) * 8)
        self.matrix = np.linalg.qr(np.random.default_rng(SEED).standard_normal((self.bits, self.bits)))[0][:, :dim].astype(np.float32)

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float32) @ self.matrix.T

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed signs, norms, inner products of the directions with their corners)."""
        norms = np.linalg.norm(vectors, axis=1)
        turned = self.turned(vectors / norms[:, None])
        return np.packbits(turned > 0, axis=1), norms.astype(np.float32), np.abs(turned).sum(1) / np.float32(np.sqrt(self.bits))


def valid(embedding: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _in_blocks(rows: DataFrame, size: int, shape: str, block) -> DataFrame:
    """``block(number, dim, rows)`` of at most ``size`` rows whose second column has one length; rows are tuples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dim = len(row[1])
                same = held.setdefault(dim, [])
                same.append(row)
                if len(same) == size:
                    yield block(made, dim, held.pop(dim))
                    made += 1
        for dim, same in held.items():
            yield block(made, dim, same)
            made += 1

    return rows.mapInArrow(run, shape)


def _vectors(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<f8")


def blocks(rows: DataFrame, size: int, code_bits: int = CODE_BITS) -> DataFrame:
    """(vec_id, embedding) in blocks of at most ``size`` rows of one length, with their codes."""
    def block(number: int, dim: int, same: list) -> pa.RecordBatch:
        ids, vectors = _vectors(same)
        codes, norms, corners = loaded(Rotation, dim, code_bits).codes(vectors)
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([number]), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vectors": [vectors.tobytes()],
            "codes": [codes.tobytes()], "norms": [norms.tobytes()], "corners": [corners.astype("<f4").tobytes()]})

    return _in_blocks(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), size, _BLOCKS, block)


def query_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(vec_id, embedding, least) in blocks; ``least`` is the score a row has to reach, null if any will do."""
    def block(number: int, dim: int, same: list) -> pa.RecordBatch:
        ids, vectors = _vectors(same)
        least = np.array([-np.inf if r[2] is None else r[2] for r in same], "<f8")
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "q_block": pa.array([number]), "q_ids": [ids.tobytes()],
                                           "q_vectors": [vectors.tobytes()], "q_least": [least.tobytes()]})

    return _in_blocks(rows.select("vec_id", "embedding", F.col("least").cast("double")), size, _ASKED, block)


class Queries:
    """A block of queries against blocks of codes of one group."""

    def __init__(self, row: dict, k: int, code_bits: int, reach: float):
        self.g, self.k = row["g"], k
        self.ids, self.least = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_least"], "<f8")
        vectors = np.frombuffer(row["q_vectors"], "<f8").reshape(len(self.ids), -1)
        self.rotation = loaded(Rotation, row["dim"], code_bits)
        self.turned = self.rotation.turned(vectors)
        self.lengths = np.linalg.norm(vectors, axis=1).astype(np.float32)
        self.reach = np.float32(reach / np.sqrt(self.rotation.bits - 1))
        self.best = [(np.empty(0, np.float32), np.empty(0, np.int64)) for _ in self.ids]
        self.listed: list[list[np.ndarray]] = [[] for _ in self.ids]

    def estimates(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimated products [query, row], and scalars of the rows whose product with a query's length bounds the error."""
        signs = np.unpackbits(np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1), axis=1).astype(np.float32) * 2 - 1
        norms, corners = np.frombuffer(row["norms"], "<f4"), np.frombuffer(row["corners"], "<f4")
        scale = norms / (corners * np.float32(np.sqrt(self.rotation.bits)))
        error = norms * (np.sqrt(np.maximum(1 - corners ** 2, 0)) / corners * self.reach + np.float32(1e-5))
        return (self.turned @ signs.T) * scale, error, (row["block"] << PLACE) + np.arange(row["n"])

    def guess(self, row: dict) -> None:
        """Keep the k rows of best estimate of every query."""
        guess, _, places = self.estimates(row)
        guess[self.ids[:, None] == np.frombuffer(row["ids"], "<i8")] = -np.inf
        for q, mine in enumerate(guess):
            some = np.flatnonzero(mine > -np.inf) if len(mine) <= self.k else np.argpartition(-mine, self.k - 1)[:self.k]
            some = some[mine[some] > -np.inf]
            values, names = np.concatenate([self.best[q][0], mine[some]]), np.concatenate([self.best[q][1], places[some]])
            order = np.lexsort((names, -values))[:self.k]
            self.best[q] = values[order], names[order]

    def list(self, row: dict) -> None:
        """List the rows whose upper bound reaches a query's score."""
        guess, error, places = self.estimates(row)
        guess += np.outer(self.lengths, error)
        reached = (guess >= self.least[:, None]) & (self.ids[:, None] != np.frombuffer(row["ids"], "<i8"))
        for q in np.flatnonzero(reached.any(1)):
            self.listed[q].append(places[reached[q]])

    def guessed(self) -> pa.RecordBatch:
        sizes = [len(v) for v, _ in self.best]
        return pa.RecordBatch.from_pydict({
            "query_id": np.repeat(self.ids, sizes), "g": pa.array([self.g] * sum(sizes), pa.int32()),
            "place": np.concatenate([p for _, p in self.best]), "guess": np.concatenate([v for v, _ in self.best])})

    def lists(self) -> pa.RecordBatch:
        some = [q for q, found in enumerate(self.listed) if found]
        return pa.RecordBatch.from_pydict({
            "query_id": self.ids[some], "g": pa.array([self.g] * len(some), pa.int32()),
            "places": pa.array([np.concatenate(self.listed[q]) for q in some], pa.list_(pa.int64()))})


def _scan(asked: DataFrame, index: DataFrame, groups: int, shape: str, add, result, *options) -> DataFrame:
    """``result`` of every unit after ``add`` saw each of its blocks; vectors of the index stay where they are."""
    spread = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    units = spread.join(index.drop("vectors"), ["dim", "g"]).repartition("q_block", "dim", "g").sortWithinPartitions("q_block", "dim", "g", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, queries = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if unit != (now := (row["q_block"], row["dim"], row["g"])):
                    if queries:
                        yield result(queries)
                    unit, queries = now, Queries(row, *options)
                add(queries, row)
        if queries:
            yield result(queries)

    return units.mapInArrow(run, shape)


def read_in_full(lists: DataFrame, asked: DataFrame, index: DataFrame, copies: int, k: int) -> DataFrame:
    """(query_id, place, vec_id, score): the k best exact scores among the listed places (query_id, g, places) of each group."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int").alias("part")
    wanted = lists.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id").select(
        "g", part, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(None).cast("binary").alias("ids"),
        F.lit(None).cast("binary").alias("vectors"), "query_id", "query", "places")
    held = index.select("g", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), F.lit(0).alias("kind"), "dim", "block", "ids", "vectors")
    rows = held.unionByName(wanted, allowMissingColumns=True).repartition("g", "part").sortWithinPartitions("g", "part", "kind", "dim", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: tuple | None = None
        by_dim: dict[int, list] = {}
        ready: dict[int, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if unit != (now := (row["g"], row["part"])):
                    unit, by_dim, ready = now, {}, {}
                if row["kind"] == 0:
                    ids = np.frombuffer(row["ids"], "<i8")
                    by_dim.setdefault(row["dim"], []).append(((row["block"] << PLACE) + np.arange(len(ids)), ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)))
                    continue
                dim = len(row["query"])
                if dim not in ready:
                    ready[dim] = tuple(np.concatenate(x) for x in zip(*by_dim.pop(dim), strict=True))
                places, ids, vectors = ready[dim]
                wanted_ = np.array(row["places"], np.int64)
                at = np.searchsorted(places, wanted_)
                query = np.array(row["query"], "<f8")
                if len(at) > k:  # a matrix product differs from the sums in order by its last digits only
                    read = vectors[at]
                    near = read @ query
                    margin = 1e-9 * np.abs(query).sum() * np.abs(read).max()
                    some = near >= np.partition(near, -k)[-k] - margin
                    wanted_, at = wanted_[some], at[some]
                scores = np.cumsum(vectors[at] * query, axis=1)[:, -1]
                order = np.lexsort((ids[at], -scores))[:k]
                out.append((np.full(len(order), row["query_id"]), wanted_[order], ids[at][order], scores[order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "place", "vec_id", "score"])

    return rows.mapInArrow(run, _SCORED)


def distinguishable(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among any query's k best: of equal vectors those of the k + 1 least ids, each at most k times.

    Equal vectors score alike and go by id, and only one id is a query's own, so nothing else is ever returned. Both limits are
    applied inside each task before rows are shuffled, so a vector or row that is a third of all is no hot key.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("h", F.xxhash64("embedding"))
    times = F.row_number().over(Window.partitionBy("h", "embedding", "vec_id").orderBy("vec_id"))
    names = F.dense_rank().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    return rows.withColumn("n", times).where(F.col("n") <= k).withColumn("n", names).where(F.col("n") <= k + 1).drop("h", "n")


def nearest(queries: DataFrame, data: DataFrame, k: int = NEAREST, code_bits: int = CODE_BITS, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``data`` for each query; both have vec_id and embedding."""
    use = lambda df: df.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    written = stage(blocks(distinguishable(use(data), k), DATA, code_bits), "index")
    groups = max(4, -(-written.count() // GROUP))
    index = written.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    asked = use(queries).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").cast("array<double>").alias("embedding"))
    asked = stage(asked, "queries")
    copies = max(1, -(-asked.count() // SHARED))
    best = lambda rows, name, *order: rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(name) <= k)

    first = stage(query_blocks(asked.withColumn("least", F.lit(None)), QUERIES), "asked")
    guessed = best(_scan(first, index, groups, _GUESSED, Queries.guess, Queries.guessed, k, code_bits, reach), "r", F.desc("guess"), "place")
    firsts = stage(read_in_full(guessed.groupBy("query_id", "g").agg(F.collect_list("place").alias("places")), asked, index, copies, k), "firsts")
    least = firsts.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

    again = stage(query_blocks(asked.join(least, "vec_id", "left"), QUERIES), "asked_again")
    listed = _scan(again, index, groups, _LISTED, Queries.list, Queries.lists, k, code_bits, reach)
    found = read_in_full(listed, asked, index, copies, k).unionByName(firsts)
    once = found.groupBy("query_id", "place").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    return best(once, "rank", F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", "score")


def op10_onebit_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth id, over all rows."""
    ship(spark)
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 20 = 0"), rows)
