"""Whitening of embeddings by shifted CholeskyQR.

The rows are centred exactly in whole numbers and never gathered: each pass reads them once and sums the Gram matrix of the
rows as the factors so far have turned them, ``Q = A inv(R1) inv(R2) ...`` by triangular solves inside the tasks. The first
Gram matrix is shifted before its Cholesky factor is taken, so that a badly conditioned or deficient table can't break it;
two more passes orthogonalise again. The singular values and right vectors of ``R = R3 R2 R1`` are those of the centred
table: eigenvalues of the covariance are their squares over the number of rows. Only matrices of ``dimension x dimension``
reach the driver.

Defined results: rows with a vector that is null, empty, or holds null or non-finite entries, or entries beyond 2 ** 51, take
no part. Vectors of one table should have one length; of several the most frequent counts (of equally frequent ones the longest),
and the others take no part. A component whose standard deviation is below ``RANK`` times the first one's has no
direction, and no rows; so a table of one row, or of equal rows, gives none. Rows are kept as they are, also with null or
repeated ids. Other columns are ignored. ``deviation`` is exact; beyond 38 digits it is null, and the query, whose column
is a long, gives null beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.session import ship
from corpusloom.storage import stage

COMPONENTS = 8
#: Fixed values of the whole numbers.
SCALE, OFFSET = 1024, 100_000
#: Smallest standard deviation of a component, as a share of the first one's.
RANK = 1e-10
#: Most dimensions: their Gram matrix must fit the driver.
MOST_DIMENSIONS = 4096
#: Rows of a block in a task.
ROWS = 2048
_ROUNDOFF = np.finfo(np.float64).eps / 2


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 51)))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(fine, F.lit(False))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))


def _whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """Entries as whole numbers, a row for each vector."""
    return np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


@dataclass
class Moments:
    """Number of fitted rows, and the sum of each dimension."""

    n: int
    sums: list[int]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def shifted(self, whole: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as 64-bit numbers where these hold them, else as Python's."""
        most = int(np.abs(whole).max(initial=0))
        if self.n * most + max(map(abs, self.sums)) < 1 << 62:
            return self.n * whole - np.array(self.sums, np.int64)
        return self.n * whole.astype(object) - np.array(self.sums, object)

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return self.shifted(whole).astype(np.float64) / self.n

    def deviations(self, whole: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, exactly."""
        moved = self.shifted(whole)
        if moved.dtype != object and self.dim * int(np.abs(moved).max(initial=0)) ** 2 >= 1 << 63:
            moved = moved.astype(object)
        return [int(x) for x in (moved * moved).sum(axis=1)]


def moments(vectors: DataFrame) -> Moments | None:
    """Count and sums of the vectors of the most frequent length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in _blocks(batches):
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                whole = _whole(lists.filter(pa.array(lengths == dim)), dim)
                n, sums = found.get(dim, (0, 0))
                # entries below 2 ** 61 and few rows at once: halves keep the sums inside 64 bits
                high, low = (whole >> 32).sum(0).astype(object), (whole & 0xFFFFFFFF).sum(0).astype(object)
                found[dim] = n + len(whole), sums + high * (1 << 32) + low
        for dim, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                              pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], ["dim", "i", "n", "s"])

    parts = vectors.select("embedding").mapInArrow(run, "dim int, i int, n long, s decimal(38,0)")
    sums = stage(parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "moments")
    first = sums.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return None
    if first["dim"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    return Moments(first["n"], [int(r["s"]) for r in sums.where(F.col("dim") == first["dim"]).orderBy("i").collect()])


def gram(vectors: DataFrame, of: Moments, turn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The Gram matrix of the centred rows after ``turn``, which gives rows of ``size`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in _blocks(batches):
            turned = turn(of.centred(_whole(batch.column(0), of.dim)))
            total += turned.T @ turned
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.where(F.size("embedding") == of.dim).select("embedding").mapInArrow(run, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in sums.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows inv(upper), by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _factor(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor; shifted as long as the matrix is not definite in floating point."""
    d = len(g)
    step = 11 * (n * d + d * (d + 1)) * _ROUNDOFF * np.linalg.norm(g, 2)
    added = step if shift else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + added * np.eye(d)).T
        except np.linalg.LinAlgError:
            added = max(2 * added, step)


@dataclass
class Whitening:
    """What the fit found: moments, component vectors as columns, eigenvalues, their share of the trace, the check."""

    moments: Moments
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.vectors) / np.sqrt(self.eigenvalues)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening components of all vectors; None where there is no direction."""
    of = moments(vectors)
    if of is None:
        return None
    factors: list[np.ndarray] = []

    def turn(rows: np.ndarray) -> np.ndarray:
        for upper in factors:
            rows = solved(rows, upper)
        return rows

    for step in range(3):
        g = gram(vectors, of, turn, of.dim)
        if step == 0 and not np.trace(g) > 0:
            return None
        factors.append(_factor(g, of.n, shift=step == 0))
    r = factors[2] @ factors[1] @ factors[0]
    _, scales, right = np.linalg.svd(r)
    kept = min(components, int((scales > RANK * scales[0]).sum()))
    found = Whitening(of, right[:kept].T.copy(), (scales ** 2 / of.n)[:kept], (scales ** 2 / (scales ** 2).sum())[:kept])
    covariance = gram(vectors, of, found.whitened, kept) / of.n
    found.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return found


_OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    vectors = _vectors(rows)
    found = fit(vectors, components)
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {_OUT}"
    if found is None:
        return rows.sparkSession.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.eigenvalues)
        for batch in _blocks(batches):
            whole = _whole(batch.column(1), found.moments.dim)
            values = found.whitened(found.moments.centred(whole))
            size = len(whole)
            deviations = [Decimal(x) if x < 10 ** 38 else None for x in found.moments.deviations(whole)]
            at = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, found.moments.n)),
                pa.array(deviations, pa.decimal128(38, 0)).take(at), pa.array(values.ravel()), pa.array(np.tile(found.explained, size)),
                pa.array(np.full(size * k, found.identity_error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.where(F.size("embedding") == found.moments.dim).mapInArrow(run, kind)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings on the first eight whitened components."""
    ship(spark)
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
