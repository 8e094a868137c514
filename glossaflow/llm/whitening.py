"""Whitening of embeddings by moments that are merged pair by pair.

Entries become whole numbers first (``floor(64 * c) + 1000000``), so that sums
are exact. Then:

1. each partition computes the count, the mean and the centred scatter of its
   rows, batch by batch, and ``treeReduce`` merges two such moments at a time
   (Chan's formula), so nothing is squared before it is centred and no more
   than a matrix of the dimension's square leaves a task;
2. the driver takes the eigenvectors of the covariance, whose size follows from
   the dimension alone;
3. a second pass over the rows takes the same moments of the whitened values
   and measures how far their covariance is from the identity.

No pass shuffles rows, and lost tasks are computed again from the table.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite
entry, have no result, nor have rows of another length than most rows have (of
lengths that are equally frequent, the greatest; empty vectors count as no
length); repeated rows count as often as they occur, and have a result each; a
null id is kept. Components whose eigenvalue is not above ``RANK`` of the
greatest have no direction of their own and are left out, so equal rows have
none, and a table without rows has no result. Entries so large that their
whole number is beyond 2^52 in size are treated as non-finite. A deviation
beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossaflow.plans.scratch import bounded_batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
RANK = 1e-12
_LARGEST = float(1 << 46)  # of an entry, so that whole numbers are exact as doubles
_ROWS = 1024


@dataclass(frozen=True)
class Moments:
    """Count, exact sums, mean and centred scatter of rows."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray, exact: bool) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        # Rounding leaves the centred rows a mean of their own, which the scatter loses here.
        rest = centred.sum(axis=0)
        sums = tuple(int(s) for s in x.astype(np.int64).astype(object).sum(axis=0)) if exact else ()
        return Moments(len(x), sums, mean + rest / len(x), centred.T @ centred - np.outer(rest, rest) / len(x))

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, tuple(a + b for a, b in zip(self.sums, other.sums, strict=True)), self.mean + step * (other.n / n), scatter)


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: ``axes`` has a unit eigenvector in each column."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s // self.n for s in self.sums], np.float64), np.array([s % self.n / self.n for s in self.sums])
        return ((x - mean[0] - mean[1]) @ self.axes) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)^2, exact."""
        whole = x.astype(np.int64)
        most = max((self.n * int(np.abs(whole[:, k] - s // self.n).max(initial=0)) + self.n for k, s in enumerate(self.sums)), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 63 and self.n * int(np.abs(whole).max(initial=0)) < 1 << 62:
            return np.square(self.n * whole - np.array(self.sums, np.int64)).sum(axis=1).tolist()
        found = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in whole)
        return [d if d < 1 << 63 else None for d in found]


def usable(vector: str) -> Column:
    """Whether all entries are there and finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST)), F.lit(False)) & (F.size(vector) > 0)


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows of the most frequent length, with their vectors as whole numbers (double)."""
    kept = rows.filter(usable(vector))
    lengths = kept.groupBy(F.size(vector).alias("k")).count().agg(F.max(F.struct("count", "k")).alias("m")).first()["m"]
    size = lengths["k"] if lengths else 0
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("double") + SHIFT)
    return kept.filter(F.size(vector) == size).withColumn(vector, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(rows: DataFrame, vector: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments | None:
    """The moments of all vectors less ``SHIFT``, or of what ``change`` makes of the vectors; None of no rows."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Moments | None = None
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                x = _matrix(b.column(0).slice(at, _ROWS))
                own = Moments.of(change(x) if change else x - SHIFT, exact=change is None)  # small numbers lose least
                held = held.merge(own) if held else own
        if held:
            row = [held.n], [[str(s) for s in held.sums]], [held.mean.tobytes()], [held.scatter.tobytes()]
            kinds = pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["n", "sums", "mean", "scatter"])

    def read(row) -> Moments:
        mean = np.frombuffer(row["mean"])
        return Moments(row["n"], tuple(map(int, row["sums"])), mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)))

    def both(a: Moments | None, b: Moments | None) -> Moments | None:
        return a.merge(b) if a and b else a or b

    parts = rows.select(vector).mapInArrow(partition, "n bigint, sums array<string>, mean binary, scatter binary").rdd.map(read)
    return parts.treeAggregate(None, both, both)


def fit(whole: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Eigenvectors of the covariance of all rows of ``whole_numbers``, by falling eigenvalue."""
    found = moments(whole, vector)
    if found is None:
        return None
    covariance = found.scatter / found.n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    real = int((values > RANK * max(values[0], 0)).sum()) if values[0] > 0 else 0
    # Centred values are known to some 1e-16 of the mean; what is below that is no variance.
    real = min(real, int((values > (1e-15 * float(np.abs(found.mean).max())) ** 2).sum()), components)
    return Whitening(found.n, tuple(s + found.n * SHIFT for s in found.sums), axes[:, :real].copy(), values[:real].copy(), float(np.trace(covariance)))


def identity_error(whole: DataFrame, learnt: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    found = moments(whole, vector, learnt)
    return float(np.abs(found.scatter / found.n - np.eye(len(found.mean))).max(initial=0.0)) if found else 0.0


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: the id, component, n, deviation, whitened, explained, identity_error.

    Only the id and the vector are read, so no other column can clash with a result.
    """
    spark = rows.sparkSession
    bounded_batches(spark, rows=4096)
    whole = whole_numbers(rows.select(F.col(row_id).alias("vec_id"), F.col(vector).alias("embedding")))
    learnt = fit(whole, "embedding", components)
    kind = whole.schema["vec_id"].dataType
    schema = StructType().add("vec_id", kind).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if learnt is None or not len(learnt.values):
        return spark.createDataFrame([], schema)
    error = identity_error(whole, learnt, "embedding")
    k = len(learnt.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, shares = np.arange(1, k + 1, dtype=np.int32), learnt.values / learnt.trace
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                x = _matrix(part.column(1))
                rows = len(x)
                places = np.repeat(np.arange(rows), k)
                deviation = pa.array(learnt.deviations(x), pa.int64())
                columns = [
                    part.column(0).take(pa.array(places)), pa.array(np.tile(numbers, rows)), pa.array(np.full(rows * k, learnt.n)), deviation.take(pa.array(places)),
                    pa.array(learnt(x).ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return whole.select("vec_id", "embedding").mapInArrow(run, schema)
