"""Embeddings as uncorrelated components of unit variance, from an exact scatter matrix.

Entries become whole numbers, so sums and products of all rows are exact; they are computed modulo several primes. A task multiplies its batches modulo each prime as float64 matrices whose products stay below 2 ** 53, so no product is rounded; only residues, as many as the model has entries, leave it. Spark adds the tasks' residues row by row, and the Chinese remainder theorem gives back the whole numbers, for which as many primes are taken as their bound asks for. A column of ones goes with each vector: the same product holds the count, the sums and the scatter. The exact covariance is rounded once, to doubles, and decomposed.

Rows without a vector, with an empty one or with null or non-finite entries are left out, as are vectors of another length than most have (ties: the longest). Rows that repeat count and are returned each; a null vec_id stays. Where a component has no variance (fewer different vectors than dimensions, one row), whitened is null, and it has no part in identity_error; explained is 0 if nothing varies at all. deviation is null if it exceeds a long. An empty table gives an empty result. Columns of other names are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
#: Residues lie between plus and minus half a prime, below 2 ** 20; products of so many rows stay below 2 ** 53.
PRIME_BITS, ROWS_AT_ONCE = 21, 1 << 13
#: An eigenvalue below this share of the largest one, a dimension, is rounding.
NOTHING = 1e-13


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** PRIME_BITS, as many as make their product larger than bound."""
    found, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers, of either sign, with these residues: the ones nearest 0."""
    product = int(np.prod([1], dtype=object))
    for p in moduli:
        product *= p
    total = np.zeros(residues[0].shape, dtype=object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and y (array of long: floor of SCALE times the entries) of the rows that remain."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(v.isNotNull() & (F.size(v) > 0) & finite)
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("y"))


def extent(rows: DataFrame) -> tuple[int, int, int]:
    """The usual length of y, how many rows have it, and their largest entry in size."""
    lengths = rows.groupBy(F.size("y").alias("dims")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("y"), -F.array_min("y"))).alias("most"))
    first = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    return (first.dims, first.n, first.most) if first else (0, 0, 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _summed(parts: DataFrame, values: str, add: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Rows (modulus, at, v) with equal modulus and at added up, as a stream, in the task that they are sent to: a task holds rows of the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for p, at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(2), len(b.column(2)[0])), strict=True):
                    total[p, at] = add(total[p, at], v, p) if (p, at) in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int64()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()))], ["modulus", "at", "v"])

    return parts.repartition("modulus", "at").mapInArrow(run, f"modulus long, at long, v array<{values}>")


def scatter(rows: DataFrame, dims: int, n: int, most: int, rows_at_once: int = ROWS_AT_ONCE) -> np.ndarray:
    """The exact sum of (1, y) times its transpose over all rows, as whole numbers of any size."""
    moduli = primes(2 * n * max(1, most) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, some = [np.zeros((dims + 1, dims + 1), np.int64) for _ in moduli], False
        for b in batches:
            y, some = _matrix(b.column(0), dims), some or b.num_rows > 0
            for begin in range(0, len(y), rows_at_once):
                block = y[begin : begin + rows_at_once]
                for k, p in enumerate(moduli):
                    r = np.ones((len(block), dims + 1))
                    r[:, 1:] = (block + p // 2) % p - p // 2 if most < 1 << 62 else block % p - p * (block % p > p // 2)
                    totals[k] = (totals[k] + (r.T @ r).astype(np.int64)) % p
        if some:
            for p, t in zip(moduli, totals, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([p] * (dims + 1), pa.int64()), pa.array(range(dims + 1), pa.int64()), pa.array(list(t))], ["modulus", "at", "v"])

    parts = rows.select("y").mapInArrow(run, "modulus long, at long, v array<long>")
    # (dims + 1) ** 2 numbers for each prime, whatever the number of rows.
    found = {(r.modulus, r.at): r.v for r in _summed(parts, "long", lambda a, b, p: (a + b) % p).collect()}
    return remaindered([np.array([found[p, k] for k in range(dims + 1)]) for p in moduli], moduli)


class Whitener:
    """n, sums, eigenvalues (falling) and unit components of exact sums of all rows."""

    def __init__(self, gram: np.ndarray, most: int) -> None:
        self.n, self.sums, self.most = int(gram[0, 0]), [int(s) for s in gram[0, 1:]], most
        exact = self.n * gram[1:, 1:] - np.outer(gram[0, 1:], gram[0, 1:])  # n * n times the covariance of centred rows
        v = np.array([[int(x) / (self.n * self.n) for x in row] for row in exact])
        e, u = np.linalg.eigh(v)
        k = min(MOST_COMPONENTS, len(e))
        self.e, self.u = e[::-1][:k], u[:, ::-1][:, :k]
        trace = sum(int(exact[i, i]) for i in range(len(exact))) / (self.n * self.n)
        self.explained = np.clip(self.e, 0, None) / trace if trace else np.zeros(k)
        self.varies = self.e > NOTHING * len(e) * max(e[-1], 0)
        self.weights = np.where(self.varies, self.u / np.sqrt(np.where(self.varies, self.e, 1.0)), 0.0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y minus the sums, exact: as int64 where squares of them add up to less than 2 ** 63, else as Python's whole numbers."""
        small = y.shape[1] * (2 * self.n * max(1, self.most)) ** 2 < 1 << 63
        return y * np.int64(self.n) - np.array(self.sums, np.int64) if small else y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.weights


def fit(rows: DataFrame, dims: int, n: int, most: int) -> Whitener:
    return Whitener(scatter(rows, dims, n, most), most)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity, from the rows themselves."""
    k, dims = len(w.e), len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            x = w.whitened(w.centred(_matrix(b.column(0), dims)))
            ones = np.hstack([np.ones((len(x), 1)), x])
            total += ones.T @ ones
        yield pa.RecordBatch.from_arrays([pa.array([0] * (k + 1), pa.int64()), pa.array(range(k + 1), pa.int64()), pa.array(list(total))], ["modulus", "at", "v"])

    found = {r.at: r.v for r in _summed(rows.select("y").mapInArrow(run, "modulus long, at long, v array<double>"), "double", lambda a, b, _: a + b).collect()}  # k + 1 rows
    total = np.array([found[i] for i in range(k + 1)])
    mean = total[0, 1:] / w.n
    error = np.abs(total[1:, 1:] / w.n - np.outer(mean, mean) - np.eye(k))[np.ix_(w.varies, w.varies)]
    return float(error.max()) if error.size else 0.0


def whiten(vectors: DataFrame) -> DataFrame:
    """One row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = written(usable(vectors), "whole-vectors")
    dims, n, most = extent(found)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = found.filter(F.size("y") == dims)
    w = fit(rows, dims, n, most)
    error, k = identity_error(rows, w), len(w.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = w.centred(_matrix(b.column(1), dims))
            squares = [x if x < 1 << 63 else None for x in ((c * c).sum(axis=1).tolist())]
            times = lambda x: np.tile(x, len(c))
            white = pa.array(w.whitened(c).ravel(), mask=times(~w.varies))
            each = pa.array(np.repeat(np.arange(len(c)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(times(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(c) * k, n)), pa.array(squares, pa.int64()).take(each), white, pa.array(times(w.explained)), pa.array(np.full(len(c) * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "y").mapInArrow(run, schema)


def op11_whitening(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
