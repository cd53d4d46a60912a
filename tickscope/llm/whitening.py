"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Vectors become integers, x = floor(256 c), and each distinct one counts once: the fit
list. Its sums S are exact, and its scatter adds up (x - S/n)(x - S/n)^T block by block
inside tasks, then by entry in Spark, so what reaches the driver is one matrix of
dimension x dimension, whatever the number of rows. There a Cholesky factorisation with
diagonal pivoting gives scatter = L L^T, and one-sided Jacobi rotates the columns of L
itself, never forming a product again, until all are orthogonal: their squared norms
are the eigenvalues and the normalised columns the components, small ones with high
relative accuracy. A last pass over the table projects every row.

Dropped: vectors that are null, empty or hold null or non-finite entries (or one beyond
2^38, as sums of a batch must fit a long), and those of another length than most (ties:
the shorter). Repeated rows and null ids are kept, as are copies under other ids; they do
not weigh in the fit. Components of an eigenvalue that is nothing but rounding (below
``RANK`` of the largest) do not exist, so equal or few vectors, and an empty table, give
fewer components or no rows. Equal eigenvalues are numbered as the rotations leave them. A
``deviation`` that no long holds is null. Columns beyond the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import written

SCALE, TOP = 256, 4
LARGEST = float(1 << 38)
RANK = 1e-13
SWEEPS, ORTHOGONAL = 60, 1e-15


def pivoted_cholesky(matrix: np.ndarray, rank: float = RANK) -> np.ndarray:
    """Columns L (rows in the matrix's order) with L L^T = ``matrix``, the largest pivot first.

    Stops where every pivot left is below ``rank`` of the first one: the numerical rank.
    """
    left = np.array(matrix, dtype=float)
    size = len(left)
    out = np.zeros((size, size))
    order = np.arange(size)
    first = left.diagonal().max(initial=0.0)
    for k in range(size):
        pivot = k + int(left.diagonal()[order[k:]].argmax())
        order[[k, pivot]] = order[[pivot, k]]
        at, rest = order[k], order[k + 1:]
        if left[at, at] <= rank * first or left[at, at] <= 0:
            return out[:, :k]
        out[at, k] = np.sqrt(left[at, at])
        out[rest, k] = left[rest, at] / out[at, k]
        left[np.ix_(rest, rest)] -= np.outer(out[rest, k], out[rest, k])
    return out


def orthogonalised(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` after one-sided Jacobi rotations: all orthogonal to each other.

    Rounds of a tournament: each pairs every column with one other and rotates all
    pairs together; a sweep meets all pairs once.
    """
    columns = factor.T.copy()  # one row for each column
    count = len(columns)
    if count < 2:
        return columns.T
    players = list(range(count)) + ([-1] if count % 2 else [])
    half = len(players) // 2
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(a, b) for a, b in zip(players[:half], players[:half - 1:-1]) if a >= 0 and b >= 0]
            i, j = np.array(pairs).T
            a, b = columns[i], columns[j]
            aa, bb, ab = (np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (b, b), (a, b)))
            size = np.sqrt(aa * bb)
            cosine = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, float(cosine.max()))
            turn = cosine > ORTHOGONAL
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            tangent = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, tangent)
            s = c * tangent
            columns[i], columns[j] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
            players.insert(1, players.pop())
        if worst <= ORTHOGONAL * count:
            break
    return columns.T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a positive semidefinite matrix, falling, and its eigenvectors as columns."""
    columns = orthogonalised(pivoted_cholesky(scatter))
    norms = np.sqrt(np.einsum("ij,ij->j", columns, columns))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, columns[:, order] / norms[order]


@dataclass(frozen=True)
class Fit:
    """What the fit list determines; all of its sizes depend on the dimension alone."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of S/n is taken away as an integer first."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exactly."""
        sums = np.array(self.sums, dtype=object)
        if self.n * (np.abs(x).max(initial=0) + 1) < 1 << 60:
            off = x * self.n - np.array(self.sums, dtype=np.int64)
            if (off.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0 ** 62:
                return (off * off).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def integer_vectors(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """The id and ``x`` of every usable row, of any length."""
    values = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return values.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(0).cast("bigint")).alias("x"))


def matrix_of(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def added(vectors: DataFrame, dimension: int, entries, exact: bool = False) -> np.ndarray:
    """The sum of ``entries(x)``, a small matrix, over all batches; with ``exact`` in Python's integers.

    Every task adds up its own batches and hands over one row for each row of the matrix;
    these are dealt by row number and added as they stream in.
    """
    kind, schema = (pa.string(), "i int, part array<string>") if exact else (pa.float64(), "i int, part array<double>")

    def rows_of(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        parts = [[str(v) for v in row] if exact else row for row in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.list_(kind))], ["i", "part"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = entries(matrix_of(batch.column("x"), dimension))
            part = part.astype(object) if exact else part
            total = part if total is None else total + part
        if total is not None:
            yield rows_of(dict(enumerate(total)))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("i").to_pylist(), batch.column("part").to_pylist()):
                part = np.array([int(v) for v in part], dtype=object) if exact else np.array(part)
                total[i] = total[i] + part if i in total else part
        yield rows_of(total)

    parts = vectors.select("x").mapInArrow(within, schema)
    summed = parts.repartition("i").mapInArrow(across, schema).collect()  # one matrix
    return np.array([[int(v) for v in r["part"]] if exact else r["part"] for r in sorted(summed, key=lambda r: r["i"])],
                    dtype=object if exact else float)


def fit(distinct: DataFrame, dimension: int, n: int, top: int = TOP) -> Fit:
    """The fit to distinct integer vectors of one length."""
    sums = added(distinct, dimension, lambda x: x.sum(axis=0, keepdims=True), exact=True)
    start = Fit(n, tuple(sums[0]), np.zeros(0), np.zeros((dimension, 0)), 0.0)

    def scatter(x):
        centred = start.centred(x)
        return centred.T @ centred

    covariance = added(distinct, dimension, scatter) / n
    covariance = (covariance + covariance.T) / 2
    values, components = eigen(covariance)
    return Fit(n, start.sums, values[:top], components[:, :top], float(np.trace(covariance)))


def identity_error(distinct: DataFrame, dimension: int, found: Fit) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    count = len(found.values)

    def scatter(x):
        white = found.whitened(x)
        return white.T @ white

    return float(np.abs(added(distinct, dimension, scatter) / found.n - np.eye(count)).max())


OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
       "identity_error double")


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    vectors = integer_vectors(rows, vector, key)
    distinct = written(vectors.groupBy("x").agg(F.lit(1).alias("one")))
    # The longest list of lengths that matters here is one row.
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    none = rows.sparkSession.createDataFrame([], OUT)
    if not lengths:
        return none
    dimension = lengths[0]["d"]
    own = distinct.where(F.size("x") == dimension)
    found = fit(own, dimension, own.count(), top)
    if not len(found.values):
        return none
    error = identity_error(own, dimension, found)
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(found.values)
        explained = found.values / found.trace
        for batch in batches:
            x = matrix_of(batch.column("x"), dimension)
            size = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(size), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                pa.array(np.full(size * count, found.n, dtype=np.int64)),
                pa.array([d for d in found.deviations(x) for _ in range(count)], pa.int64()),
                pa.array(found.whitened(x).ravel()), pa.array(np.tile(explained, size)),
                pa.array(np.full(size * count, error)),
            ], names)

    return vectors.where(F.size("x") == dimension).mapInArrow(run, OUT)
