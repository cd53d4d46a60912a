"""Nearest neighbours by inner product, through stable projections and a kd-tree.

Largest inner products become nearest points: every vector gets one coordinate more, so
that all have the length of the longest, and a query gets 0 there. DIMENSIONS Gaussian
(2-stable) projections make low-dimensional points whose squared distances are the true
ones times a chi-square variable. A kd-tree over the points of a block yields them in
order of projected distance, leaf by leaf; their true inner products are computed at
once. The search of a block ends when the projected distance of all that is left,
against the distance of the TOP-th best so far, is one that a nearer point would exceed
only with probability 1 - CONFIDENCE.

All rows are indexed in blocks of bounded size. A block's rows go to one task once, which
builds its tree once; the queries, a stated share of the rows, follow in batches, so the
task holds a block and a batch. Every query meets every block: with nearly independent
dimensions the boxes of blocks rule none out, as the stop within a block seldom comes
early. Equal vectors of a block are one point with the ids it stands for, so copies
cannot crowd out others. Recall against brute force is in the README.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Rows repeating an id and vector count once; ties go to the
smaller id. An id with several vectors is a candidate with its best one, and a query
with each of them: of what they find, the best are returned. A table with fewer
candidates than TOP returns all of them. Columns beyond the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickscope.llm.common import written

TOP, QUERY_EVERY = 20, 20
DIMENSIONS, CONFIDENCE, SEED = 8, 0.98, 7
LEAF, LEAVES_AT_ONCE = 64, 4
BLOCK_ROWS, BLOCKS = 16_384, 4  # rows of a block, about, and how many blocks there are at least


def chi_square_at(confidence: float, dimensions: int = DIMENSIONS) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with ``confidence``."""

    def below(x: float) -> float:
        half = x / 2
        return 1 - math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(dimensions // 2))

    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


def projections(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Same on every executor: drawn from a fixed seed."""
    return np.random.default_rng(SEED).standard_normal((length + 1, dimensions))


class Tree:
    """Leaves of a kd-tree, split at medians of the widest coordinate, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        leaves, open_ = [], [np.arange(len(points))]
        while open_:
            rows = open_.pop()
            own = points[rows]
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(spread.argmax())
            if len(rows) <= leaf or spread[axis] == 0:
                leaves.append(rows)
                continue
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            open_ += [rows[order[half:]], rows[order[:half]]]
        self.order = np.concatenate(leaves)
        self.ends = np.cumsum([len(rows) for rows in leaves])
        self.begins = self.ends - [len(rows) for rows in leaves]
        self.low = np.array([points[rows].min(axis=0) for rows in leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in leaves])

    def nearest_leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in order of squared distance of their boxes, and these distances."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        square = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(square, kind="stable")
        return order, square[order]


class Block:
    """One block of rows, ready for queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, own = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        by_point = np.argsort(own.reshape(-1), kind="stable")  # ids of a point stay in order
        self.ids = np.split(ids[by_point], np.cumsum(np.bincount(own.reshape(-1)))[:-1])
        vectors = vectors[first]
        rest = np.sqrt(np.maximum(0, longest ** 2 - np.einsum("ij,ij->i", vectors, vectors)))
        self.matrix = projections(vectors.shape[1])
        tree = self.tree = Tree(np.column_stack([vectors, rest]) @ self.matrix)
        self.vectors, self.longest = vectors[tree.order], longest
        self.ids = [self.ids[i] for i in tree.order]

    def search(self, query_id: int, query: np.ndarray, top: int, limit: float) -> list[tuple[int, float]]:
        leaves, square = self.tree.nearest_leaves(query @ self.matrix[:-1])
        best: list[tuple[float, int]] = []  # (-score, id), in order
        fixed = float(query @ query) + self.longest ** 2
        at = 0
        while at < len(leaves):
            chunk = leaves[at:at + LEAVES_AT_ONCE]
            rows = np.concatenate([np.arange(self.tree.begins[i], self.tree.ends[i]) for i in chunk])
            scores = self.vectors[rows] @ query
            if len(best) >= top:
                rows, scores = rows[scores >= -best[-1][0]], scores[scores >= -best[-1][0]]
            if len(rows) > top:
                cut = np.partition(scores, len(scores) - top)[len(scores) - top]
                rows, scores = rows[scores >= cut], scores[scores >= cut]
            new = [(-s, int(i)) for r, s in zip(rows, scores.tolist()) for i in self.ids[r][:top + 1] if i != query_id]
            best = sorted(best + new)[:top]
            at += LEAVES_AT_ONCE
            if len(best) == top and at < len(leaves):
                distance = max(0.0, fixed + 2 * best[-1][0])
                if square[at] > 0 and square[at] >= limit * distance:
                    break
        return [(i, -s) for s, i in best]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id and a vector of doubles; the most frequent length alone."""
    values = F.col(vector).cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.where(fine & F.exists("vector", lambda x: x != 0)).dropDuplicates(["vec_id", "vector"])
    length = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("vector") == (length["n"] if length else -1))


def nearest(rows: DataFrame, vector: str = "embedding", top: int = TOP, query_every: int = QUERY_EVERY,
            confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id ``query_every`` divides its ``top`` best."""
    kept = written(usable(rows, vector))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = kept.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).first()
    blocks = max(BLOCKS, -(-facts["n"] // BLOCK_ROWS))
    longest, limit = math.sqrt(facts["longest"] or 0.0), chi_square_at(confidence)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    indexed = kept.select("vec_id", "vector", own.alias("block"), F.lit(False).alias("asks"))
    asked = kept.where(F.col("vec_id") % query_every == 0).select(
        "vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, index = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            rows = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)) if batch.num_rows else []
            for i, values, block, asks in zip(
                    batch.column("vec_id").to_pylist(), rows, batch.column("block").to_pylist(), batch.column("asks").to_pylist()):
                if block != at:
                    at, ids, vectors, index = block, [], [], None
                if not asks:
                    ids.append(i)
                    vectors.append(values)
                elif ids:
                    index = index or Block(np.array(ids, dtype=np.int64), np.stack(vectors), longest)
                    out += [(i, other, score) for other, score in index.search(i, values, top, limit)]
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
                ["query_id", "vec_id", "score"])

    # A block's rows come before the queries.
    met = indexed.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
