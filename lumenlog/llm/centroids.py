"""Centroid clustering in exact integers; nearest centroids by a progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import forget, materialize
from lumenlog.llm.vectors import matrix

SIZE = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Below this size of a component, sums of distances of a batch fit in 64 bits; above, Python's integers serve.
SAFE = 1 << 20
#: Coefficients, coarse to fine: their number doubles from level to level.
LEVELS = [(0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)]
ROWS_AT_ONCE = 1 << 14
#: Sums travel between tasks in parts of 20 bits, so that none of them overflows.
PART = 20
LONG = (1 << 63) - 1


def usable(name: str) -> Column:
    """Exactly SIZE components, none of them null or not finite; false for a null array."""
    v = F.col(name).cast("array<double>")
    return F.coalesce((F.size(v) == SIZE) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: 64-bit integers, or Python's where a component is large."""
    if not x.size or np.abs(x).max() < SAFE // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    whole = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object)


def walsh(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, its coefficients ordered by their number of sign changes.

    Exact in integers; the squares of a row's coefficients sum up to SIZE times those of the row.
    """
    a, h = rows, 1
    while h < SIZE:
        a = a.reshape(len(rows), -1, 2, h)
        a = np.concatenate((a[:, :, :1] + a[:, :, 1:], a[:, :, :1] - a[:, :, 1:]), axis=2)
        h *= 2
    return a.reshape(len(rows), SIZE)[:, SEQUENCY]


def by_sign_changes() -> np.ndarray:
    """Natural places of the coefficients, by the sign changes of their rows of the Hadamard matrix."""
    k, j = np.arange(SIZE)[:, None], np.arange(SIZE)[None, :]
    signs = np.bitwise_count(k & j) % 2
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


SEQUENCY = by_sign_changes()


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid (ties: the smaller number), and pairs of row and
    centroid that were finished, of all len(rows) * len(centres).

    A pair's partial sum of squared coefficient differences grows from level to level. What is missing lies between
    nothing and twice the two remaining energies (squared norms of the coefficients to come). A centroid whose sum is
    over the least such upper bound of its row is strictly worse than another one and is given up; the rest go on.
    """
    if object in (rows.dtype, centres.dtype):
        rows, centres = rows.astype(object), centres.astype(object)
    v, c = walsh(rows), walsh(centres)
    left_v, left_c = squares(v), squares(c)
    row, centre = (x.ravel() for x in np.meshgrid(np.arange(len(v)), np.arange(len(c)), indexing="ij"))
    total = np.zeros(len(row), v.dtype)
    for lo, hi in LEVELS:
        total = total + squares(v[row, lo:hi] - c[centre, lo:hi])
        left_v, left_c = left_v - squares(v[:, lo:hi]), left_c - squares(c[:, lo:hi])
        if hi == SIZE:
            break
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(total + 2 * (left_v[row] + left_c[centre]), first)
        stay = (total <= least[row]).astype(bool)
        row, centre, total = row[stay], centre[stay], total[stay]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, first)
    won = np.flatnonzero((total == least[row]).astype(bool))
    won = won[np.diff(row[won], prepend=-1) > 0]
    return centre[won], total[won] // SIZE, len(row)


def batches_of(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
            b = whole.slice(lo, ROWS_AT_ONCE)
            rows = integers(matrix(b.column(1)))
            yield b, rows, *nearest(rows, centres)[:2]


def summed(kept: DataFrame, centres: np.ndarray, values: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> list[list[int]]:
    """Exact sums, per centroid, of what ``values`` makes of rows and distances (a matrix of ``width`` columns).

    A task sends one number per centroid, column and 20 bits; Spark adds them up. What reaches the driver does not
    grow with the rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums = [[0] * width for _ in centres]
        for _, rows, cluster, distance in batches_of(batches, centres):
            made = values(rows, distance)
            for k in np.unique(cluster).tolist():
                sums[k] = [a + int(b) for a, b in zip(sums[k], made[cluster == k].sum(axis=0), strict=True)]
        at, part = [], []
        for i, total in enumerate(x for row in sums for x in row):
            level, sign, rest = 0, 1 if total >= 0 else -1, abs(total)
            while rest:
                at.append(i + level * len(centres) * width)
                part.append(sign * (rest & ((1 << PART) - 1)))
                rest, level = rest >> PART, level + 1
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(part, pa.int64())], ["at", "part"])

    out = [[0] * width for _ in centres]
    for r in kept.mapInArrow(of, "at long, part long").groupBy("at").agg(F.sum("part").alias("part")).collect():
        level, i = divmod(r["at"], len(centres) * width)
        out[i // width][i % width] += r["part"] << (PART * level)
    return out


def started(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the least sha256; rows of one id go by their components."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.orderBy(named, "embedding").limit(k).collect()
    return integers(np.array([r.embedding for r in rows], np.float64).reshape(-1, SIZE))


def fit(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after the rounds of assignment and exact floored means; one without vectors stays. kept: (vec_id, embedding)."""
    centres = started(kept, k, seed)
    for _ in range(rounds if len(centres) else 0):
        ones = lambda rows, _: np.concatenate((rows, np.ones((len(rows), 1), rows.dtype)), axis=1)
        sums = summed(kept, centres, ones, SIZE + 1)
        moved = [[x // s[SIZE] for x in s[:SIZE]] if s[SIZE] else old for s, old in zip(sums, centres.tolist(), strict=True)]
        large = max(abs(x) for row in moved for x in row) >= SAFE
        centres = np.array(moved, object if large else np.int64)
    return centres


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def fitting(x: int) -> int | None:
    return x if x <= LONG else None


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly 64 components, none null or not finite; each component x counts as floor(1024 * x).
    Vectors are written down once; each round reads them, sends k centroids along and gets k sums back, so there is no
    shuffle of vectors and no skew, however many share a centroid. Repeated rows count and return again; fewer kept
    vectors than k make as many centroids; no kept vector: no rows. A null id is named by an empty text. Any finite
    component is exact; a distance or inertia that does not fit a long is null.
    """
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = materialize(rows, "vectors")
    centres = fit(kept, k, rounds, seed)
    own = [s[0] for s in summed(kept, centres, lambda _, distance: distance[:, None], 1)] if len(centres) else []
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b, _, at, distance in batches_of(batches, centres):
            of_cluster = lambda values: [values[i] for i in at.tolist()]
            columns = [b.column(0), at, [fitting(d) for d in distance.tolist()], of_cluster([fitting(x) for x in own]), [fitting(sum(own))] * len(at), of_cluster(named)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    return kept.mapInArrow(of, OUT)
