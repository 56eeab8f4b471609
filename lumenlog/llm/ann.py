"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances for what the probes find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, runs
from lumenlog.llm.vectors import by_length, matrix, usable

NEAREST = 10
#: Tables, hash functions of each, buckets visited in each, and the width of a slot in typical distances.
TABLES, FUNCTIONS, PROBES, WIDTH = 8, 8, 120, 1.5
#: Vectors (those whose ids hash lowest) from which the typical distance is taken.
FIT_ROWS = 1000
SEED = 10
#: Index rows and queries of a bucket that meet in one block.
BLOCK = 2048


def directions(table: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, dims])
    return rng.standard_normal((dims, FUNCTIONS)), rng.uniform(0, 1, FUNCTIONS)


def bucket_of(slots: np.ndarray, table: int, dims: int) -> np.ndarray:
    """64-bit name of the bucket with these slots (last axis)."""
    with np.errstate(over="ignore"):
        key = np.full(slots.shape[:-1], np.uint64(table * 1_000_003 + dims))
        for k in range(slots.shape[-1]):
            key = (key ^ slots[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def own_buckets(x: np.ndarray, width: float) -> np.ndarray:
    """(rows, tables): the bucket of each vector in each table."""
    dims, out = x.shape[1], []
    for t in range(TABLES):
        a, b = directions(t, dims)
        out.append(bucket_of(np.floor(x @ a / width + b), t, dims))
    return np.stack(out, axis=1)


def probed_buckets(x: np.ndarray, width: float) -> np.ndarray:
    """(rows, tables * probes): buckets in order of estimated success.

    A neighbour's slot differs from the query's by -1, 0 or 1 per function; the chance of a step falls with the square
    of the query's distance to that edge of its slot, so the sets of steps are visited by the sum of those squares.
    """
    dims, steps, out = x.shape[1], np.array(list(product((-1, 0, 1), repeat=FUNCTIONS))), []
    for t in range(TABLES):
        a, b = directions(t, dims)
        f = x @ a / width + b
        slot = np.floor(f)
        past = f - slot
        cost = np.stack((past**2, np.zeros_like(past), (1 - past) ** 2), axis=1)
        for row, (s, c) in enumerate(zip(slot, cost, strict=True)):
            score = c[steps[:, 0] + 1, 0].copy()
            for k in range(1, FUNCTIONS):
                score += c[steps[:, k] + 1, k]
            best = np.argpartition(score, PROBES)[:PROBES]
            best = best[np.argsort(score[best], kind="stable")]
            if row == 0:
                keys = np.empty((len(x), PROBES), np.int64)
            keys[row] = bucket_of(s + steps[best], t, dims)
        out.append(keys)
    return np.concatenate(out, axis=1)


def typical_distances(rows: DataFrame) -> dict[int, float]:
    """For each number of dimensions, the median distance within a sample of FIT_ROWS vectors.

    The sample has the least hashes of ids. A bound on the hash, from the number of rows, leaves about twice as many in
    all before they are put in order, so that no task sends a whole sample; should repeated ids leave too few, all are
    put in order.
    """
    total, hashed = rows.count(), F.xxhash64("id")
    bound = -(1 << 63) + min((1 << 64) - 1, 2 * FIT_ROWS * (1 << 64) // max(1, total))
    first = lambda some: some.orderBy(hashed, "id").limit(FIT_ROWS).select("vec").collect()
    sample = first(rows.where(hashed <= F.lit(bound)))
    sample = sample if len(sample) >= min(FIT_ROWS, total) else first(rows)
    sizes: dict[int, list] = {}
    for r in sample:
        sizes.setdefault(len(r.vec), []).append(r.vec)
    out = {}
    for dims, vecs in sizes.items():
        x = np.array(vecs)
        sq = (x * x).sum(axis=1)
        d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))[np.triu_indices(len(x), 1)]
        d = d[d > 0]
        out[dims] = float(np.median(d)) if len(d) else 1.0
    return out


def with_buckets(rows: DataFrame, widths: dict[int, float], probes: bool) -> DataFrame:
    """(id, vec, bucket): a row for each bucket that a vector lies in or, with ``probes``, visits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                for at in by_length(b.column("vec")):
                    part = b.take(pa.array(at))
                    x = matrix(part.column("vec"))
                    width = WIDTH * widths.get(x.shape[1], 1.0)
                    keys = probed_buckets(x, width) if probes else own_buckets(x, width)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, keys], ["id", "vec", "buckets"])

    keyed = rows.mapInArrow(of, "id long, vec array<double>, buckets array<bigint>")
    return keyed.select("id", "vec", F.explode("buckets").alias("bucket"))


def nearest_in_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries, ids and distances: each query's k nearest of this block, ties to the smaller id."""
    out, step = [], max(1, 2_000_000 // max(1, x.size))
    names, counts = np.unique(ids, return_counts=True)
    firsts = np.cumsum(counts) - counts
    for lo in range(0, len(q), step):
        d = np.sqrt(((q[lo : lo + step, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        d[own[lo : lo + step, None] == ids[None, :]] = np.inf
        if len(names) < len(ids):  # repeated rows count once, at their smallest distance
            d = np.minimum.reduceat(d[:, np.argsort(ids, kind="stable")], firsts, axis=1)
        kept = ids if len(names) == len(ids) else names
        order = np.lexsort((np.broadcast_to(kept, d.shape), d), axis=1)[:, :k]
        best = np.take_along_axis(d, order, 1)
        row = np.broadcast_to(np.arange(lo, lo + len(d))[:, None], order.shape)
        ok = np.isfinite(best)
        out.append((row[ok], kept[order[ok]], best[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search_buckets(index: DataFrame, probes: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each block that a query visits; the k nearest of all are among them.

    A bucket of many rows or of many queries is cut into blocks of both, every query meeting every row once.
    """
    n = index.groupBy("bucket").agg(F.count("*").alias("n")).join(probes.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
    n = n.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"), F.ceil(F.col("m") / block).cast("int").alias("q_parts"))
    salt = F.xxhash64("id")
    dealt = lambda of, own, all_parts, other: of.join(n, "bucket").select(
        "bucket", F.pmod(salt, own).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(all_parts) - 1)).alias(other), "id", "vec"
    )
    rows = dealt(index, "parts", "q_parts", "q_parts").withColumn("is_query", F.lit(0))
    asks = dealt(probes, "q_parts", "parts", "parts").withColumn("is_query", F.lit(1))
    by = ["bucket", "parts", "q_parts"]
    met = rows.unionByName(asks).repartition(*by).sortWithinPartitions(*by, "is_query")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, by):
            ids, asks = t.column("id").to_numpy(), t.column("is_query").to_numpy()
            found = []
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                mid = lo + int(np.searchsorted(asks[lo:hi], 1))
                if lo == mid or mid == hi:
                    continue
                x = matrix(t.column("vec").slice(lo, hi - lo))
                row, vec, score = nearest_in_block(x[: mid - lo], ids[lo:mid], x[mid - lo :], ids[mid:hi], k)
                found.append((ids[mid:hi][row], vec, score))
            if not found:
                continue
            query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(query):
                continue
            order = np.lexsort((vec, score, query))
            query, vec, score = query[order], vec[order], score[order]
            new = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])]
            query, vec, score = query[new], vec[new], score[new]
            start = np.r_[True, query[1:] != query[:-1]]
            rank = np.arange(len(query)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            keep = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(vec[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    return met.select(*by, "is_query", "id", "vec").mapInArrow(of, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST) -> DataFrame:
    """One row per query and neighbour found: query_id, rank from 1, vec_id, score (Euclidean distance in double).

    Every row of ``rows`` is indexed; a query's candidates are all rows but those of its own id and those of another
    number of dimensions. Vectors (of either side) that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do null ids; a repeated row counts once, at its smallest distance. Ties go to the smaller id. Queries for which the probes
    find fewer than ``k`` rows are compared with every row, in blocks. Other columns are ignored.
    """
    clean = lambda df: df.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows, queries = clean(rows), clean(queries)
    widths = typical_distances(rows)
    index = materialize(with_buckets(rows, widths, False), "ann-index")
    probes = materialize(with_buckets(queries, widths, True), "ann-probes")
    found = materialize(ranked(search_buckets(index, probes, k), k), "ann-found")
    filled = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.join(filled, "id", "left_anti")
    whole = lambda df: df.select("id", "vec", F.size("vec").cast("long").alias("bucket"))
    rest = ranked(search_buckets(whole(rows), whole(short), k), k)
    out = found.join(filled, F.col("query_id") == F.col("id"), "left_semi").unionByName(rest)
    return out.select("query_id", "rank", "vec_id", "score")
