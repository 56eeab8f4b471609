"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import bucket_blocks, connected_components, forest, materialize, runs
from lumenlog.llm.vectors import by_length, matrix, usable

THRESHOLD = 0.93
#: Tables, buckets a vector enters in each, and the seed of the sign flips.
TABLES, PROBES, SEED = 6, 4, 20
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two), by butterflies."""
    n, step = x.shape[-1], 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pseudo-random rotation: three rounds of sign flips and a Hadamard transform, padded to a power of two."""
    n = 1 << max(2, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def corners(y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of each row, best first, and how far each falls short of the best."""
    order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :count]
    size = np.take_along_axis(np.abs(y), order, 1)
    axis = 2 * order + (np.take_along_axis(y, order, 1) < 0)
    return axis, size[:, :1] ** 2 - size**2


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket numbers. A bucket is the nearest corners of two cross-polytopes; the probes are
    the pairs of corners that together fall least short of the best pair."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(tables):
        (a, da), (b, db) = (corners(rotate(x, rng), 3) for _ in range(2))
        short = (da[:, :, None] + db[:, None, :]).reshape(len(x), -1)
        pair = (a[:, :, None] * 65536 + b[:, None, :]).reshape(len(x), -1)
        best = np.argsort(short, axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(pair, best, 1))
    return np.stack(out, axis=1).astype(np.int64)


def compare(x: np.ndarray, sig: np.ndarray, table: int, bucket: int, part: np.ndarray, across: bool, threshold: float):
    """Verified links of one block: pairs i < j first met here, and a forest of all links.

    A pair that shares several buckets is counted in the first of them alone, by table and bucket number; in a block
    of two chunks only the pairs across them are counted.
    """
    norm = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(near, False)
    if not near.any():
        return [], np.zeros((0, 2), np.int64)
    tree = forest(len(x), lambda i, rest: near[i, rest])
    if across:
        near &= part[:, None] != part[None, :]
    i, j = np.nonzero(np.triu(near))
    first = np.ones(len(i), bool)
    for lo in range(0, len(i), 65536):
        a, b = sig[i[lo : lo + 65536]], sig[j[lo : lo + 65536]]
        ok = first[lo : lo + 65536]
        for t in range(table + 1):
            same = a[:, t, :, None] == b[:, t, None, :]
            if t == table:
                same &= a[:, t, :, None] < bucket
            ok &= ~same.any(axis=(1, 2))
    return tree, np.stack((i[first], j[first]), axis=1)


def link_vectors(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, links): b null with the number of vectors that a's block links a to, or links 0 for a tree link.

    classes: (node long, label, size long, vec array<double>), vectors distinct.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in by_length(b.column("vec")):
                part = b.take(pa.array(rows))
                sig = buckets(matrix(part.column("vec")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sig.reshape(len(sig), -1).tolist(), pa.list_(pa.int64()))], [*part.schema.names, "sig"])

    signed = classes.withColumn("dims", F.size("vec")).mapInArrow(sign, f"{schema_of(classes)}, dims int, sig array<bigint>")
    signed = materialize(signed, "cross-polytope")
    spread = signed.select("*", F.posexplode("sig").alias("at", "bucket")).withColumn("table", F.floor(F.col("at") / PROBES).cast("int")).drop("at")
    key = ["label", "dims", "table", "bucket"]
    by = [*key, "part_a", "part_b"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, by):
            node, size, part, table, bucket = (t.column(c).to_numpy() for c in ("node", "size", "part", "table", "bucket"))
            pa_, pb_ = t.column("part_a").to_numpy(), t.column("part_b").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]] = []
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                rows = t.slice(lo, hi - lo)
                sig = matrix(rows.column("sig")).astype(np.int64).reshape(hi - lo, -1, PROBES)
                tree, pairs = compare(matrix(rows.column("vec")), sig, int(table[lo]), int(bucket[lo]), part[lo:hi], pa_[lo] != pb_[lo], threshold)
                n = node[lo:hi]
                if len(tree):
                    tree = np.array(tree)
                    out.append((n[tree[:, 0]], n[tree[:, 1]], np.zeros(len(tree), np.int64)))
                if len(pairs):
                    met = np.zeros(hi - lo, np.int64)
                    np.add.at(met, pairs[:, 0], size[lo:hi][pairs[:, 1]])
                    np.add.at(met, pairs[:, 1], size[lo:hi][pairs[:, 0]])
                    out.append((n[met > 0], None, met[met > 0]))
            for a, b, links in out:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64()), pa.array(links)], ["a", "b", "links"])

    blocks = bucket_blocks(spread, key, F.xxhash64("node"), block)
    return blocks.select(*by, "part", "node", "size", "vec", "sig").mapInArrow(of, "a long, b long, links long")


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label link where their cosine in double precision is at least ``threshold``; both ends
    must have the same number of dimensions. Vectors that are null, zero, or hold a null or non-finite component link
    with nothing, nor do those of a null label: n_links 0, component their own id. Exact copies form a class, which is
    compared once; each copy links to its class's others. kept: the vector has its component's smallest id. Rows
    with a null id count as links of others, and return a null kept. Other columns are ignored.
    """
    vec = F.col(vec_col).cast("array<double>")
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"), usable(vec_col).alias("ok"))
    # -0.0 and 0.0 are one value; sha2 of the exact components stands for the vector where only identity matters.
    same = F.when(F.col("ok") & F.col("label").isNotNull(), F.sha2(F.to_json(F.transform("vec", lambda x: x + F.lit(0.0))), 256))
    base = base.withColumn("same", same)
    classes = base.where("same is not null").groupBy("label", "same").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    classes = materialize(classes, "vector-classes")
    nodes = classes.where("node is not null")
    found = materialize(link_vectors(nodes.drop("same"), threshold), "vector-links")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    met = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.select("label", "same", "node", "size").join(met, "node", "left").join(parts, "node", "left")
    known = known.select("label", "same", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = base.select("vec_id", "label", "same").join(known, ["label", "same"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id")
    )
