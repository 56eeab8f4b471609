"""Helpers that several corpus operators share: tables, durable cuts of lineage, hash buckets and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_state: dict = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks: one object, so the caches of operators in a row do not add up."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def forget() -> None:
    """Give the worker's kept object up, before work that makes no use of it."""
    if _state:
        _state.clear()
        release()


def release() -> None:
    """Give freed memory back to the system, where it can: an executor's idle Python workers hold theirs side by side."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, in a local session alone, a folder of our own.

    On a cluster an executor's own folder would hold a part of each table that no other machine reads: an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can be lost after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lean(spark: SparkSession) -> SparkSession:
    """Texts go to Python in batches of a thousand rows at most: two sides of an executor hold each batch.

    Spark reads this setting when a plan runs, which is after an operator has returned it, and knows it for a session
    only; so the session keeps it. A smaller value that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")
    return spark


def text_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes, null as empty: Python then neither decodes nor meets ill-formed strings."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


#: Parts that a hub's links are dealt to. A hub has over HUB links and over a HUBS-th part of all, so there are fewer
#: than HUBS of them, whatever the graph.
SALTS, HUB, HUBS = 64, 64, 1000


def spread_join(links: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """links (u, v) with the least (m) of their u; least: (u, m, n), n the number of links of u; rows bounds the links.

    The links of a hub are dealt by u and a hash of v, and its row of ``least`` goes to each part, so no task gets all
    links of one hub. Hubs are broadcast, fewer than HUBS numbers.
    """
    is_hub = F.col("n") > max(HUB, rows // HUBS)
    hubs = F.broadcast(least.where(is_hub).select("u", F.lit(True).alias("hub")))
    salted = links.join(hubs, "u", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub")
    parts = F.when(is_hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(least.select("u", "m", F.explode(parts).alias("salt")), ["u", "salt"]).drop("salt")


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    links: (a long, b long), any order, repeats and loops allowed, rows with a null ignored.
    Returns (node, component) for every node that has a link; component is the smallest node reachable.
    Each step is a grouped minimum, which is summed up before it is shuffled, and an equi-join that spreads each hub
    over SALTS parts; nothing passes through the driver but a row count, a checksum and the hubs.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = materialize(edges, "links"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == (state.n, state.x):
            break
        seen, before = (state.n, state.x), edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = spread_join(both.where("v > u"), least, 2 * state.n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, 2 * state.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def bucket_blocks(rows: DataFrame, key: list[str], split_by: Column, block: int) -> DataFrame:
    """Deal the rows of shared buckets into blocks that one task can compare, losing no pair.

    key: the columns that name a bucket. Buckets of one row are dropped (they hold no pair). A bucket of more than
    ``block`` rows is cut into chunks by ``split_by``; each pair of chunks is a block of its own, so that any two rows
    of a bucket meet in one block and no block grows with the bucket. Adds part_a <= part_b, naming the block, and
    part, the chunk of the row; the result is partitioned and sorted by block.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1")
    parts = F.ceil(F.col("bucket_rows") / block).cast("int")
    met = rows.join(sizes, key).withColumn("parts", parts).withColumn("part", F.pmod(split_by, F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("*", F.explode(other).alias("other")).withColumns(
        {"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")}
    )
    by = [*key, "part_a", "part_b"]
    return met.drop("bucket_rows", "parts", "other").repartition(*by).sortWithinPartitions(*by)


def runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a sorted stream of batches where the key changes: yields tables of whole groups and their start offsets.

    The rows of a group that is still open are carried over to the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in key):
            change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        last = int(cuts[-1])
        done = [*held, batch.slice(0, last)]
        held = [batch.slice(last)]
        table = pa.Table.from_batches([b for b in done if b.num_rows])
        yield table, starts_of(table, key)
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts_of(table, key)


def starts_of(table: pa.Table, key: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in key:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def forest(n: int, near) -> list[tuple[int, int]]:
    """Tree links that join whatever is connected among 0..n-1. near(i, rest): mask of ``rest`` that i links to."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                out += [(i, int(j)) for j in found]
                queue += found.tolist()
                rest = rest[~hit]
    return out
