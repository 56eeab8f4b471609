"""Exact deduplication as a stateful stream: a disk-backed state by digest that never expires, and full bytes checked on hits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlog.llm.common import HUB, HUBS, SALTS, materialize, shared_dir

#: Digests of repeated texts that are sent to all tasks at most: 32 MB. More are joined by a shuffle.
SENT = 1_000_000
#: Memory of an executor for all its state stores; what is over lies on disk.
STATE_MB = 256
#: Bytes of files that one batch of the stream takes at most.
BATCH = 64 << 30
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Null as empty, each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(text)


def sha256(text: Column) -> Column:
    """Never null, so that a join does not work it out once more to see that."""
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


@contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that a streaming query copies when it starts; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class ExactDedup:
    """A deduplication that goes on: absorb() reads the files that have come since, members() tells every row's group.

    path: a folder of Parquet files, or one file; home: the state's and the stream's folder, shared by all executors.
    The state holds, for each digest, the smallest id, the place of that row's text (file and row) and the number of rows.
    It is Spark's own streaming aggregate in RocksDB without a watermark: nothing expires, memory is bounded, and a
    lost executor's part is read again from ``home``. Rows are summed in each task before they are shuffled, and a
    row's text is not. digest: of a normalised text; a weak one gives the same groups, as full bytes are compared.
    """

    def __init__(self, spark: SparkSession, path: str, home: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> None:
        self.spark, self.path, self.home, self.digest, self.id_col, self.text_col = spark, path, home.rstrip("/"), digest, id_col, text_col

    @property
    def schema(self) -> StructType:
        return self.spark.read.parquet(self.path).schema

    def rows(self, source: DataFrame) -> DataFrame:
        """id, key, text and place of each row."""
        text = normalised(F.col(self.text_col))
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return source.select(F.col(self.id_col).cast("long").alias("id"), text.alias("text"), place.alias("place")).withColumn("key", self.digest(F.col("text")))

    def absorb(self, batch: int = BATCH) -> None:
        """Take up all files that the state has not met. ``batch``: bytes of files at a time."""
        path = self.path.rstrip("/")
        stream = self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", str(batch)).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file
        # An id that is null comes after all others.
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first")
        state = self.rows(stream).groupBy("key").agg(first, F.count("*").alias("n"))
        settings = {
            "spark.sql.streaming.stateStore.providerClass": STORE,
            "spark.sql.streaming.stateStore.unloadOnCommit": "true",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        }
        with set_for(self.spark, settings):
            query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{self.home}/stream").trigger(availableNow=True).start()
            query.awaitTermination()

    def state(self) -> DataFrame:
        """(key, first, n) of every digest, as the state store has them."""
        held = self.spark.read.format("statestore").load(f"{self.home}/stream")
        first, n = (F.col(f"value.`{c}`") for c in held.schema["value"].dataType.names[:2])
        return held.select(F.col("key.key").alias("key"), first.alias("first"), n.alias("n"))

    def groups(self) -> DataFrame:
        """(key, text, first, n): text is null but where a digest stands for several texts.

        Digests of more than one row are hits: their rows' full texts are compared, by grouping on digest and text.
        Copies are summed where they are read, so one text of many copies is shuffled once for each task.
        """
        state = materialize(self.state(), "state")
        hits = state.where("n > 1").select("key", "n")
        read = self.rows(self.spark.read.schema(self.schema).parquet(self.path))
        few = hits.limit(SENT + 1).count() <= SENT
        found = read.join(F.broadcast(hits.select("key")), "key") if few else spread(read, hits, state.count())
        exact = found.groupBy("key", "text").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"), F.count("*").alias("n"))
        clashes = materialize(exact.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "clashes")
        if clashes.isEmpty():
            return state.withColumn("text", F.lit(None).cast("string"))
        apart = exact.join(clashes, "key", "left_semi")
        return materialize(state.join(clashes, "key", "left_anti").unionByName(apart, allowMissingColumns=True), "groups")

    def members(self) -> DataFrame:
        """One row per row: id, text_sha256, first (id and place of the row that stays), n, kept."""
        groups = self.groups()
        sha = F.lower(F.hex("key")) if self.digest is sha256 else F.sha2(F.col("text").cast("binary"), 256)
        read = self.rows(self.spark.read.schema(self.schema).parquet(self.path)).withColumn("sha", sha)
        joined = spread(read, groups.withColumnRenamed("text", "own"), groups.agg(F.sum("n")).first()[0] or 0)
        right = joined.where(F.col("own").isNull() | (F.col("own") == F.col("text")))
        return right.select("id", F.col("sha").alias("text_sha256"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first.place") == F.col("place")).alias("kept"))


def spread(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows joined to groups (key, n, ...) by key; the rows of a hot group are dealt over SALTS parts.

    A hot group holds over a HUBS-th of all rows, so fewer than HUBS digests are broadcast.
    """
    hubs = F.broadcast(groups.where(F.col("n") > max(HUB, total // HUBS)).select("key", F.lit(True).alias("hot")).distinct())
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).otherwise(0)
    # A digest that stands for several texts has several rows here: all of them go to all of its parts.
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = groups.join(hubs, "key", "left").withColumn("salt", F.explode(parts)).drop("hot")
    return rows.join(hubs, "key", "left").withColumn("salt", salt).drop("hot").join(dealt, ["key", "salt"]).drop("salt")


def deduplicate(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of a Parquet table: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once each run of blanks is one space. The row with the smallest id stays; a null id
    comes last, and of rows of one id the first by file and place stays. A null text is empty; no rows: no rows; other
    columns are ignored.
    """
    run = ExactDedup(spark, path, f"{shared_dir(spark).rstrip('/')}/exact-{uuid.uuid4().hex}", id_col, text_col)
    run.absorb()
    return run.members().select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def deduplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """deduplicate() of any table, which is written down first."""
    written = materialize(docs.select(id_col, text_col), "rows")
    return deduplicate(docs.sparkSession, written.inputFiles()[0].rsplit("/", 1)[0], id_col, text_col)
