"""Scans of collection trees: lines with their collection, file and order.

``seq`` orders the lines of a file set: file path, block start, place in the block. No scan runs in a single task.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = (
    "ts_us bigint, hostname string, identifier string, message string, comm string, exe string, cmdline string, unit string, transport string, pid int, uid int, priority int"
)


def path_of() -> Column:
    return F.col("file_path")


def collection_of(path: Column) -> Column:
    """The innermost directory that is named uac..., else the empty string."""
    return F.regexp_extract(path, r"(?i).*/(uac[^/]*)/", 1)


def order_key() -> Column:
    """seq: file, where its split begins, place in the split."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq")


def scan_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every line under a root, compressed or not: collection, file_path, file_mtime, seq, line."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_mtime"),
        order_key(), F.col("value").alias("line"),
    )
    return rows.withColumn("collection", collection_of(path_of()))


def base_name() -> Column:
    return F.substring_index("file_path", "/", -1)


def scan_rotated_logs(spark: SparkSession, root: str, base: str) -> DataFrame:
    """A rotation set: base, base.N, base.N.gz, base-date.gz and the like."""
    name = base_name()
    return scan_lines(spark, root, f"{base}*").where(name.startswith(base) & (name.endswith(base) | name.rlike(r"\.gz$|\.\d+$")))


def scan_web_logs(spark: SparkSession, root: str) -> DataFrame:
    """Access logs under the web servers' directories, with their daemon."""
    from lumenlog.operators.activity import web_daemon

    rows = scan_lines(spark, root).where(path_of().rlike(r"/var/(?:log/(?:nginx|apache2|httpd)|www)/") & F.lower(base_name()).rlike(r"\.(?:log|txt|gz)$") & F.lower(base_name()).contains("access"))
    return rows.withColumn("daemon", web_daemon(path_of()))


def scan_crontabs(spark: SparkSession, root: str) -> DataFrame:
    where = r"/etc/(?:crontab$|cron\.(?:d|hourly|daily|weekly|monthly)/)|/var/spool/(?:cron|anacron|at)/"
    return scan_lines(spark, root).where(path_of().rlike(where) & ~path_of().rlike(r"\.(?:rpm-orig|dpkg-old)$"))


def history_user(path: Column) -> Column:
    """Owner of a history file: its directory, or what stands before _bash_history."""
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"(?i)/([^/]+)/(?:\.bash_history|bash_history\.txt)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"/([^/]+)_bash_history(?:\.txt)?$", 1), F.lit("")),
        F.lit("unknown"),
    )


HIDDEN_HISTORY = ".bash_history"


def parted(root: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return pa_fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")


def hidden_below(fs: pa_fs.FileSystem, path: str, deep: bool = True) -> Iterator[pa_fs.FileInfo]:
    """History files under the name that shells give them."""
    for info in fs.get_file_info(pa_fs.FileSelector(path, recursive=deep)):
        if info.type == pa_fs.FileType.File and info.base_name == HIDDEN_HISTORY:
            yield info


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder, deep): the folders right below a root, one to a task, and the root's own files."""
    fs, path = parted(root)
    below = [(i.path, True) for i in fs.get_file_info(pa_fs.FileSelector(path)) if i.type == pa_fs.FileType.Directory]
    rows = [(path, False), *below]
    return spark.createDataFrame(rows, "folder string, deep boolean").repartition(len(rows))


def hidden_histories(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the hidden history files of a tree; its folders are listed by tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = parted(root)[0]
        for b in batches:
            found = [i.path for r in b.to_pylist() for i in hidden_below(fs, r["folder"], r["deep"])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    return folders(spark, root).mapInArrow(of, "path string")


STAGED = "source string, target string, size long, copied boolean"


def stage_shell_history(spark: SparkSession, root: str, into: str) -> int:
    """Copy each hidden history file to bash_history.txt under ``into``, a folder that all executors read.

    The folders below the root are dealt to tasks, which list and copy. Folders below the root's parent are kept, so
    collection and owner stay in the path. A copy is written beside its place and moved there, so a lost task leaves
    none half done; a file that is there already, with the same size and not older than its source, is not copied
    again, so a rerun copies what is new. ``into``/_staged lists source, target, size and whether it was copied.
    Gives the number of files. Both paths are of file systems that Arrow knows.
    """
    above, place = os.path.dirname(parted(root)[1].rstrip("/")), parted(into)[1].rstrip("/")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, out = parted(root)[0], parted(into)[0]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for info in hidden_below(fs, r["folder"], r["deep"]):
                    folder = f"{place}/{os.path.dirname(info.path)[len(above) :].lstrip('/')}"
                    target = f"{folder}/bash_history.txt"
                    there = out.get_file_info(target)
                    fresh = there.type == pa_fs.FileType.File and there.size == info.size and there.mtime_ns >= info.mtime_ns
                    if not fresh:
                        out.create_dir(folder, recursive=True)
                        half = f"{folder}/_{uuid.uuid4().hex}"
                        pa_fs.copy_files(info.path, half, fs, out)
                        out.move(half, target)
                    rows.append((info.path, target, info.size, not fresh))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["source", "target", "size", "copied"])

    listed = f"{into.rstrip('/')}/_staged"
    folders(spark, root).mapInArrow(of, STAGED).write.mode("overwrite").parquet(listed)
    return spark.read.schema(STAGED).parquet(listed).count()


def scan_shell_history(spark: SparkSession, root: str) -> DataFrame:
    """History files with their owner. Spark lists no names that start with a dot, so ``stage_shell_history`` lays them
    down first; a tree that holds hidden ones, be there visible ones beside them or not, is an error."""
    if not hidden_histories(spark, root).isEmpty():
        raise FileNotFoundError(f"{root} holds hidden history files: copy them with stage_shell_history")
    return scan_lines(spark, root, "*bash_history*").withColumn("username", history_user(path_of()))


def scan_bodyfile(spark: SparkSession, root: str) -> DataFrame:
    from lumenlog.operators.score import parse_bodyfile

    return parse_bodyfile(scan_lines(spark, root, "*bodyfile*"))


def scan_sha1_list(spark: SparkSession, root: str) -> DataFrame:
    from lumenlog.operators.score import parse_sha1

    return parse_sha1(scan_lines(spark, root, "*.sha1"))


def container_id(path: Column) -> Column:
    return F.regexp_extract(path, r"/containers/([^/]+)/", 1)


def scan_container_configs(spark: SparkSession, root: str) -> DataFrame:
    """One row per configuration file, whole; text that is no JSON is dropped when it is parsed."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "config*.json").text(root, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line")).where(container_id(path_of()) != "")
    return rows.select(collection_of(path_of()).alias("collection"), container_id(path_of()).alias("container_id"), "line")


def scan_container_logs(spark: SparkSession, root: str) -> DataFrame:
    return scan_lines(spark, root, "*-json.log").withColumn("container_id", container_id(path_of()))


def first_existing(lines: DataFrame, names: list[str], artifact: str) -> DataFrame:
    """Of each collection, the lines of the first file of the list that it has: a minimum of ranks, joined back."""
    rank = F.coalesce(*[F.when(base_name() == n, i) for i, n in enumerate(names)])
    ranked = lines.withColumn("rank", rank).where("rank is not null")
    best = ranked.groupBy("collection").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["collection", "rank"], "left_semi").drop("rank").withColumn("artifact", F.lit(artifact))


# File names of live-response dumps, the first that exists counts.
DUMPS = {
    "sockets": ["ss-anp.txt", "ss.txt", "netstat-anp.txt", "netstat.txt"],
    "ip": ["ip_a.txt", "ip_addr.txt", "ifconfig.txt"],
    "route": ["ip_route.txt", "ip_r.txt", "route.txt"],
    "resolv": ["resolv.conf", "resolv_conf.txt", "etc_resolv.conf.txt"],
    "hosts": ["hosts", "hosts.txt", "etc_hosts.txt"],
    "firewall": ["iptables-save.txt", "iptables.txt", "nft_list_ruleset.txt", "nft.txt"],
    "ps": ["ps_aux.txt"],
    "pstree": ["pstree.txt"],
    "lsof": ["lsof.txt"],
    "passwd": ["passwd.txt"],
    "shadow": ["shadow.txt"],
    "sudoers": ["sudoers.txt"],
    "lastlog": ["lastlog.txt"],
    "suid": ["suid_files.txt"],
    "world_writable": ["world_writable.txt"],
    "recent": ["recent_files.txt"],
    "systemd": ["systemd_services.txt"],
    "crontab": ["crontab.txt"],
    "rc_local": ["rc_local.txt"],
    "bashrc": ["bashrc.txt"],
}
DOCKER_EVENTS = ["docker_events.txt", "docker_events.log", "events.json"]


def scan_live_dumps(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    return first_existing(scan_lines(spark, root), DUMPS[artifact], artifact)


def scan_docker_daemon_events(spark: SparkSession, root: str) -> DataFrame:
    lines = scan_lines(spark, root)
    daemon = lines.where(base_name().isin("docker.log", "daemon.log")).withColumn("artifact", F.lit("daemon"))
    return daemon.unionByName(first_existing(lines, DOCKER_EVENTS, "events"))


def scan_journal(spark: SparkSession, root: str) -> DataFrame:
    """Journal entries exported as JSON lines."""
    rows = spark.read.schema(JOURNAL).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").json(root)
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"), order_key()).withColumn("collection", collection_of(path_of()))
