"""Scored candidates: file-system timelines and executable hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import epoch_to_utc, extract, file_ext, file_name, folder_of
from lumenlog.operators.group import carried, top_k
from lumenlog.plans.config import TriageConfig


def plus(a: Column, b: Column) -> Column:
    return a + b


def points(parts: list[tuple[Column, Column]]) -> Column:
    return reduce(plus, [F.when(test, n).otherwise(0) for test, n in parts])


def parse_bodyfile(lines: DataFrame) -> DataFrame:
    """md5|name|inode|mode|uid|gid|size|atime|mtime|ctime|crtime; comments and shorter lines are dropped, epochs <= 0 are null."""
    part = lambda k: F.get("p", F.lit(k))
    epoch = lambda k: F.when(part(k).try_cast("long") > 0, part(k).try_cast("long"))
    rows = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("p", F.split("line", r"\|")).where(F.size("p") >= 11)
    return rows.select(
        "collection", "seq", part(1).alias("path"), F.coalesce(part(6).try_cast("long"), F.lit(0)).alias("size"), part(3).alias("mode"), part(4).alias("uid"), part(5).alias("gid"), part(0).alias("md5"),
        epoch(7).alias("atime"), epoch(8).alias("mtime"), epoch(9).alias("ctime"), epoch(10).alias("crtime"), *carried(lines),
    )


def bodyfile_timeline(entries: DataFrame) -> DataFrame:
    return entries.withColumns({c: epoch_to_utc(F.col(c)) for c in ("atime", "mtime", "ctime", "crtime")})


def score_bodyfile(entries: DataFrame, config: TriageConfig) -> DataFrame:
    path = F.col("path")
    rows = entries.where(
        ~rules.starts_with_any(path, list(config.body_whitelist)) & ~rules.contains_any(path, rules.FRAMEWORK_CACHES) & ~file_ext(path).isin(*rules.BENIGN_EXTENSIONS)
    )
    hint, word, executable = rules.contains_any(path, rules.BODY_PATH_HINTS), rules.contains_any(path, list(config.body_keywords)), file_ext(path).isin(*rules.EXEC_EXTENSIONS)
    large = F.col("size") >= config.body_min_size
    recent = F.coalesce(F.timestamp_seconds("mtime") > F.lit(config.as_of) - F.expr(f"INTERVAL {config.body_recent_days} DAY"), F.lit(False))
    day = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd")
    reasons = F.array_compact(
        F.array(F.when(hint, "PathHint=2"), F.when(word, "Keyword=3"), F.when(executable, "ExecExt=2"), F.when(large, "Size=1"), F.when(recent, F.concat(F.lit("RecentMTime=2("), day, F.lit(")"))))
    )
    scored = rows.withColumns({"keyword": word, "score": points([(hint, 2), (word, 3), (executable, 2), (large, 1), (recent, 2)]), "reasons": F.array_join(reasons, ", ")})
    return scored.where(F.col("score") >= config.body_min_score).where(F.col("keyword") | F.lit(not config.body_require_keyword))


def record_high(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose score is over every earlier one of their key."""
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("best", F.max("score").over(before)).where(F.col("best").isNull() | (F.col("score") > F.col("best"))).drop("best")


def last_of(rows: DataFrame, key: list[str]) -> DataFrame:
    return top_k(rows, key, [F.col("seq").desc()], 1).drop("rank")


def bodyfile_findings(entries: DataFrame, config: TriageConfig) -> DataFrame:
    """Candidates: record scores of a path, the first so many of a folder, and of those the last of each path."""
    scored = score_bodyfile(entries, config).withColumns({"path_key": F.lower("path"), "folder": F.lower(folder_of(F.col("path")))})
    kept = top_k(record_high(scored, ["collection", "path_key"]), ["collection", "folder"], [F.col("seq").asc()], config.body_per_folder).drop("rank")
    return last_of(kept, ["collection", "path_key"]).select("collection", "path", "score", "reasons", "size", F.timestamp_seconds("mtime").alias("mtime"))


def parse_sha1(lines: DataFrame) -> DataFrame:
    """HASH  /path, the hash of 40 characters."""
    pattern = r"^(\S{40})\s+(.+)$"
    return lines.where(F.col("line").rlike(pattern)).select("collection", "seq", extract(F.col("line"), pattern, 1).alias("hash"), F.trim(extract(F.col("line"), pattern, 2)).alias("path"), *carried(lines))


def score_sha1(entries: DataFrame) -> DataFrame:
    """All entries, with whitelisted, score, reasons and severity."""
    path = F.col("path")
    name = F.lower(file_name(path))
    ext = file_ext(name)
    first_prefix = lambda prefixes: F.coalesce(*[F.when(F.lower(path).startswith(p.lower()), p) for p in prefixes])
    high, medium, word = first_prefix(rules.HASH_HIGH_PATHS), first_prefix(rules.HASH_MEDIUM_PATHS), rules.first_match(path, rules.HASH_KEYWORDS)
    known, bare, hidden, world = ext.isin(*rules.HASH_EXTENSIONS), ext == "", name.startswith("."), F.lower(path).rlike("/tmp/|/dev/shm/")
    note = lambda text, value: F.concat(F.lit(text + " ("), value, F.lit(")"))
    reasons = F.array_compact(
        F.array(
            F.coalesce(note("high-interest path", high), note("medium-interest path", medium)), note("suspicious keyword", word), F.when(known, note("suspicious extension", ext)),
            F.when(bare, "no extension"), F.when(hidden, "hidden file"), F.when(world, "world-writable location"),
        )
    )
    place = F.when(high.isNotNull(), 3).when(medium.isNotNull(), 1).otherwise(0)
    score = place + points([(word.isNotNull(), 3), (known, 2), (bare, 1), (hidden, 2), (world, 1)])
    rows = entries.withColumns({"whitelisted": rules.starts_with_any(path, rules.HASH_WHITELIST), "score": score, "reasons": F.array_join(reasons, ", ")})
    return rows.withColumn("severity", F.when(F.col("score") >= 7, "HIGH").when(F.col("score") >= 4, "SUSPICIOUS").otherwise("INFO"))


def sha1_candidates(scored: DataFrame, least: int) -> DataFrame:
    """The best row of each hash: the first to reach the hash's highest score."""
    rows = scored.where(~F.col("whitelisted") & (F.col("score") >= least)).withColumn("hash_key", F.lower("hash"))
    return last_of(record_high(rows, ["collection", "hash_key"]), ["collection", "hash_key"]).select("collection", "hash", "path", "score", "reasons", "severity")


def sha1_stats(scored: DataFrame, least: int) -> DataFrame:
    passing = ~F.col("whitelisted") & (F.col("score") >= least)
    before = Window.partitionBy("collection", F.lower("hash")).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(passing, F.col("score"))).over(before)
    rows = scored.withColumns({"passing": passing, "best": best})
    return rows.groupBy("collection").agg(
        F.count("*").alias("total"), F.count_if("whitelisted").alias("whitelisted"), F.count_if(~F.col("whitelisted")).alias("scored"),
        F.count_if(~F.col("whitelisted") & (F.col("score") < least)).alias("below"), F.count_if(F.col("passing") & F.coalesce(F.col("score") <= F.col("best"), F.lit(False))).alias("duplicates"),
        F.count_distinct(F.when(F.col("passing"), F.lower("hash"))).alias("candidates"),
    )


def sha1_shown(candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k candidates of a collection that score most."""
    return top_k(candidates, ["collection"], [F.col("score").desc(), F.col("path"), F.col("hash")], k)
