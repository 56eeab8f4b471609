"""Sessions: pairing of opens and closes, types, suspicion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import is_local_ip
from lumenlog.operators.prefix import BITS, Running, block_of, running


def session_type(user: Column, ip: Column, daemon: Column, seconds: Column) -> Column:
    """ip is N/A where there is none; seconds is null while a session goes on."""
    low = F.lower(daemon)
    local = ip.isin("", "N/A") | ip.startswith("127.")
    quick = lambda most: F.coalesce(seconds <= most, F.lit(False))
    return (
        F.when(low.contains("cron") | low.contains("atd"), "CronJob")
        .when(low.contains("systemd"), "SystemdSession")
        .when(quick(2) & (local | ip.startswith("::1")), "SudoCommand")
        .when(low.contains("ssh") & ~local, "SshInteractive")
        .when(low.contains("su") & quick(5), "SuCommand")
        .when(F.lower(user).isin(*rules.SERVICE_ACCOUNTS), "ServiceAuth")
        .otherwise("PamGeneric")
    )


def link_by_pid(actions: DataFrame, bits: int = BITS) -> DataFrame:
    """Opens and closes of a login's own process: a close takes the address of the latest accepted login of its host and
    pid, which is an as-of join, as pids are used again; an open that follows such a login is that login, and goes.

    actions: with host and pid. Rows without a pid stay as they are. In two passes, so no task holds a pid.
    """
    marks = F.when(F.col("action") == "accepted", F.col("address"))
    over = F.when(F.col("action") == "closed", F.lit("")).otherwise(marks)  # a close ends what its process was accepted for
    rows = actions.where(F.col("pid") != "").withColumn("nth", nth())
    linked = running(rows, ["collection", "host", "pid"], [Running("login", over, "last")], ["seq", "nth"], "before", bits=bits)
    found = F.coalesce(F.col("login"), F.lit("")) != ""
    kept = linked.where(~(found & (F.col("action") == "opened")))
    address = F.when(found & (F.col("action") == "closed"), F.col("login")).otherwise(F.col("address"))
    return kept.withColumn("address", address).select(*actions.columns).unionByName(actions.where(F.coalesce(F.col("pid"), F.lit("")) == ""))


def nth() -> Column:
    """One line may open twice (session and login); a second order column keeps that order total."""
    return F.when(F.col("action") == "closed", 1).when(F.col("action") == "opened", 0).otherwise(2)


def pair_sessions(actions: DataFrame, bits: int = BITS) -> DataFrame:
    """Opens (and accepted logins) with their closes: a close ends the latest session of its key that is still open.

    Key: collection, user, ip or none, daemon. The balance of opens and closes, less its running minimum, is the depth
    of a stack; within a key and depth an open is ended by the next close. Closes that end nothing are dropped; a
    session without a close has a null end.
    No task holds a key. A block of a key's rows is summed up as a string of brackets is, by its balance and its least
    prefix, and one such row per block goes through a window over the key. Opens that end within their block are
    matched there; of what is left, a depth has two rows a block at most, and only these meet across blocks.
    """
    kind = F.when(F.col("action").isin("opened", "accepted"), 1).when(F.col("action") == "closed", -1)
    rows = actions.where(kind.isNotNull()).select(
        "collection", F.col("who").alias("user"), F.when(F.col("address") == "", "N/A").otherwise(F.col("address")).alias("ip"), "daemon", "seq", nth().alias("nth"), "ts", kind.alias("kind")
    )
    key = ["collection", "user", "ip", "daemon"]
    rows = rows.withColumn("block", block_of(rows, bits=bits))
    blocks = [*key, "block"]
    order = Window.partitionBy(*blocks).orderBy("seq", "nth")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("balance", F.sum("kind").over(so_far))
    rows = rows.withColumn("least", F.min("balance").over(so_far))
    # Balance and least prefix of a block, then of all before it: the sum, and the least of sum and prefix so far.
    whole = rows.groupBy(*blocks).agg(F.sum("kind").alias("own"), F.min("balance").alias("dip"))
    over = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("base", F.coalesce(F.sum("own").over(over), F.lit(0)))
    whole = whole.withColumn("floor", F.least(F.lit(0), F.min(F.col("base") + F.col("dip")).over(over))).select(*blocks, "base", "floor")
    rows = rows.join(whole, blocks)
    before = F.least("floor", F.col("base") + F.lag("least").over(order))
    rows = rows.withColumns({"balance": F.col("base") + F.col("balance"), "least": F.least("floor", F.col("base") + F.col("least")), "before": before})
    rows = rows.where(~((F.col("kind") == -1) & (F.col("balance") < F.col("before"))))
    rows = rows.withColumn("depth", F.when(F.col("kind") == 1, F.col("balance") - F.col("least")).otherwise(F.col("balance") - F.col("least") + 1))
    rows = rows.select(*blocks, "depth", "seq", "nth", "ts", "kind")
    level = Window.partitionBy(*blocks, "depth").orderBy("seq", "nth")
    following = F.struct("kind", "ts", "seq")
    rows = rows.withColumns({"next": F.lead(following).over(level), "previous": F.lag("kind").over(level)})
    left = F.when(F.col("kind") == 1, F.col("next").isNull()).otherwise(F.col("previous").isNull())
    # Rows matched in their block stay in groups of a block; those left form one group for a key and depth.
    rows = rows.withColumn("group", F.when(~left, F.col("block")))
    across = Window.partitionBy(*key, "depth", "group").orderBy("seq", "nth")
    rows = rows.withColumn("next", F.coalesce("next", F.lead(following).over(across)))
    closed = F.col("next.kind") == -1
    opened = rows.where("kind = 1").select(
        *key, "seq", F.col("nth").cast("int").alias("nth"), F.col("ts").alias("start_ts"), F.when(closed, F.col("next.ts")).alias("end_ts"), F.when(closed, F.col("next.seq")).alias("end_seq")
    )
    seconds = F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")
    return opened.withColumn("seconds", seconds).withColumn("type", session_type(F.col("user"), F.col("ip"), F.col("daemon"), F.col("seconds")))


def running_failures(actions: DataFrame, bits: int = BITS) -> DataFrame:
    """Failed logins with their number so far from that source (W6), in two passes, so no task holds a source."""
    return running(actions.where("action = 'failed'"), ["collection", "address"], [Running("attempt", F.lit(1))], bits=bits)


def session_suspicion(sessions: DataFrame, actions: DataFrame, threshold: int, bits: int = BITS) -> DataFrame:
    """Closed sessions and failed logins with the first reason that holds; ongoing sessions are not judged.

    Failures before a session's close are a running count over the source, failures and closes in one order (J2).
    """
    failed = actions.where("action = 'failed'")
    marks = failed.select(
        "collection", F.col("address").alias("ip"), "seq", F.lit(1).alias("failed"), F.col("who").alias("user"), "daemon", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"),
        F.lit(0).cast("bigint").alias("seconds"), F.lit("SshFailed").alias("type"), F.col("seq").alias("from_seq"),
    )
    closed = sessions.where("end_seq is not null").select(
        "collection", "ip", F.col("end_seq").alias("seq"), F.lit(0).alias("failed"), "user", "daemon", "start_ts", "end_ts", "seconds", "type", F.col("seq").alias("from_seq")
    )
    both = running(closed.unionByName(marks), ["collection", "ip"], [Running("failures", F.col("failed"))], frame="ties", bits=bits)
    rows = both.withColumn("failures", F.col("failures").cast("bigint"))
    ssh, user = F.col("type") == "SshInteractive", F.lower("user")
    away = (F.col("ip") != "N/A") & ~F.col("ip").startswith("127.") & ~F.col("ip").startswith("::1")
    reason = (
        F.when(user.isin(*rules.SERVICE_ACCOUNTS) & ssh, "ServiceAccountSSH")
        .when((user == "root") & ssh & away, "RootSSH")
        .when((F.col("seconds") < 1) & ssh & (F.col("ip") != "N/A") & ~is_local_ip(F.col("ip")), "VeryShortWithIP")
        .when(ssh & F.hour("start_ts").between(2, 4), "UnusualTime")
        .when((F.col("ip") != "N/A") & (F.col("failures") >= 2 * threshold), "MultipleFailures")
    )
    notes = (
        F.when(F.col("reason") == "ServiceAccountSSH", "Service account with SSH session")
        .when(F.col("reason") == "RootSSH", "Direct root SSH login")
        .when(F.col("reason") == "VeryShortWithIP", "Very short SSH session from external IP")
        .when(F.col("reason") == "UnusualTime", F.concat(F.lit("Interactive session at unusual time ("), F.hour("start_ts").cast("string"), F.lit(":00)")))
        .when(F.col("reason") == "MultipleFailures", F.concat(F.lit("IP has "), F.col("failures").cast("string"), F.lit(" failed attempts before this success")))
    )
    tried = F.col("failed") == 1
    many = F.col("failures") >= threshold
    judged = rows.withColumn("reason", F.when(tried, F.when(many, "MultipleFailures")).otherwise(reason))
    attempt = F.when(many, F.concat(F.lit("Failed attempt #"), F.col("failures").cast("string"), F.lit(" from this IP"))).otherwise("Failed authentication")
    judged = judged.withColumn("notes", F.when(tried, attempt).otherwise(notes))
    return judged.select("collection", "ip", "failures", "user", "daemon", "start_ts", "end_ts", "seconds", "type", F.col("from_seq").alias("seq"), "reason", "notes")


def all_sessions(sessions: DataFrame, judged: DataFrame) -> DataFrame:
    """Ongoing sessions beside the judged ones, in one shape."""
    ongoing = sessions.where("end_seq is null").select(
        "collection", "ip", F.lit(0).cast("bigint").alias("failures"), "user", "daemon", "start_ts", "end_ts", "seconds", "type", "seq",
        F.lit(None).cast("string").alias("reason"), F.lit("").alias("notes"),
    )
    return judged.unionByName(ongoing)


def session_stats(sessions: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("type") == t)
    return sessions.groupBy("collection").agg(
        F.count("*").alias("total"), F.count_if(F.col("reason").isNotNull()).alias("suspicious"), of("SshInteractive").alias("ssh"), of("SshFailed").alias("failed"),
        of("SudoCommand").alias("sudo"), of("CronJob").alias("cron"), F.count_distinct(F.when(F.col("ip") != "N/A", F.col("ip"))).alias("ips"),
    )


def sessions_grouped(sessions: DataFrame) -> DataFrame:
    rows = sessions.where(~F.col("type").isin("CronJob", "SystemdSession", "PamGeneric"))
    first = F.when(F.col("reason").isNotNull(), F.col("seq"))  # of suspicious sessions
    return rows.groupBy("collection", "user", "ip", "daemon", "type").agg(
        F.count("*").alias("n"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"), F.floor(F.avg(F.coalesce("seconds", F.lit(0)))).cast("bigint").alias("avg_seconds"),
        F.bool_or(F.col("reason").isNotNull()).alias("suspicious"), F.min_by("reason", first).alias("reason"),
        F.coalesce(F.min_by("notes", first), F.lit("")).alias("notes"),
    )
