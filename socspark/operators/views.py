"""Read views, profiles and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from socspark.functions import columns as C


def host_views(events: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """AGG-10: counts, times, accounts and chains of every host, by one explode and one aggregation."""
    rows = events if members is None else events.join(members, "event_id", "left")
    chain = F.lit(None).cast("string") if members is None else F.col("chain_key")
    each = rows.select(F.explode(F.array_distinct(F.transform(C.hosts(), F.upper))).alias("host"), C.micros().alias("us"), F.coalesce("suspicious", F.lit(False)).alias("s"), F.lower(F.nullif("user", F.lit(""))).alias("user"), chain.alias("chain"))
    return each.groupBy("host").agg(F.count(F.lit(1)).alias("events"), F.count_if("s").alias("suspicious"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct("user").alias("users"), F.countDistinct("chain").alias("chains"))


def user_views(events: DataFrame) -> DataFrame:
    """AGG-12: counts, failures, hosts and times of every account."""
    rows = events.where(F.length("user") > 0)
    return rows.groupBy(F.lower("user").alias("user")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce("suspicious", F.lit(False))).alias("suspicious"), F.count_if(F.col("action") == "LOGIN_FAILURE").alias("failed_logons"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(C.hosts())))).alias("hosts"), F.min(C.micros()).alias("first_us"), F.max(C.micros()).alias("last_us"))


def mitre_matrix(mapped: DataFrame) -> DataFrame:
    """AGG-8: occurrences of each technique by tactic."""
    return mapped.groupBy("tactic", "technique").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("event_id").alias("events"))


def funnel(events: DataFrame, members: DataFrame) -> DataFrame:
    """AGG-13 and AGG-14: raw, notable and correlated events, chains, and the reduction from alerts to chains."""
    rows = events.select("event_id", C.is_notable().alias("notable")).join(members, "event_id", "left")
    n = rows.agg(F.count(F.lit(1)).alias("raw"), F.count_if("notable").alias("notable"), F.count_if(F.col("chain_key").isNotNull()).alias("correlated"), F.count_if(F.col("notable") & F.col("chain_key").isNull()).alias("unabsorbed"), F.countDistinct("chain_key").alias("chains"))
    return n.withColumn("reduction", F.when((F.col("chains") > 0) & (F.col("notable") > 0), F.round(1 - F.col("chains") / F.col("notable"), 4)).otherwise(F.lit(0.0)))


def search_events(events: DataFrame, *, event_type: str | None = None, host: str | None = None, user: str | None = None, action: str | None = None, domain: str | None = None, process: str | None = None, notable_only: bool = False, since=None, until=None, limit: int | None = None) -> DataFrame:
    """FLT-4: triage filters; ``limit`` keeps the first by time."""
    low = lambda c: F.lower(F.col(c))
    tests: list[Column] = []
    if event_type:
        tests.append(F.col("event_type") == event_type)
    if host:
        tests.append((F.upper("source_host") == host.upper()) | (F.upper("destination_host") == host.upper()))
    if user:
        tests.append(low("user") == user.lower())
    if action:
        tests.append(F.col("action") == action)
    if domain:
        tests.append(low("domain") == domain.lower())
    if process:
        tests.append(low("process").contains(process.lower()))
    if notable_only:
        tests.append(C.is_notable())
    if since is not None:
        tests.append(F.col("timestamp") >= F.lit(since))
    if until is not None:
        tests.append(F.col("timestamp") <= F.lit(until))
    for t in tests:
        events = events.where(t)
    return events if limit is None else events.orderBy("timestamp", "event_id").limit(limit)


def search_text(events: DataFrame, needle: str) -> DataFrame:
    """FLT-5: case-insensitive substring over the main fields."""
    fields = F.array_compact(F.array("action", "user", "source_host", "destination_host", "process", "domain"))
    return events.where(F.exists(fields, lambda x: F.lower(x).contains(needle.lower())))


def recent_activity(events: DataFrame, minutes: int, host: str | None = None, user: str | None = None) -> DataFrame:
    """FLT-6: the last minutes before the latest event of all."""
    latest = events.agg(F.max(C.micros()).alias("_latest"))
    found = search_events(events, host=host, user=user).join(F.broadcast(latest))
    return found.where(C.micros() >= F.col("_latest") - minutes * 60_000_000).drop("_latest")


def keep_newest(events: DataFrame, n: int, scope: list[str]) -> DataFrame:
    """SNK-3 and TOP-4: the newest events of each scope."""
    w = Window.partitionBy(*scope).orderBy(F.desc("timestamp"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def dedupe_known(events: DataFrame, known: DataFrame) -> DataFrame:
    """JOIN-17: events whose id is new, each id once: the earliest row, of rows of one time the first by all columns."""
    row = F.struct("timestamp", *[c for c in events.columns if c not in ("timestamp", "event_id")])
    once = events.groupBy("event_id").agg(F.min(row).alias("_r")).select("event_id", "_r.*").select(*events.columns)
    return once.join(known.select("event_id"), "event_id", "left_anti")


def first_seen(events: DataFrame) -> DataFrame:
    """AGG-26: count and first time of every domain."""
    return events.where(F.length("domain") > 0).groupBy("domain").agg(F.count(F.lit(1)).alias("queries"), F.min(C.micros()).alias("first_us"))


def ip_host_pairs(events: DataFrame, least: int = 5) -> DataFrame:
    """AGG-28: (ip, host) pairs that occur together often enough, over both sides of an event."""
    pair = lambda ip, host: F.when((F.length(ip) > 0) & (F.length(host) > 0), F.struct(F.col(ip).alias("ip"), F.col(host).alias("host")))
    pairs = events.select(F.explode(F.array_compact(F.array(pair("source_ip", "source_host"), pair("destination_ip", "destination_host")))).alias("p"))
    return pairs.groupBy("p.ip", "p.host").count().where(F.col("count") >= least).withColumnRenamed("count", "n")


def reachability(events: DataFrame, least: int = 3) -> DataFrame:
    """AGG-30: hosts that connected often enough, made symmetric, as sets."""
    moved = (F.col("event_type") == "authentication") & (F.col("source_host") != F.col("destination_host"))
    pairs = events.where(moved).groupBy("source_host", "destination_host").count().where(F.col("count") >= least)
    both = pairs.select(F.col("source_host").alias("host"), F.col("destination_host").alias("peer")).union(pairs.select(F.col("destination_host").alias("host"), F.col("source_host").alias("peer")))
    return both.groupBy("host").agg(F.array_sort(F.collect_set("peer")).alias("peers"))


def entitlements(events: DataFrame) -> DataFrame:
    """AGG-31: hosts that each account signed in to or ran a process on."""
    signed = (F.col("event_type") == "authentication") & (F.coalesce("outcome", F.lit("")) != "failure")
    rows = events.where((F.length("user") > 0) & C.primary_host().isNotNull() & (signed | (F.col("event_type") == "endpoint")))
    return rows.groupBy(F.lower("user").alias("user")).agg(F.array_sort(F.collect_set(F.upper(C.primary_host()))).alias("hosts")).withColumn("privileged", F.col("user").contains("admin"))


def verify_hash_chain(log: DataFrame, log_col: str, seq_col: str, prev_col: str, hash_col: str, body: Column) -> DataFrame:
    """WIN-13: for each log its entries, whether it holds, and the first broken number."""
    w = Window.partitionBy(log_col).orderBy(seq_col)
    bad = (F.col(seq_col) != F.coalesce(F.lag(seq_col).over(w) + 1, F.col(seq_col))) | (F.col(prev_col) != F.coalesce(F.lag(hash_col).over(w), F.lit(""))) | (F.col(hash_col) != F.sha2(F.concat(F.col(prev_col), body), 256))
    rows = log.withColumn("_bad", F.when(bad, F.col(seq_col)))
    return rows.groupBy(log_col).agg(F.count(F.lit(1)).alias("entries"), F.min("_bad").alias("first_broken")).withColumn("intact", F.col("first_broken").isNull())


def precision_recall(predicted: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """EVL-2 over distinct keys."""
    p, t = predicted.select(key).distinct().withColumn("_p", F.lit(True)), labelled.select(key).distinct().withColumn("_t", F.lit(True))
    n = p.join(t, key, "full").agg(F.count_if(F.col("_p") & F.col("_t")).alias("hits"), F.count_if(F.col("_p") & F.col("_t").isNull()).alias("false_alarms"), F.count_if(F.col("_t") & F.col("_p").isNull()).alias("missed"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    return n.select("*", ratio(F.col("hits"), F.col("hits") + F.col("false_alarms")).alias("precision"), ratio(F.col("hits"), F.col("hits") + F.col("missed")).alias("recall"))
