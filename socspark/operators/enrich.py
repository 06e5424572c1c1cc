"""Cross-event enrichment: volume, guessing, routine and baselines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from socspark.functions import columns as C
from socspark.plans.config import DetectionConfig
from socspark.plans.schemas import MOVEMENT_ACTIONS
from socspark.plans.storage import stored

SERVICE_ACCOUNT = r"(?i)^(system|local service|network service|anonymous logon|dwm-\d+|umfd-\d+|.*\$)$"
CONSOLE_LOGONS = ("Interactive", "Unlock", "CachedInteractive", "2", "7", "11")


def _tagged(condition: Column, *tags: Column) -> Column:
    old = F.coalesce("tags", F.array().cast("array<string>"))
    return F.when(condition, F.array_union(old, F.array(*tags))).otherwise(old)


def _promoted(groups: DataFrame, keys: list[str], count: int, span_seconds: int) -> DataFrame:
    """Groups of at least ``count`` events whose whole span is short: few rows, from partial sums."""
    found = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ((F.max("_us") - F.min("_us")) / 1e6).alias("_span"), F.array_sort(F.collect_set("destination_host")).alias("_targets"))
    return found.where((F.col("_n") >= count) & (F.col("_span") <= span_seconds))


def dns_volume(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """AGG-1: marks every look-up of a (host, domain) whose whole group is frequent and short."""
    us = events.withColumn("_us", C.micros())
    usable = us.where((F.length("domain") > 0) & (F.length("source_host") > 0) & ~C.is_internal_domain(F.col("domain"))).select("source_host", "domain", "_us", F.lit(None).cast("string").alias("destination_host"))
    found = _promoted(usable, ["source_host", "domain"], config.dns_count, config.dns_span_seconds).drop("_targets")
    out = events.join(found, ["source_host", "domain"], "left")
    hit = F.col("_n").isNotNull()
    text = F.concat(F.lit("finding:"), F.format_string("%d queries for ", "_n"), F.col("domain"), F.lit(" from "), F.col("source_host"), F.format_string(" within %.0fs", "_span"))
    return out.withColumns(
        {
            "tags": _tagged(hit, text, F.lit("beaconing")),
            "suspicious": F.col("suspicious") | hit,
            "severity": F.when(hit, C.raise_severity(F.col("severity"), "medium")).otherwise(F.col("severity")),
            "action": F.when(hit & (F.col("action") == "DNS_QUERY"), F.lit("HIGH_VOLUME_DNS")).otherwise(F.col("action")),
        }
    ).select(*events.columns)


def auth_failures(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """AGG-2: marks the failed logons of an account whose whole group is frequent and short."""
    failed = (F.col("action") == "LOGIN_FAILURE") & (F.length("user") > 0)
    found = _promoted(events.where(failed).withColumn("_us", C.micros()), ["user"], config.failure_count, config.failure_span_seconds)
    out = events.join(found, "user", "left")
    hit = failed & F.col("_n").isNotNull()
    targets = F.when(F.size("_targets") > 0, F.array_join("_targets", ", ")).otherwise(F.lit("unknown hosts"))
    text = F.concat(F.lit("finding:"), F.format_string("%d failed logons for ", "_n"), F.col("user"), F.lit(" across "), targets, F.format_string(" within %.0fs", "_span"))
    return out.withColumns(
        {
            "tags": _tagged(F.coalesce(hit, F.lit(False)), text, F.lit("credential-guessing")),
            "suspicious": F.col("suspicious") | F.coalesce(hit, F.lit(False)),
            "severity": F.when(hit, C.raise_severity(F.col("severity"), "medium")).otherwise(F.col("severity")),
        }
    ).select(*events.columns)


def _repeats(rows: DataFrame, gap: int) -> DataFrame:
    """(event_id, of): logons at most ``gap`` microseconds after the last kept one of the same account and host.

    An account and host are one sorted run, of which a batch and the last kept
    logon are in memory.
    """
    runs = rows.select("user", "_host", "_us", "event_id").repartition("user", "_host").sortWithinPartitions("user", "_host", "_us", "event_id")

    def fold(batches):
        key, kept_us, kept_id = None, 0, None
        for batch in batches:
            found, of = [], []
            for user, host, us, event_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (user, host) != key or us - kept_us > gap:
                    key, kept_us, kept_id = (user, host), us, event_id
                else:
                    found.append(event_id)
                    of.append(kept_id)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(of, pa.string())], names=["event_id", "of"])

    return runs.mapInArrow(fold, "event_id string, of string")


def suppress_privileged(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """WIN-1: privileged logons of service accounts, unnamed accounts and console users, and repeats of the last kept one.

    Service and unnamed accounts need no other row. The rest meets the last and the
    next console sign-in of its account and host, by running maxima in bins of the
    interval's length, to which sign-ins of the bins around are copied; so the work is
    linear and a busy account is split by time. Repeats are found in one pass over each (account, host) in time order.
    """
    privileged = F.col("action") == "PRIVILEGED_LOGIN"
    console = (
        (F.col("action") == "LOGIN_SUCCESS")
        & (F.length("user") > 0)
        & (F.length("destination_host") > 0)
        & F.col("logon_type").isin(*CONSOLE_LOGONS)
        & (F.col("source_ip").isNull() | F.col("source_ip").isin("127.0.0.1", "::1"))
        & (F.col("source_host").isNull() | (F.col("source_host") == F.col("destination_host")))
    )
    width = config.console_hours * 3600 * 1_000_000
    unnamed = F.coalesce(F.length("user"), F.lit(0)) == 0
    told = lambda holds: events.where(holds).select("event_id", "user", C.micros().alias("_us"), C.primary_host().alias("_host"))
    why = F.when(F.col("user").rlike(SERVICE_ACCOUNT), F.lit("routine: privileged logon by a Windows service account")).when(unnamed, F.lit("routine: privileged logon with no named account (computer or system account)"))
    logons = told(privileged).withColumn("_why", why)
    bin_of = F.floor(F.col("_us") / width)
    asking = logons.where("_why is null").withColumns({"_p": F.lit(True), "_bin": bin_of})
    local = told(console).withColumns({"_why": F.lit(None).cast("string"), "_p": F.lit(False), "_bin": F.explode(F.array(bin_of - 1, bin_of, bin_of + 1))})
    keys = [F.lower("user"), F.upper("_host"), F.col("_bin")]
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    sign_in = F.when(~F.col("_p"), F.col("_us"))
    met = asking.unionByName(local).withColumns({"_last": F.max(sign_in).over(upto(F.col("_us"))), "_next": F.min(sign_in).over(upto(F.col("_us").desc()))}).where("_p")
    beside = F.coalesce(F.col("_us") - F.col("_last") <= width, F.lit(False)) | F.coalesce(F.col("_next") - F.col("_us") <= width, F.lit(False))
    met = met.withColumn("_why", F.when(beside, F.lit("routine: privileged logon by this computer's own console user (local sign-in, unlock or administrator approval)")))
    rows = logons.where("_why is not null").unionByName(met.select(*logons.columns))
    gap = config.privileged_repeat_seconds * 1_000_000
    repeats = _repeats(rows.where("_why is null"), gap)
    minutes = config.privileged_repeat_seconds // 60
    marks = rows.where("_why is not null").select("event_id", "_why").unionByName(repeats.select("event_id", F.concat(F.lit("repeat of "), F.col("of"), F.lit(f" (same account and host within {minutes} minutes)")).alias("_why")))
    out = events.join(marks, "event_id", "left")
    return out.withColumn("suppressed", F.when(privileged, F.col("_why")).otherwise(F.col("suppressed"))).select(*events.columns)


def _routine_key() -> list[Column]:
    return [F.lower("user").alias("_u"), F.col("action").alias("_a"), F.upper(F.coalesce(C.primary_host(), F.lit(""))).alias("_h"), C.normalize_command(F.col("command_line"), F.col("process")).alias("_c")]


def mark_routine(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """AGG-3: suppresses low-risk activity that recurs on enough different days."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    able = F.col("action").isin(*MOVEMENT_ACTIONS, "LOGIN_SUCCESS", "DISCOVERY_COMMAND") & (F.length("user") > 0)
    able = able & (C.severity_rank(F.col("severity")) < 3) & ~F.exists(tags, lambda t: t.startswith("sigma:") | t.startswith("intel:"))
    able = F.coalesce(able, F.lit(False))
    keyed = events.select("*", *_routine_key()).withColumn("_able", able)
    days = keyed.where("_able").groupBy("_u", "_a", "_h", "_c").agg(F.countDistinct(F.to_date("timestamp")).alias("_days")).where(F.col("_days") >= config.routine_days)
    out = keyed.join(days, ["_u", "_a", "_h", "_c"], "left")
    text = F.concat(F.lit("routine: same activity by "), F.col("user"), F.format_string(" on %d different days (behaviour baseline)", "_days"))
    return out.withColumn("suppressed", F.when(F.col("_able") & F.col("_days").isNotNull(), F.coalesce("suppressed", text)).otherwise(F.col("suppressed"))).select(*events.columns)


def _learned_from(rows: DataFrame, key: str, config: DetectionConfig) -> DataFrame:
    """(key, _nth): the place (time, id) of each key's event that completes its learning; a rank with a limit, so few rows of a key are shuffled."""
    n = max(1, config.baseline_events)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_us", "event_id"))).where(F.col("_n") <= n)
    return ranked.where(F.col("_n") == n).select(key, F.struct("_us", "event_id").alias("_nth"))


def baseline_anomalies(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """WIN-2 to WIN-5: (event_id, kind) of first sign-ins to a host, unusual hours and first-ever processes.

    An account or host counts as learned after enough events and hours. What an
    event must know of the past of its key is one row of the key: its first
    time, the event that completed its learning, and the first sign-in of each
    hour of the day (24 at most). No window runs over all events of a key.
    """
    host = F.upper(F.coalesce(C.primary_host(), F.lit("")))
    logon = (F.col("event_type") == "authentication") & (F.col("action") != "LOGIN_FAILURE") & F.col("suppressed").isNull()
    base = events.select("event_id", "event_type", "action", C.micros().alias("_us"), F.hour("timestamp").alias("_hour"), F.lower(F.coalesce("user", F.lit(""))).alias("_user"), host.alias("_host"), F.upper("source_host").alias("_src"), F.lower("process").alias("_proc"), F.coalesce(logon, F.lit(False)).alias("_logon"))
    place = F.struct("_us", "event_id")
    learned = (F.col("_nth") < place) & (F.col("_us") - F.col("_start") >= config.baseline_hours * 3_600_000_000)
    start = lambda rows, key: rows.groupBy(key).agg(F.min("_us").alias("_start"))

    users = base.where("_user <> ''")
    signed = users.where(F.col("_logon") & (F.col("_host") != ""))
    seen = signed.select("_user", "_us", "event_id", F.explode(F.array_distinct(F.array_compact(F.array("_host", "_src")))).alias("_h"))
    first = seen.groupBy("_user", "_h").agg(F.min(place).alias("_first"))
    hours = signed.groupBy("_user", "_hour").agg(F.min(place).alias("first")).groupBy("_user").agg(F.collect_list(F.struct(F.col("_hour").alias("hour"), "first")).alias("_hours"))
    past = _learned_from(users, "_user", config).join(start(users, "_user"), "_user").join(hours, "_user", "left")
    able = signed.join(past, "_user").where(learned).withColumn("_known", F.filter("_hours", lambda x: x["first"] < place))
    new_host = able.where(F.col("action").isin(*MOVEMENT_ACTIONS, "LOGIN_SUCCESS")).join(first.select("_user", F.col("_h").alias("_host"), "_first"), ["_user", "_host"]).where(F.col("_first.event_id") == F.col("event_id"))
    odd = able.where((F.size("_known") > 0) & ~F.exists("_known", lambda x: F.abs(x["hour"] - F.col("_hour")) <= 1))

    hosts = base.where("_host <> ''")
    counted = hosts.where((F.col("event_type") != "endpoint") | (F.length("_proc") > 0))
    ran = hosts.where((F.col("event_type") == "endpoint") & (F.length("_proc") > 0))
    first_run = ran.groupBy("_proc").agg(F.min(place).alias("_first"))
    host_past = _learned_from(counted, "_host", config).join(start(hosts, "_host"), "_host")
    # A process has one first run, so few rows are left to meet their hosts.
    new_process = ran.join(first_run, "_proc").where(F.col("_first.event_id") == F.col("event_id")).join(host_past, "_host").where(learned)
    kind = lambda df, k: df.select("event_id", F.lit(k).alias("kind"))
    return kind(new_host, "new-host").unionByName(kind(odd, "unusual-hour")).unionByName(kind(new_process, "new-process"))


def with_anomalies(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """``events`` with ``anomaly:`` tags from `baseline_anomalies`."""
    found = baseline_anomalies(events, config).groupBy("event_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("anomaly:"), "kind"))).alias("_a"))
    out = events.join(found, "event_id", "left")
    return out.withColumn("tags", F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("_a", F.array().cast("array<string>")))).select(*events.columns)


def enrich(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """DET-10 without rules: volume, guessing, privileged suppression, baselines, routine; written between, as each reads its events more than once."""
    out = stored(auth_failures(dns_volume(events, config), config), "frequent")
    out = stored(suppress_privileged(out, config), "privileged")
    return mark_routine(stored(with_anomalies(out, config), "with-anomalies"), config)
