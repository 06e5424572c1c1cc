"""Checks and listings for a case, and tables derived from a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from socspark.functions import columns as C

# Actions that make a group of events a case.
ESCALATING_ACTIONS = ("CREDENTIAL_ACCESS", "MALICIOUS_ATTACHMENT", "SUSPICIOUS_DOMAIN", "REMOTE_SERVICE_EXEC")
# The weight of a mapping's confidence.
CONFIDENCE_WEIGHTS = {"high": 0.9, "medium": 0.65, "low": 0.4}

# Fields that hold a record's time, in order, and the texts that stand for a missing host and code.
TIME_FIELDS = ("_time", "timestamp", "UtcTime")
ABSENT = {"host": "?", "EventCode": "-"}


def triage_chains(rows: DataFrame) -> DataFrame:
    """AGG-20: severity of each chain and whether it is worth a case, from its flagged events.

    Whether there are several hosts or accounts follows from the smallest and
    largest name, so the state of a group is small whatever its size.
    """
    flagged = F.coalesce("suspicious", F.lit(False))
    escalates = flagged & F.coalesce(F.col("action").isin(*ESCALATING_ACTIONS), F.lit(False))
    names = F.when(flagged, C.hosts())
    user = F.nullif("user", F.lit(""))
    out = rows.groupBy("chain_key").agg(
        F.count_if(flagged).alias("flagged"),
        F.array_sort(F.collect_set(F.when(escalates, F.col("action")))).alias("escalating"),
        F.bool_or(flagged & F.coalesce(F.col("severity") == "critical", F.lit(False))).alias("critical"),
        (F.min(F.array_min(names)) != F.max(F.array_max(names))).alias("_hosts"),
        F.coalesce(F.min(user) == F.max(user), F.lit(False)).alias("single_account"),
    )
    several, any_action = F.coalesce("_hosts", F.lit(False)), F.size("escalating") > 0
    severity = F.when(F.col("critical") & several, "critical").when(F.col("critical") | (any_action & several), "high").when(any_action, "medium").otherwise("low")
    return out.select("chain_key", "flagged", "escalating", "critical", several.alias("multi_host"), "single_account", severity.alias("severity"), (any_action | F.col("critical")).alias("open_case"))


def technique_best(mapped: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """AGG-9: one row for each technique, with its most confident mapping (the smallest event id of equals)."""
    weight = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in CONFIDENCE_WEIGHTS.items()], F.lit(0.0))
    best = F.min_by(F.struct("event_id", "tactic", "confidence"), F.struct((-weight).alias("w"), "event_id"))
    out = mapped.groupBy(*(scope or []), "technique").agg(best.alias("b"), F.count(F.lit(1)).alias("mappings"), F.round(F.avg(weight), 4).alias("mean_weight"))
    return out.select(*(scope or []), "technique", "b.tactic", "b.event_id", "b.confidence", "mappings", "mean_weight")


def factor_counts(links: DataFrame) -> DataFrame:
    """AGG-19: how many links each factor carries, and the best score among them."""
    each = links.select("score", F.explode(F.transform("factors", lambda f: f["name"])).alias("factor"))
    return each.where("factor <> 'time_proximity'").groupBy("factor").agg(F.count(F.lit(1)).alias("links"), F.max("score").alias("best"))


def links_for_event(links: DataFrame, events: DataFrame, event_id: str, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """FLT-7: the links of one event, best first, each with a line about its other end."""
    mine = links.where((F.col("source_event_id") == event_id) | (F.col("target_event_id") == event_id)).where(F.col("score") >= least)
    other = F.when(F.col("source_event_id") == event_id, F.col("target_event_id")).otherwise(F.col("source_event_id"))
    found = mine.select(other.alias("event_id"), "score")
    out = found.join(events.select("event_id", C.event_summary().alias("summary")), "event_id")
    return out if limit is None else out.orderBy(F.desc("score"), "event_id").limit(limit)


def top_links(links: DataFrame, limit: int) -> DataFrame:
    """TOP-2: the best links, in order of ids where scores are equal."""
    return links.orderBy(F.desc("score"), "source_event_id", "target_event_id").limit(limit)


def process_listing(events: DataFrame, host: str, limit: int | None = None) -> DataFrame:
    """AGG-27: processes started on a host; ``limit`` keeps the first by time."""
    rows = events.where((F.col("event_type") == "endpoint") & (F.length("process") > 0) & (F.upper(C.primary_host()) == host.upper()))
    out = rows.select("event_id", C.micros().alias("us"), "user", "process", "parent_process", "command_line")
    return out if limit is None else out.orderBy("us", "event_id").limit(limit)


def stage_checks(stages: DataFrame) -> DataFrame:
    """WIN-12: for each chain its stages, those earlier than the one before, and the crossings between hosts; unknown hosts are passed over."""
    w = Window.partitionBy("chain_key").orderBy("stage")
    known = F.when(~F.col("host").isin("", "UNKNOWN"), F.col("host"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = stages.withColumns({"_late": F.coalesce(F.col("first_us") < F.lag("first_us").over(w), F.lit(False)), "_cross": F.when(known != before, F.struct("stage", F.concat(before, F.lit(" -> "), known).alias("text")))})
    out = rows.groupBy("chain_key").agg(F.count(F.lit(1)).alias("stages"), F.count_if("_late").alias("out_of_order"), F.array_sort(F.collect_list("_cross")).alias("c"))
    return out.select("chain_key", "stages", "out_of_order", F.col("c.text").alias("crossings"))


def stream_status(events: DataFrame, ids_before: DataFrame | None = None, rejected: DataFrame | None = None, received: str | None = None, now=None) -> DataFrame:
    """AGG-24: accepted rows, repeats and last time of each source; ``ids_before`` holds event ids that were there already.

    ``rejected`` holds quarantined rows, which are counted by source, also where
    nothing was accepted. With ``received``, a column of arrival times, come
    ``last_received_us``, the arrivals of the last 60 seconds before ``now`` and
    whether the newest is less than 30 seconds old.
    """
    arrived = F.unix_micros(received) if received else F.lit(None).cast("long")
    at = F.unix_micros(F.lit(now).cast("timestamp")) if received else F.lit(None).cast("long")
    rows = events.select("source_log", "event_id", C.micros().alias("us"), arrived.alias("got"))
    recent = F.count_if((F.col("got") <= at) & (F.col("got") > at - 60_000_000)).alias("recent")
    ids = rows.groupBy("source_log", "event_id").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("us"), F.max("got").alias("got"), recent)
    old = F.lit(False)
    if ids_before is not None:
        ids = ids.join(ids_before.select("event_id").distinct().withColumn("_old", F.lit(True)), "event_id", "left")
        old = F.coalesce("_old", F.lit(False))
    repeats = F.sum(F.when(old, F.col("n")).otherwise(F.col("n") - 1))
    out = ids.groupBy("source_log").agg(F.count_if(~old).alias("accepted"), repeats.alias("duplicates"), F.max("us").alias("last_us"), F.max("got").alias("last_received_us"), F.sum("recent").alias("last_minute"))
    if rejected is not None:
        bad = rejected.groupBy("source_log").agg(F.count(F.lit(1)).alias("rejected"))
        out = out.withColumnRenamed("source_log", "_s").join(bad, F.col("_s").eqNullSafe(F.col("source_log")), "full").withColumn("source_log", F.coalesce("_s", "source_log")).drop("_s")
        out = out.fillna(0, ["accepted", "duplicates", "rejected", "last_minute"])
    if received is None:
        return out.drop("last_received_us", "last_minute")
    return out.withColumn("receiving", F.coalesce(at - F.col("last_received_us") < 30_000_000, F.lit(False)))


def time_window_select(events: DataFrame, start, end) -> tuple[DataFrame, DataFrame]:
    """FLT-13: rows in [start, end), and the rows before, for history."""
    t = F.col("timestamp")
    return events.where((t >= F.lit(start)) & (t < F.lit(end))), events.where(t < F.lit(start))


def derive_known_domains(events: DataFrame, before) -> DataFrame:
    """AGG-32: registered domains looked up before a time."""
    return events.where((F.col("timestamp") < F.lit(before)) & (F.length("domain") > 0)).select(C.base_domain(F.lower("domain")).alias("domain")).distinct()


def derive_ip_host(answers: DataFrame, events: DataFrame) -> DataFrame:
    """AGG-29: one address for each host: its most frequent DNS answer (host, ip), else the source address it most often reports. Equals: the smaller address."""
    best = lambda d: d.groupBy("host", "ip").count().groupBy("host").agg(F.min_by("ip", F.struct((-F.col("count")).alias("n"), "ip")).alias("ip"))
    named = best(answers.where((F.length("host") > 0) & (F.length("ip") > 0)).select(F.upper("host").alias("host"), "ip"))
    own = best(events.where((F.length("source_host") > 0) & (F.length("source_ip") > 0)).select(F.upper("source_host").alias("host"), F.col("source_ip").alias("ip")))
    return named.withColumn("basis", F.lit("dns")).unionByName(own.join(named.select("host"), "host", "left_anti").withColumn("basis", F.lit("reported")))


def selection_manifest(rows: DataFrame, kept) -> DataFrame:
    """AGG-34: kept and dropped rows of each source and action; a null condition drops."""
    keep = F.coalesce(kept, F.lit(False))
    return rows.groupBy("source_log", "action").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def _profiled(raw: DataFrame, *more: str) -> DataFrame:
    """(source_log, record, more) of JSON objects, out of their ``result`` where they are wrapped; each record is read once."""
    parsed = lambda text: F.from_json(text, "map<string,string>")
    inner = F.try_element_at("record", F.lit("result"))
    rows = raw.select("source_log", parsed(F.col("raw")).alias("record"), *more)
    return rows.withColumn("record", F.when(inner.startswith("{"), parsed(inner)).otherwise(F.col("record"))).where("record IS NOT NULL")


def profile_fields(raw: DataFrame) -> DataFrame:
    """AGG-25: for each top-level field of JSON rows its source, rows, rows with a value and distinct values, all exact. Text that is no object has no fields."""
    each = _profiled(raw).select("source_log", F.explode("record").alias("field", "value"))
    values = each.groupBy("source_log", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    return values.groupBy("source_log", "field").agg(F.sum("n").alias("rows"), filled.alias("filled"), F.count("value").alias("n_distinct"))


def profile_span(raw: DataFrame) -> DataFrame:
    """AGG-25: records of each source and the first and last of their times as written."""
    stamp = F.coalesce(*[F.nullif(F.try_element_at("record", F.lit(f)), F.lit("")) for f in TIME_FIELDS])
    return _profiled(raw).groupBy("source_log").agg(F.count(F.lit(1)).alias("records"), F.min(stamp).alias("first"), F.max(stamp).alias("last"))


def profile_values(raw: DataFrame, fields: tuple[str, ...] = (), top: int = 12) -> DataFrame:
    """AGG-25: (source_log, field, place, value, n), the most frequent values of host, event code and ``fields``; equals by value.

    A list counts by its first member, a missing value as the text that stands
    for it. Counts are partial, and each task keeps its ``top`` values of a field before they meet.
    """
    names = [*ABSENT, *[f for f in fields if f not in ABSENT]]

    def entry(f: str):
        v = F.try_element_at("record", F.lit(f))
        one = F.when(v.startswith("["), F.try_element_at(F.from_json(v, "array<string>"), F.lit(1))).otherwise(v)
        return F.struct(F.lit(f).alias("field"), F.coalesce(one, F.lit(ABSENT.get(f, "None"))).alias("value"))

    each = _profiled(raw).select("source_log", F.explode(F.array(*[entry(f) for f in names])).alias("e"))
    counts = each.groupBy("source_log", "e.field", "e.value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source_log", "field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("source_log", "field", "place", "value", "n")
