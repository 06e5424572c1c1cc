"""Detections as a whole: rules, indicators, feedback, baselines and routine in their order, and what is loaded.

Steps that read their events more than once get them from a written table, so that plans do not multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators import detect, enrich, techniques
from socspark.plans.config import DetectionConfig
from socspark.plans.storage import stored

#: Tags that an evaluation writes, and so takes back.
WRITTEN_TAGS = ("sigma:", "intel:", "finding:Sigma: ", "finding:Threat intel: ", "anomaly:")
#: Suppressions that an evaluation writes.
WRITTEN_REASONS = ("false positive marked by ", "routine: same activity by ")
KIND_ORDER = ("domain", "ip", "hash", "url")


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    return C.any_of(text.startswith(p) for p in prefixes)


def reset(events: DataFrame) -> DataFrame:
    """DET-5: events as they were before any rule or indicator.

    ``base_severity`` and ``base_suspicious`` keep the state before the first
    evaluation; where they are there, severity and suspicion return to it, so
    rules and indicators that are gone lose their effect.
    """
    if "base_severity" not in events.columns:
        events = events.withColumns({"base_severity": F.col("severity"), "base_suspicious": F.coalesce("suspicious", F.lit(False))})
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return events.withColumns(
        {
            "severity": F.col("base_severity"),
            "suspicious": F.col("base_suspicious"),
            "tags": F.filter(tags, lambda t: ~_starts(t, WRITTEN_TAGS)),
            "suppressed": F.when(~_starts(F.coalesce("suppressed", F.lit("")), WRITTEN_REASONS), F.col("suppressed")),
        }
    )


def apply_intel(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """DET-4: events that touch an indicator become suspicious, high at least, and carry a tag and a finding for each.

    ``indicators`` has kind, value and description, and may have source; of
    repeated ones the first in order counts.
    """
    source = F.col("source") if "source" in indicators.columns else F.lit("intel")
    listed = indicators.groupBy("kind", "value").agg(F.min(F.struct(source.alias("source"), "description")).alias("_i"))
    kind = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    text = F.concat(F.lit("finding:Threat intel: "), "kind", F.lit(" "), "value", F.lit(" is listed in "), "_i.source", F.lit(" ("), F.coalesce("_i.description", F.lit("")), F.lit(")"))
    hit = F.struct(kind.alias("k"), F.col("value").alias("v"), F.concat(F.lit("intel:"), "kind", F.lit(":"), "value").alias("tag"), text.alias("text"))
    found = detect.match_intel(events, indicators).distinct().join(listed, ["kind", "value"]).select("event_id", hit.alias("h"))
    found = found.groupBy("event_id").agg(F.array_sort(F.collect_list("h")).alias("_h"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    added = F.flatten(F.transform("_h", lambda h: F.array(h["tag"], h["text"])))
    touched = F.col("_h").isNotNull()
    out = events.join(found, "event_id", "left")
    return out.withColumns(
        {
            "tags": F.when(touched, F.concat(tags, added)).otherwise(tags),
            "suspicious": F.coalesce("suspicious", F.lit(False)) | touched,
            "severity": F.when(touched, C.raise_severity(F.col("severity"), "high")).otherwise(F.col("severity")),
        }
    ).select(*events.columns)


def evaluation_version(rules: list[detect.SigmaRule], indicators: DataFrame) -> DataFrame:
    """DET-5: one row with ``version``, which changes with the rules and the set of indicators, not with their order."""
    ids = F.lit("|".join(sorted(r.id for r in rules)))
    rows = indicators.select("kind", "value").distinct().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("kind", "value")), F.lit(0)).alias("x"))
    return rows.select(F.substring(F.sha2(F.concat_ws("#", ids, "n", "x"), 256), 1, 12).alias("version"))


def apply_detections(events: DataFrame, rules: list[detect.SigmaRule], indicators: DataFrame | None = None, suppressions: DataFrame | None = None, config: DetectionConfig = DetectionConfig(), baselines: bool = True) -> DataFrame:
    """DET-6: rules, indicators, feedback, baselines, routine, in this order, from the base state on."""
    out = detect.match_sigma(reset(events), rules)
    if indicators is not None:
        out = apply_intel(stored(out, "ruled"), indicators)
    if suppressions is not None:
        out = detect.apply_feedback(out, suppressions)
    if baselines:
        out = stored(enrich.with_anomalies(stored(out, "detected"), config), "with-anomalies")
        out = enrich.mark_routine(out, config)
    return out


def enrich_and_detect(events: DataFrame, rules: list[detect.SigmaRule], indicators: DataFrame | None = None, suppressions: DataFrame | None = None, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """DET-10: volume, guessing and privileged logons, then `apply_detections`."""
    out = stored(enrich.auth_failures(enrich.dns_volume(events, config), config), "frequent")
    out = stored(enrich.suppress_privileged(out, config), "privileged")
    return apply_detections(out, rules, indicators, suppressions, config)


def rule_coverage(spark: SparkSession, mapped: DataFrame, rules: list[techniques.TechniqueRule] | None = None) -> DataFrame:
    """DET-8: the techniques that rules can assign, by tactic, and how many events each was assigned to."""
    rules = techniques.default_rules() if rules is None else rules
    listed = spark.createDataFrame([(r.tactic, r.technique, r.confidence) for r in rules], "tactic string, technique string, confidence string").distinct()
    seen = mapped.groupBy("tactic", "technique", "confidence").agg(F.count(F.lit(1)).alias("events"))
    return listed.join(seen, ["tactic", "technique", "confidence"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def technique_support(events: DataFrame, technique: str) -> DataFrame:
    """DET-8: for each event whether a rule assigns the technique; no shuffle."""
    holds = F.exists(techniques.mappings(), lambda m: m["technique"] == technique.upper())
    return events.select("event_id", F.coalesce(holds, F.lit(False)).alias("supported"))


def detection_summary(rules: list[detect.SigmaRule], skipped: list[dict], indicators: DataFrame, suppressions: DataFrame) -> DataFrame:
    """DET-9: one row: rules loaded and skipped, indicators of each kind, suppressions."""
    listed = indicators.select("kind", "value").distinct()
    counts = listed.agg(F.count(F.lit(1)).alias("indicators"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in zip(KIND_ORDER, ("domains", "ips", "hashes", "urls"), strict=True)])
    marked = suppressions.agg(F.countDistinct("id").alias("suppressions"))
    return counts.join(F.broadcast(marked)).withColumns({"rules": F.lit(len(rules)), "skipped": F.lit(len(skipped))})
