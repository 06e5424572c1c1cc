"""Findings and what they cite, the audit log, and its seals.

A finding has finding_id, chain_key, agent, title, statement, assurance and
confidence; a citation is a row (finding_id, kind, ref), kind ``event`` or
``node``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socspark.functions import columns as C

# Words that state a cause.
CAUSAL_WORDS = (" because ", " caused ", " led to ", " resulted in ")
# Decisions that take a finding out.
REJECTING_DECISIONS = ("rejected", "false_positive")
#: Points of confidence that an unverified finding loses, and the least it keeps.
DOWNGRADE, LEAST_CONFIDENCE = 0.35, 0.05
#: Evidence may span this many correlation windows.
SPAN_WINDOWS = 4


def _resolved(citations: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct citations with ``found`` and, for events, the time."""
    cited = citations.select("finding_id", "kind", "ref").distinct()
    known = events.select(F.lit("event").alias("kind"), F.col("event_id").alias("ref"), C.micros().alias("us"), "event_type")
    known = known.unionByName(nodes.select(F.lit("node").alias("kind"), F.col("id").alias("ref"), F.lit(None).cast("long").alias("us"), F.lit(None).cast("string").alias("event_type")).distinct())
    return cited.join(known.withColumn("found", F.lit(True)), ["kind", "ref"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def verify_findings(findings: DataFrame, citations: DataFrame, events: DataFrame, nodes: DataFrame, positions: DataFrame, reachable: DataFrame, movements: DataFrame, window_seconds: int = 1800) -> DataFrame:
    """AGG-21: whether each finding stands on what it cites; one that does not loses confidence.

    ``positions`` has chain_key and current_host, ``reachable`` (chain_key,
    host) with a path from there, ``movements`` the chain_key of recorded
    movements. ``failures`` names the checks that failed.
    """
    is_event, is_node = F.col("kind") == "event", F.col("kind") == "node"
    proof = _resolved(citations, events, nodes).groupBy("finding_id").agg(
        F.count_if(is_event).alias("cited_events"),
        F.count_if(is_event & ~F.col("found")).alias("unresolved_events"),
        F.count_if(is_node).alias("cited_nodes"),
        F.count_if(is_node & ~F.col("found")).alias("missing_nodes"),
        (F.max("us") - F.min("us")).alias("_span"),
    )
    n = ("cited_events", "unresolved_events", "cited_nodes", "missing_nodes")
    target = F.upper(F.trim(F.element_at(F.split("title", ":"), -1)))
    out = findings.join(proof, "finding_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in n} | {"_target": target})
    at = positions.where(F.length("current_host") > 0).select("chain_key").distinct().withColumn("_at", F.lit(True))
    path = reachable.select("chain_key", F.upper("host").alias("_target")).distinct().withColumn("_path", F.lit(True))
    moved = movements.select("chain_key").distinct().withColumn("_moved", F.lit(True))
    out = out.join(at, "chain_key", "left").join(path, ["chain_key", "_target"], "left").join(moved, "chain_key", "left")
    aims = (F.col("assurance") == "predicted") & F.col("_at").isNotNull() & (F.length("_target") > 0)
    causal = C.contains_any(F.lower("statement"), CAUSAL_WORDS) & (F.col("assurance") == "correlated")
    claims = (F.col("agent") == "investigation") & F.lower("title").contains("hypothesis confirmed")
    checks = {
        "no evidence": (F.col("cited_events") == 0) & (F.col("cited_nodes") == 0),
        "unresolved events": F.col("unresolved_events") > 0,
        "missing nodes": F.col("missing_nodes") > 0,
        "wide span": F.col("_span") > SPAN_WINDOWS * window_seconds * 1_000_000,
        "unreachable target": aims & F.col("_path").isNull(),
        "causal claim": causal,
        "no movement": claims & F.col("_moved").isNull(),
    }
    failures = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in checks.items()]))
    out = out.withColumn("failures", failures).withColumn("verified", F.size("failures") == 0)
    less = F.round(F.greatest(F.lit(LEAST_CONFIDENCE), F.col("confidence") - DOWNGRADE), 3)
    return out.select("finding_id", "chain_key", "verified", F.when(F.col("verified"), F.col("confidence")).otherwise(less).alias("confidence"), F.when(~F.col("verified"), F.col("confidence")).alias("confidence_before"), *n, (F.col("_span") / 1e6).alias("span_seconds"), "failures")


def overall_confidence(verified: DataFrame) -> DataFrame:
    """AGG-21 by chain: the mean confidence of verified findings, 0 without one."""
    holds = F.when(F.col("verified"), F.col("confidence"))
    return verified.groupBy("chain_key").agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("downgraded"), F.round(F.coalesce(F.avg(holds), F.lit(0.0)), 3).alias("confidence"))


def unresolved_citations(citations: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-18: for each finding and kind the citations that resolve to nothing: their number and the first."""
    return _resolved(citations, events, nodes).where("not found").groupBy("finding_id", "kind").agg(F.count(F.lit(1)).alias("unresolved"), F.min("ref").alias("first_unresolved"))


def evidence_breakdown(citations: DataFrame, events: DataFrame) -> DataFrame:
    """AGG-22: distinct cited events of each type."""
    cited = citations.where("kind = 'event'").select(F.col("ref").alias("event_id")).distinct()
    return events.join(cited, "event_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("records"))


def unsupported_findings(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """AGG-22: findings that cite no event."""
    return findings.join(citations.where("kind = 'event'").select("finding_id"), "finding_id", "left_anti")


def accepted_findings(findings: DataFrame) -> DataFrame:
    """FLT-14: findings that no analyst took out and no check failed, with the ``section`` they belong to; ``decision`` and ``verified`` may be null."""
    kept = findings.where(~F.coalesce(F.lower("decision").isin(*REJECTING_DECISIONS), F.lit(False)) & F.coalesce("verified", F.lit(True)))
    section = F.when(F.col("assurance").isin("observed", "correlated"), "observed").when(F.col("assurance") == "inferred", "inferred").otherwise("predicted")
    return kept.withColumn("section", section)


def audit_entries(log: DataFrame, limit: int = 200, actor: str | None = None, action: str | None = None) -> DataFrame:
    """FLT-15: the newest entries by ``seq``, 5000 at most."""
    if actor:
        log = log.where(F.col("actor") == actor)
    if action:
        log = log.where(F.col("action") == action)
    return log.orderBy(F.desc("seq")).limit(max(1, min(limit, 5000)))


def append_hash_chain(rows: DataFrame, tails: DataFrame, log_col: str, order_col: str, body_col: str) -> DataFrame:
    """WIN-14: new rows of each log with ``seq``, ``prev_hash`` and ``hash``, which go on from its tail.

    ``tails`` has the log, ``seq`` and ``hash`` of its last entry; a log without
    one starts at 1 after an empty hash. A hash seals the previous one and the
    body, so a log is one sorted run of one task, of which a batch and the last
    hash are in memory.
    """
    last = tails.select(log_col, F.col("seq").alias("_last_seq"), F.col("hash").alias("_last_hash"))
    runs = rows.join(last, log_col, "left").repartition(F.col(log_col)).sortWithinPartitions(log_col, order_col)
    kept = list(rows.columns)

    def seal(batches):
        log, seq, digest = object(), 0, ""
        for batch in batches:
            numbers, before, after = [], [], []
            for name, body, n, h in zip(*(batch.column(c).to_pylist() for c in (log_col, body_col, "_last_seq", "_last_hash")), strict=True):
                if name != log:
                    log, seq, digest = name, n or 0, h or ""
                seq += 1
                before.append(digest)
                digest = hashlib.sha256((digest + (body or "")).encode()).hexdigest()
                numbers.append(seq)
                after.append(digest)
            columns = [batch.column(c) for c in kept] + [pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "seq", "prev_hash", "hash"])

    added = [T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())]
    return runs.mapInArrow(seal, T.StructType([*rows.schema.fields, *added]))
