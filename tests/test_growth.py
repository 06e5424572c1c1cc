"""Steps on pairs of events against plain all-pairs versions, and that their work does not grow with the pairs."""

import datetime
import random

from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators import cases, correlate
from socspark.plans.config import LateralConfig
from socspark.plans.schemas import EVENT_SCHEMA

START = datetime.datetime(2026, 9, 30, 10, tzinfo=datetime.timezone.utc)


def busy_events(spark, n, seconds, seed, step=1.0):
    """Events of few hosts, accounts and addresses, many of them at the same times."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        action = draw.choice(["RDP_LOGIN", "PRIVILEGED_LOGIN", "POWERSHELL_EXEC", "DNS_QUERY"])
        row = dict.fromkeys(EVENT_SCHEMA.fieldNames()) | {
            "event_id": f"e{i:05d}",
            "timestamp": START + datetime.timedelta(seconds=step * draw.randrange(seconds)),
            "event_type": "authentication" if action.endswith("LOGIN") else "endpoint",
            "action": action,
            "user": draw.choice(["ann", "bob", "", None]),
            "source_host": draw.choice(["A", "B", "C", None]),
            "destination_host": draw.choice(["A", "B", "C", "D", ""]),
            "source_ip": draw.choice(["10.0.0.1", "10.0.0.2", None]),
            "destination_ip": draw.choice(["10.0.0.1", "10.0.0.3", None]),
            "process": draw.choice(["x.exe", "X.exe", "y.exe", None]),
            "domain": draw.choice(["d.example", None, None]),
            "outcome": draw.choice(["success", "success", "failure", None]),
            "severity": draw.choice(["info", "medium"]),
            "suspicious": draw.choice([True, False, None]),
            "tags": [],
        }
        rows.append(tuple(row[c] for c in EVENT_SCHEMA.fieldNames()))
    return spark.createDataFrame(rows, EVENT_SCHEMA).cache()


def all_pairs(events, earlier, later):
    """Every pair of rows as structs a and b, with their score."""
    sides = correlate._sides(events.withColumn("_keep", F.lit(True)), ("action", "outcome"))
    side = F.struct(*sides.columns)
    score, factors = correlate.score_pair()
    a, b = sides.select(side.alias("a")).where(earlier), sides.select(side.alias("b")).where(later)
    return a.crossJoin(b).withColumns({"_raw": score, "_factors": factors})


def test_movements_are_looked_up_and_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(correlate._pieces, "__defaults__", (70,))
    for seed, step in ((1, 1.0), (2, 9.0), (3, 0.36)):
        events = busy_events(spark, 250, 400, seed, step)
        able = "b.action IN ('RDP_LOGIN', 'PRIVILEGED_LOGIN') AND coalesce(b.outcome, '') != 'failure' AND b.source_host != b.destination_host"
        pairs = all_pairs(events, "a.suspicious", able).where("a.event_id != b.event_id AND array_contains(a.hosts, b.source_host) AND b._us - a._us BETWEEN 0 AND 600000000")
        rows = pairs.withColumn("score", F.round("_raw", 4)).where("score >= 0.7").selectExpr("a.event_id AS a", "a._us AS at", "b.*", "score").collect()
        best = {}
        for r in sorted(rows, key=lambda r: (r["score"], -r["at"], r["a"])):
            best[r["event_id"]] = r
        want = {}
        for r in sorted(best.values(), key=lambda r: (-r["score"], r["_us"], r["event_id"])):
            want.setdefault((r["user"] or "", r["source_host"], r["destination_host"]), (r["event_id"], r["a"], r["user"], r["source_host"], r["destination_host"], r["action"], r["score"]))
        found = correlate.lateral_movement(events, LateralConfig())
        got = found.select("event_id", "supporting_event_id", "user", "source_host", "destination_host", "method", "correlation_score").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.values())) and len(got) > 10
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan


def copied(events, n):
    """Each event ``n`` times, under ids that lie among those of others of its time."""
    return events.withColumn("event_id", F.explode(F.array(*[F.concat(F.lit(f"{i}-"), "event_id", F.lit(f"-{i}")) for i in range(n)])))


def scored_pairs(monkeypatch):
    """Counts the pairs that are scored; for functions called in this process."""
    seen, weighing = [], correlate._weighing

    def counted(rows, config):
        weigh, event = weighing(rows, config)
        return (lambda a, b: seen.append(len(a)) or weigh(a, b)), event

    monkeypatch.setattr(correlate, "_weighing", counted)
    return seen


def pieces_of(events, work, at_once):
    """What an Arrow step gives, run in this process on one partition."""
    config = correlate.CorrelationConfig()
    placed = correlate._placed(correlate._by_key(events), correlate.linking_kinds(config), config).coalesce(1).sortWithinPartitions("kind", "value", "bin", "_us", "event_id")
    return [r for b in correlate._pieces(work(config), config, at_once)(iter(placed.toArrow().to_batches(max_chunksize=50))) for r in b.to_pylist()]


def test_factors_are_counted_where_pairs_meet_and_copies_are_scored_once(spark, monkeypatch):
    events = copied(busy_events(spark, 120, 60, 4, 9.0), 3)
    events = events.unionByName(events.limit(20)).cache()  # some rows twice
    for at_once in (70, 50_000):
        monkeypatch.setattr(correlate._pieces, "__defaults__", (at_once,))
        found = correlate.factor_totals(events)
        links = cases.factor_counts(correlate.correlate_pairs(events)).collect()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, links)) and len(links) == 7
    seen = scored_pairs(monkeypatch)
    once, few = busy_events(spark, 120, 60, 4, 9.0), 50_000
    pieces_of(once, correlate._factoring, few)
    base = sum(seen)
    seen.clear()
    pieces_of(copied(once, 6), correlate._factoring, few)
    assert 0 < sum(seen) < 2 * base


def test_links_of_chains_are_counted_and_copies_are_scored_once(spark, monkeypatch):
    events = copied(busy_events(spark, 120, 60, 5, 9.0), 3)
    events = events.unionByName(events.limit(20)).cache()
    every = [(r[0], r[1], round(r[2] * 10_000)) for r in correlate.correlate_pairs(events).select("source_event_id", "target_event_id", "score").collect()]
    part = {e: e for pair in every for e in pair[:2]}

    def root(e):
        while part[e] != e:
            e = part[e]
        return e

    for a, b, _ in every:
        part[root(a)] = root(b)
    want, got = {}, {}
    for a, _, points in every:
        n, total = want.get(root(a), (0, 0))
        want[root(a)] = n + 1, total + points
    for at_once in (70, 50_000):
        monkeypatch.setattr(correlate._pieces, "__defaults__", (at_once,))
        got = {}
        for r in correlate.connecting_totals(events).where("link_count > 0").collect():
            n, total = got.get(root(r.source_event_id), (0, 0))
            got[root(r.source_event_id)] = n + r.link_count, total + r.score_sum
        assert got == want
    seen, once = scored_pairs(monkeypatch), busy_events(spark, 120, 60, 5, 9.0)
    work = lambda config: correlate._spanning(config, True)
    pieces_of(once, work, 50_000)
    base = sum(seen)
    seen.clear()
    pieces_of(copied(once, 6), work, 50_000)
    assert 0 < sum(seen) < 4 * base  # the connecting links of all copies, and pairs once


def test_pairs_of_copies_are_scored_once_and_told_each(spark, monkeypatch):
    events = copied(busy_events(spark, 120, 60, 6, 9.0), 2)
    events = events.unionByName(events.limit(20)).cache()
    pairs = all_pairs(events.where(C.is_notable()), "true", "true").where("a.event_id < b.event_id AND a._us = b._us OR a._us < b._us").where("b._us - a._us <= 1800000000 AND _raw >= 0.7")
    want = sorted(map(str, pairs.select("a.event_id", F.col("b.event_id").alias("other"), F.round("_raw", 4), F.transform("_factors", lambda f: f["name"])).collect()))
    monkeypatch.setattr(correlate._pieces, "__defaults__", (70,))
    found = correlate.correlate_pairs(events)
    got = sorted(map(str, found.select(F.col("source_event_id").alias("event_id"), F.col("target_event_id").alias("other"), F.col("score").alias("round(_raw, 4)"), F.transform("factors", lambda f: f["name"])).collect()))
    assert [g.split("=", 1)[1].split(", transform")[0] for g in got] == [w.split("=", 1)[1].split(", transform")[0] for w in want] and len(want) > 1000
    assert "round" not in found.select("score")._jdf.queryExecution().optimizedPlan().toString()
    seen, once = scored_pairs(monkeypatch), busy_events(spark, 120, 60, 6, 9.0)
    work = lambda config: correlate._pairing(config, (), None)
    pieces_of(once, work, 50_000)
    base = sum(seen)
    seen.clear()
    assert pieces_of(copied(once, 4), work, 50_000) and 0 < sum(seen) <= base
