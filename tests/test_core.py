"""Core operators against small rows and DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from socspark.functions import columns as C
from socspark.operators import chains, correlate, detect, enrich
from socspark.operators.components import connected_components
from socspark.plans.config import CorrelationConfig
from socspark.plans.queries import oracle_sql, queries
from socspark.plans.schemas import EVENT_SCHEMA

QUERIES, SQL = queries(), oracle_sql()
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def rows_of(frame, columns):
    """The rows as text; whole numbers look alike in nullable and in plain columns."""
    frame = frame[columns].astype(object)
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(map(str, frame.where(frame.notna(), None).map(plain).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows_of(got, columns) == rows_of(want, columns)


def event(i, seconds, action, **more):
    import datetime

    base = datetime.datetime(2026, 9, 30, 10, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)
    row = dict.fromkeys(EVENT_SCHEMA.fieldNames()) | {"event_id": f"e{i}", "timestamp": base, "event_type": "authentication", "action": action, "outcome": "success", "severity": "medium", "suspicious": False, "tags": []}
    return tuple((row | more)[n] for n in EVENT_SCHEMA.fieldNames())


def test_pair_scores(spark):
    rows = [
        event(1, 0, "POWERSHELL_EXEC", event_type="endpoint", user="ann", source_host="A", destination_host="A", suspicious=True, severity="high"),
        event(2, 53, "CREDENTIAL_ACCESS", event_type="endpoint", user="ann", source_host="A", destination_host="A", suspicious=True, severity="high"),
        event(3, 323, "RDP_LOGIN", user="ann", source_host="A", destination_host="B"),
        event(4, 5000, "RDP_LOGIN", user="ann", source_host="A", destination_host="B"),
    ]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    links = {(r.source_event_id, r.target_event_id): r for r in correlate.correlate_pairs(events).collect()}
    assert set(links) == {("e1", "e2"), ("e1", "e3"), ("e2", "e3")}
    assert links[("e1", "e2")].score == 1.0 and "host_pivot" in [f.name for f in links[("e1", "e3")].factors]
    assert [(r.supporting_event_id, r.source_host, r.destination_host) for r in correlate.lateral_movement(events).collect()] == [("e1", "A", "B")]  # of equal scores the earlier event supports
    chain = chains.build_chains(events)["chains"].first()
    assert (chain.chain_id, chain.event_count, chain.reached, chain.current_host, chain.lateral_count) == ("ATTACK-001", 3, ["A", "B"], "A", 1)


def test_enrichment(spark):
    dns = [event(i, i * 60, "DNS_QUERY", event_type="dns", source_host="A", domain="evil.example.org", severity="info") for i in range(6)]
    fails = [event(10 + i, i, "LOGIN_FAILURE", user="bob", source_host="A", destination_host="B", outcome="failure", severity="low") for i in range(3)]
    priv = [event(20 + i, i * 400, "PRIVILEGED_LOGIN", user="eve", destination_host="B") for i in range(4)] + [event(30, 0, "PRIVILEGED_LOGIN", user="dwm-1", destination_host="B"), event(31, 0, "PRIVILEGED_LOGIN", destination_host="B")]
    out = {r.event_id: r for r in enrich.enrich(spark.createDataFrame(dns + fails + priv, EVENT_SCHEMA)).collect()}
    assert all(out[f"e{i}"].action == "HIGH_VOLUME_DNS" and "beaconing" in out[f"e{i}"].tags and out[f"e{i}"].severity == "medium" for i in range(6))
    assert all("credential-guessing" in out[f"e{10 + i}"].tags for i in range(3))
    assert [out[f"e{20 + i}"].suppressed is None for i in range(4)] == [True, False, True, False]
    assert out["e30"].suppressed and out["e31"].suppressed


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.range(1000, 1003).select("id", F.lit(1000)))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1003)} == {1000}
    assert connected_components(edges.limit(0)).count() == 0


def test_sigma_rules(spark):
    rows = [event(1, 0, "PROCESS_CREATE", event_type="endpoint", process="a.exe", command_line="a -Enc x"), event(2, 0, "PROCESS_CREATE", event_type="endpoint", process="b.exe", command_line=None)]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    make = lambda d: detect.compile_sigma({"title": "t", "level": "high", "detection": d})
    hit = lambda d: [r.event_id for r in events.where(make(d).predicate).orderBy("event_id").collect()]
    assert hit({"s": {"CommandLine|contains": "-enc"}, "condition": "s"}) == ["e1"]
    assert hit({"s": {"CommandLine|contains|cased": "-enc"}, "condition": "s"}) == []
    assert hit({"s": {"Image|endswith": ["\\a.exe", "\\b.exe"]}, "f": {"CommandLine": None}, "condition": "s and not f"}) == ["e1"]
    assert hit({"a1": {"Image": "*\\a.exe"}, "a2": {"Image": "*\\b.exe"}, "condition": "1 of a*"}) == ["e1", "e2"]
    for bad in ({"s": {"X|base64": "a"}, "condition": "s"}, {"s": {"X": "a"}, "condition": "s | count() > 3"}, {"s": {"X": "a"}, "condition": "other"}):
        with pytest.raises(detect.UnsupportedRule):
            make(bad)


def test_columns(spark):
    df = spark.createDataFrame([("ws01.corp.local$", r"CORP\Ann", r"C:\x\y.exe", "10.1.2.3", "qx7k2m9zzzz1.xyz"), ("10.0.0.1", "HOST$", "/usr/bin/sh", "nope", "a.corp.local")], "h string, u string, p string, i string, d string")
    out = df.select(C.clean_host(F.col("h")), C.clean_user(F.col("u")), C.basename(F.col("p")), C.ip_in_cidr(F.col("i"), "10.0.0.0/8"), F.size(C.domain_findings(F.col("d")))).collect()
    assert [tuple(r) for r in out] == [("WS01", "ann", "y.exe", True, 2), (None, None, "sh", False, 0)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(os.path.dirname(__spark_entry__.__file__))


def test_bounded_correlation_of_a_busy_key_takes_the_nearest(spark):
    rng = random.Random(5)
    times = sorted(rng.sample(range(5400), 150))
    users = [rng.choice(("ann", "bob")) for _ in times]
    rows = spark.createDataFrame([event(100 + i, t, "RDP_LOGIN", user=u, source_host="A", destination_host="B", suspicious=True) for i, (t, u) in enumerate(zip(times, users, strict=True))], EVENT_SCHEMA)
    config = CorrelationConfig(neighbours_per_key=7, links_per_event=4)
    exact = {(r.source_event_id, r.target_event_id): (r.score, -r.time_delta_seconds, r.source_event_id) for r in correlate.correlate_pairs(rows, config).collect()}
    want = set()
    for j in range(len(times)):
        near = set(range(max(0, j - 7), j)) | set([i for i in range(j) if users[i] == users[j]][-7:])
        pairs = [p for p in ((f"e{100 + i}", f"e{100 + j}") for i in near) if p in exact]
        want |= set(sorted(pairs, key=exact.get, reverse=True)[:4])
    got = {(r.source_event_id, r.target_event_id) for r in correlate.correlate_bounded(rows, config).collect()}
    assert got == want and 0 < len(want) < len(exact)
