"""Next targets, case checks, exports and alerts on small rows."""

import collections
import json
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from socspark.operators import cases, chains, predict, techniques
from socspark.plans.schemas import EVENT_SCHEMA
from socspark.sources import sinks
from tests.test_core import event

HOSTS = "name string, criticality double"
USERS = "name string, privilege double, is_privileged boolean, accessible_hosts array<string>"
CHAINS = "chain_key string, current_host string, users array<string>, reached array<string>"


def chain_rows(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA).withColumn("chain_key", F.lit("k"))


def test_next_targets(spark):
    rows = chain_rows(
        spark,
        [
            event(1, 0, "RDP_LOGIN", user="ann", source_host="A", destination_host="B"),
            event(2, 9, "LOGIN_FAILURE", user="ann", source_host="B", destination_host="C", outcome="failure"),
            event(3, 10, "PROCESS_CREATE", event_type="endpoint", source_host="B", command_line=r"net use \\srv-d1\c$"),
            event(4, 11, "DNS_QUERY", event_type="dns", source_host="B", domain="e.corp.local"),
        ],
    )
    hosts = spark.createDataFrame([("A", 0.1), ("B", 0.1), ("C", 1.0), ("D", 0.5), ("SRV-D1", 0.0), ("E", 0.0), ("Z", 0.0)], HOSTS)
    users = spark.createDataFrame([("ann", 0.2, False, ["C"]), ("root", 0.8, True, ["C", "D"])], USERS)
    edges = spark.createDataFrame([("host:A", "host:B"), ("host:B", "host:C"), ("host:C", "host:D")], "a string, b string")
    found = spark.createDataFrame([("k", "B", ["ann"], ["A", "B"])], CHAINS)
    none = spark.createDataFrame([], "user string, host string, n long")
    got = {r.host: r for r in predict.score_targets(rows, found, hosts, users, edges, none).collect()}
    c = got["C"]
    assert (c.rank, c.access, c.privilege, c.connectivity, c.criticality, c.recent, c.proximity) == (1, 30.0, 20.0, 20.0, 20.0, 15.0, 20.0)
    assert (c.raw_score, c.score, c.confidence) == (125.0, 89.3, "high")
    d = got["D"]
    assert (d.rank, d.recent, d.proximity, d.raw_score) == (2, 9.0, 10.0, 59.0)  # "d" is part of the command line
    assert got["E"].recent == 9.0 and got["SRV-D1"].recent == 9.0 and "Z" not in got and not {"A", "B"} & set(got)
    states = {r.host: r.state for r in predict.host_state(rows, found, predict.score_targets(rows, found, hosts, users, edges, none)).collect()}
    assert (states["A"], states["B"], states["C"]) == ("compromised", "current_position", "potential_target")


def test_next_targets_without_hosts_or_chains(spark):
    rows = chain_rows(spark, [event(1, 0, "RDP_LOGIN", user="ann", source_host="A", destination_host="B", command_line="x")])
    hosts, users = spark.createDataFrame([], HOSTS), spark.createDataFrame([], USERS)
    edges, none = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "user string, host string, n long")
    found = spark.createDataFrame([("k", None, ["ann"], ["A"])], CHAINS)
    assert predict.score_targets(rows, found, hosts, users, edges, none).count() == 0
    assert predict.score_targets(rows.limit(0), found.limit(0), hosts, users, edges, none).count() == 0
    known = spark.createDataFrame([("A", 1.0), ("B", 0.5)], HOSTS)
    assert [(r.host, r.score) for r in predict.score_targets(rows.limit(0), found, known, users, edges, none).collect()] == [("B", 7.1)]


def test_access_is_learned_only_without_an_entry(spark):
    found = spark.createDataFrame([("k", "A", ["ann", "bob"], ["A"])], CHAINS)
    users = spark.createDataFrame([("ann", 0.2, False, [])], USERS)
    seen = spark.createDataFrame([("ann", "X", 1), ("bob", "Y", 2)], "user string, host string, n long")
    assert [r.host for r in predict.account_access(found, users, seen).collect()] == ["Y"]


def test_triage_and_stages(spark):
    rows = chain_rows(spark, [event(1, 0, "CREDENTIAL_ACCESS", event_type="endpoint", user="ann", source_host="A", suspicious=True, severity="critical"), event(2, 1, "RDP_LOGIN", user="ann", source_host="A", destination_host="B")])
    one = cases.triage_chains(rows).first()
    assert (one.flagged, one.multi_host, one.single_account, one.severity, one.open_case) == (1, False, True, "high", True)
    both = cases.triage_chains(rows.withColumn("suspicious", F.lit(True))).first()
    assert (both.multi_host, both.severity) == (True, "critical")
    stages = spark.createDataFrame([("k", 1, 5, "A"), ("k", 2, 4, "UNKNOWN"), ("k", 3, 9, "B")], "chain_key string, stage int, first_us long, host string")
    got = cases.stage_checks(stages).first()
    assert (got.stages, got.out_of_order, got.crossings) == (3, 1, ["A -> B"])


def test_export_classes(spark):
    raw = json.dumps({"EventID": "10", "SourceImage": "C:\\x\\a.exe", "TargetImage": "C:\\w\\lsass.exe", "GrantedAccess": "0x1"})
    rows = [
        event(1, 0, "CREDENTIAL_ACCESS", event_type="endpoint", source_host="A", process="a.exe", raw=raw),
        event(2, 0, "FILE", event_type="endpoint", source_host="A", process="a.exe", file_name="b.docm", raw=json.dumps({"EventID": 11})),
        event(3, 0, "CONNECTION_BLOCKED", event_type="network", source_ip="10.0.0.1", destination_ip="1.2.3.4", raw=json.dumps({"dpt": "443"})),
        event(4, 0, "CLOUD_LOGGING_DISABLED", event_type="cloud", process="StopLogging", raw=json.dumps({"awsRegion": "eu"})),
        event(5, 0, "PRIVILEGED_LOGIN", destination_host="B"),
        event(6, 0, "DNS_QUERY", event_type="dns", severity=None),
    ]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    out = {r.event_id: json.loads(r.ocsf) for r in sinks.to_ocsf(events).collect()}
    assert [out[f"e{i}"]["type_uid"] for i in range(1, 7)] == [100703, 100101, 400105, 600399, 300301, 400301]
    assert out["e1"]["process"]["name"] == "lsass.exe" and out["e1"]["actor"]["process"]["file"]["path"] == "C:\\x\\a.exe" and out["e1"]["unmapped"]["granted_access"] == "0x1"
    assert out["e2"]["file"] == {"name": "b.docm", "path": "b.docm"} and out["e3"]["dst_endpoint"] == {"ip": "1.2.3.4", "port": 443}
    assert out["e4"]["api"]["operation"] == "StopLogging" and out["e4"]["actor"]["user"] == {"type_id": 0, "type": "Unknown"}
    assert out["e6"]["severity"] == "Unknown" and "src_endpoint" not in out["e6"] and "query" not in out["e6"]
    lines = sinks.to_ocsf(events).select(F.col("ocsf").alias("value")).union(spark.createDataFrame([("{}",), ("no",), (None,)], "value string"))
    assert sorted(map(tuple, sinks.from_ocsf(lines).collect())) == sorted(map(tuple, events.collect()))


def test_alerts(spark):
    rows = [
        event(1, 0, "POWERSHELL_EXEC", event_type="endpoint", user="a=n", source_host="A", destination_host="A", suspicious=True, severity="high"),
        event(2, 53, "CREDENTIAL_ACCESS", event_type="endpoint", user="a=n", source_host="A", destination_host="A", suspicious=True, severity="high"),
        event(3, 323, "RDP_LOGIN", user="a=n", source_host="A", destination_host="B"),
    ]
    built = chains.build_chains(spark.createDataFrame(rows, EVENT_SCHEMA))
    mapped = techniques.map_techniques(built["events"])
    targets = spark.createDataFrame([("e1", 1, "C", 80.0)], "chain_key string, rank int, host string, score double")
    one = sinks.chain_alerts(built["chains"], mapped.join(built["members"], "event_id"), built["movements"].join(built["members"], "event_id"), targets).first()
    alert, hec = json.loads(one.alert), json.loads(one.hec)
    assert alert["chain_id"] == "ATTACK-001" and alert["hosts"] == ["A", "B"] and alert["lateral_movements"][0]["to"] == "B" and alert["predicted_next_target"]["host"] == "C"
    assert hec["event"] == alert and one.cef.startswith("CEF:0|") and "suser=a\\=n" in one.cef and "cs2=C (80.0)" in one.cef
    finding = json.loads(sinks.chain_findings(built["chains"], built["members"], mapped).first().ocsf)
    assert finding["type_uid"] == 200401 and [e["uid"] for e in finding["finding_info"]["related_events"]] == ["e1", "e2", "e3"]
    now = built["chains"]
    assert sinks.changed_chains(now, now).count() == 0
    assert [r.change for r in sinks.changed_chains(now, now.withColumn("status", F.lit("x"))).collect()] == ["update"]
    assert [r.change for r in sinks.changed_chains(now, now.limit(0)).collect()] == ["create"]
    assert sinks.changed_chains(now, now.limit(0), 101).count() == 0


def test_tables(spark, tmp_path):
    events = spark.createDataFrame([event(i, i, "RDP_LOGIN") for i in range(4)], EVENT_SCHEMA)
    assert [r.event_id for r in sinks.latest_events(events, 2).collect()] == ["e2", "e3"]
    kept, gone = sinks.purge_older_than(events, events.collect()[1].timestamp)
    assert kept.count() == 3 and gone.first().purged == 1
    raw = spark.createDataFrame([("b", "s1", 2), ("a", "s1", 1), ("c", "s2", 0)], "raw string, source_log string, position long").coalesce(1)
    sinks.write_scenario(raw, str(tmp_path))
    assert [r.value for r in spark.read.text(f"{tmp_path}/records/source_log=s1").collect()] == ["a", "b"]
    assert {r.source_log: r.records for r in spark.read.json(f"{tmp_path}/manifest").collect()} == {"s1": 2, "s2": 1}


def test_targets_on_a_large_connected_network_without_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    names = [f"H{i:04}" for i in range(1000)]
    links = {tuple(sorted(rng.sample(names, 2))) for _ in range(3000)} | {(names[i], names[i + 1]) for i in range(999)}
    value = {n: rng.randrange(0, 101) / 100 for n in names}
    nbrs = collections.defaultdict(set)
    for a, b in links:
        nbrs[a].add(b)
        nbrs[b].add(a)
    starts, reached, may = {}, {}, {}
    for i in range(12):
        starts[f"c{i}"] = rng.choice(names)
        reached[f"c{i}"] = [starts[f"c{i}"], *rng.sample(names, 3)]
        may[f"u{i}"] = rng.sample(names, 5)
    hosts = spark.createDataFrame(sorted(value.items()), "name string, criticality double")
    users = spark.createDataFrame([(u, 0.0, False, x) for u, x in may.items()], "name string, privilege double, is_privileged boolean, accessible_hosts array<string>")
    found = spark.createDataFrame([(c, at, [c.replace("c", "u")], reached[c]) for c, at in starts.items()], "chain_key string, current_host string, users array<string>, reached array<string>")
    edges = spark.createDataFrame([("host:" + a, "host:" + b) for a, b in links], "a string, b string")
    rows = spark.createDataFrame([], EVENT_SCHEMA).withColumns({"chain_key": F.lit("c0")})
    none = spark.createDataFrame([], "user string, host string, n long")
    sizes = []
    plain = predict._round
    monkeypatch.setattr(predict, "_round", lambda waiting, own, pairs, out, projection, size, level, config: sizes.append((waiting.count(), size)) or plain(waiting, own, pairs, out, projection, size, level, config))
    got = {(r.chain_key, r.rank): (r.host, r.score) for r in predict.score_targets(rows, found, hosts, users, edges, none).collect()}
    most = max(len(x) for x in nbrs.values())
    for c, at in starts.items():
        far, front, d = {at: 0}, [at], 0
        while front:
            d += 1
            front = [y for y in {y for x in front for y in nbrs[x]} if y not in far]
            far |= dict.fromkeys(front, d)
        points = {}
        for n in names:
            share = round(len(nbrs[n]) / most, 6)
            parts = [3000 if n in may[c.replace("c", "u")] else 0, round(2000 * share), round(2000 * value[n]), round(2000 / max(far[n], 1)) if n in far else 0]
            points[n] = min(100.0, float((Decimal(sum(parts)) / Decimal(140)).quantize(Decimal("0.1"), ROUND_HALF_UP)))
        want = sorted((n for n in names if n not in reached[c] and points[n]), key=lambda n: (-points[n], n))[:4]
        assert [got[c, k][0] for k in (1, 2, 3, 4)] == want
    assert max(size for _, size in sizes) < 1000  # settled before every host is met


def test_raw_profile_of_awkward_records(spark):
    rows = [("a", None), ("a", "not json"), ("a", "{}"), ("a", '{"result": {"host": "h1", "EventCode": 7, "x": [], "_time": "", "UtcTime": "2024-01-02"}}'), ("a", '{"host": "h1", "x": ["p", "q"], "timestamp": "2024-01-01"}'), ("a", '{"host": null, "x": "p"}'), (None, '{"x": "r"}')]
    raw = spark.createDataFrame(rows, "source_log string, raw string")
    span = {r["source_log"]: (r["records"], r["first"], r["last"]) for r in cases.profile_span(raw).collect()}
    assert span == {"a": (4, "2024-01-01", "2024-01-02"), None: (1, None, None)}
    top = {(r["source_log"], r["field"], r["place"]): (r["value"], r["n"]) for r in cases.profile_values(raw, ("x",), 2).collect()}
    assert top["a", "host", 1] == ("?", 2) and top["a", "host", 2] == ("h1", 2) and top["a", "EventCode", 1] == ("-", 3) and top["a", "EventCode", 2] == ("7", 1)
    assert top["a", "x", 1] == ("None", 2) and top["a", "x", 2] == ("p", 2) and top[None, "x", 1] == ("r", 1)
    fields = {(r["source_log"], r["field"]): (r["rows"], r["filled"], r["n_distinct"]) for r in cases.profile_fields(raw).collect()}
    assert fields["a", "host"] == (3, 2, 1) and fields["a", "x"] == (3, 3, 3) and fields[None, "x"] == (1, 1, 1)
    assert cases.profile_values(raw.limit(0)).count() == cases.profile_fields(raw.limit(0)).count() == 0
