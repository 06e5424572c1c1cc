"""Composed detections, rule files, findings, single entities and foreign formats on small rows."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from socspark.operators import chains, composition, detect, enrich, entities, findings
from socspark.plans.schemas import EVENT_SCHEMA
from socspark.sources import datasets, rules, translate
from tests.test_core import event

INDICATORS = "kind string, value string, description string"


def events_of(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)


def test_rule_files_are_read_and_others_skipped(spark, tmp_path):
    good = "title: Shell\nid: {i}\nlevel: {level}\nlogsource:\n  product: windows\n  service: security\ndetection:\n  a:\n    User: ann\n  condition: a\ntags: [attack.T1059.001, attack.execution]\n"
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yml").write_text(good.format(i="r1", level="odd"))
    (tmp_path / "deep" / "b.yaml").write_text(good.format(i="r1", level="high") + "---\n" + good.format(i="r2", level="high"))
    (tmp_path / "c.yml").write_text("detection: [")
    (tmp_path / "d.yml").write_text("title: x\ndetection:\n  a:\n    User|near: ann\n  condition: a\n")
    (tmp_path / "e.yml").write_text("title: x\ndetection:\n  a:\n    User|re: '('\n  condition: a\n")
    (tmp_path / "f.yml").write_text("title: x\ndetection:\n  a:\n    User: ann\n")
    (tmp_path / "g.yml").write_text("action: global\ntitle: x\n")
    (tmp_path / "notes.txt").write_text("no rule")
    loaded, skipped = rules.load_sigma_rules(spark, [str(tmp_path)])
    assert [(r.id, r.level, r.category, r.techniques) for r in loaded] == [("r1", "medium", "authentication", ("T1059.001",)), ("r2", "high", "authentication", ("T1059.001",))]
    assert sorted(s["file"].rsplit("/", 1)[1] for s in skipped) == ["c.yml", "d.yml", "e.yml", "f.yml", "g.yml"]
    out = detect.match_sigma(events_of(spark, event(1, 0, "LOGIN_SUCCESS", user="ann"), event(2, 0, "LOGIN_SUCCESS", user="bob")), loaded)
    assert {r.event_id: r.suspicious for r in out.collect()} == {"e1": True, "e2": False}


def test_detections_follow_rules_and_indicators(spark):
    rows = events_of(
        spark,
        event(1, 0, "DNS_QUERY", event_type="dns", source_host="A", domain="a.bad.com", severity="info"),
        event(2, 1, "PROCESS_CREATE", event_type="endpoint", source_host="A", process="x.exe", command_line="GET xhttp://EVIL.example/dropper", severity="critical"),
        event(3, 2, "PROCESS_CREATE", event_type="endpoint", source_host="A", process="x.exe", command_line=None, severity="info"),
    )
    listed = spark.createDataFrame([("domain", "bad.com", "c2"), ("domain", "bad.com", "b"), ("url", "http://evil.example/drop", "kit"), ("url", "", "empty")], INDICATORS)
    once = composition.apply_detections(rows, [], listed, baselines=False)
    got = {r.event_id: (r.severity, r.suspicious, r.tags) for r in once.collect()}
    assert got["e1"] == ("high", True, ["intel:domain:bad.com", "finding:Threat intel: domain bad.com is listed in intel (b)"])
    assert got["e2"][:2] == ("critical", True) and got["e2"][2][0] == "intel:url:http://evil.example/drop"
    assert got["e3"] == ("info", False, [])
    back = composition.apply_detections(once, [], listed.where("false"), baselines=False)
    assert {r.event_id: (r.severity, r.suspicious, r.tags) for r in back.collect()} == {"e1": ("info", False, []), "e2": ("critical", False, []), "e3": ("info", False, [])}
    version = lambda d: composition.evaluation_version([], d).first().version
    assert version(listed) == version(listed.orderBy("value")) != version(listed.where("kind = 'url'"))
    assert composition.detection_summary([], [], listed, spark.createDataFrame([], "id string")).first().asDict()["domains"] == 1


def test_full_detection_keeps_the_order_of_its_parts(spark):
    dns = [event(i, i, "DNS_QUERY", event_type="dns", source_host="A", domain="beacon.example.com", severity="info") for i in range(1, 6)]
    fails = [event(i, i, "LOGIN_FAILURE", user="ann", destination_host="B", outcome="failure", severity="low") for i in range(10, 13)]
    twice = [event(i, i, "PRIVILEGED_LOGIN", user="root1", destination_host="C") for i in (20, 21)]
    out = composition.enrich_and_detect(events_of(spark, *dns, *fails, *twice), [], spark.createDataFrame([], INDICATORS))
    got = {r.event_id: r for r in out.collect()}
    assert got["e1"].action == "HIGH_VOLUME_DNS" and got["e1"].base_suspicious and got["e1"].severity == "medium"
    assert got["e10"].suspicious and got["e20"].suppressed is None and got["e21"].suppressed.startswith("repeat of e20 ")


def test_the_plan_of_all_detections_stays_small(spark):
    events = events_of(spark, event(1, 0, "RDP_LOGIN", user="ann"))
    for out in (composition.enrich_and_detect(events, [], spark.createDataFrame([], INDICATORS)), enrich.enrich(events)):
        assert out._jdf.queryExecution().analyzed().toString().count("Join") <= 2


def test_findings_lose_confidence_for_each_kind_of_failure(spark):
    rows = events_of(spark, event(1, 0, "RDP_LOGIN", user="ann"), event(2, 9000, "RDP_LOGIN", user="ann"))
    claims = spark.createDataFrame(
        [
            ("good", "k", "graph", "t", "seen", "observed", 0.9),
            ("bare", "k", "graph", "t", "seen", "observed", 0.9),
            ("lost", "k", "graph", "t", "seen", "observed", 0.2),
            ("wide", "k", "graph", "t", "seen", "observed", 0.9),
            ("cause", "k", "graph", "t", "x led to y", "correlated", 0.9),
            ("aim", "k", "graph", "next: c", "seen", "predicted", 0.9),
            ("move", "k", "investigation", "Attack hypothesis confirmed", "seen", "inferred", 0.9),
        ],
        "finding_id string, chain_key string, agent string, title string, statement string, assurance string, confidence double",
    )
    cited = [(f, "node", "n") for f in ("good", "cause", "aim", "move")] + [("lost", "event", "e9"), ("wide", "event", "e1"), ("wide", "event", "e2"), ("good", "event", "e1"), ("good", "event", "e1")]
    cited = spark.createDataFrame(cited, "finding_id string, kind string, ref string")
    nodes, at = spark.createDataFrame([("n",)], "id string"), spark.createDataFrame([("k", "A")], "chain_key string, current_host string")
    paths, moves = spark.createDataFrame([("k", "B")], "chain_key string, host string"), spark.createDataFrame([], "chain_key string")
    out = findings.verify_findings(claims, cited, rows, nodes, at, paths, moves)
    got = {r.finding_id: (r.failures, r.confidence) for r in out.collect()}
    assert got == {"good": ([], 0.9), "bare": (["no evidence"], 0.55), "lost": (["unresolved events"], 0.05), "wide": (["wide span"], 0.55), "cause": (["causal claim"], 0.55), "aim": (["unreachable target"], 0.55), "move": (["no movement"], 0.55)}
    assert findings.overall_confidence(out).first().asDict() == {"chain_key": "k", "verified": 1, "downgraded": 6, "confidence": 0.9}
    decided = claims.withColumns({"decision": F.when(F.col("finding_id") == "good", "REJECTED"), "verified": F.when(F.col("finding_id") == "bare", False)})
    assert {r.finding_id: r.section for r in findings.accepted_findings(decided).collect()} == {"lost": "observed", "wide": "observed", "cause": "observed", "aim": "predicted", "move": "inferred"}


def test_appended_log_goes_on_from_its_tail(spark):
    rows = spark.createDataFrame([("a", 2, "y", 7), ("a", 1, "x", 7), ("b", 1, None, 7), (None, 1, "z", 7)], "log string, at int, body string, hash_ int")
    tails = spark.createDataFrame([("a", 5, "h5")], "log string, seq long, hash string")
    got = {(r.log, r.at): (r.seq, r.prev_hash, r.hash) for r in findings.append_hash_chain(rows, tails, "log", "at", "body").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[("a", 1)] == (6, "h5", digest("h5x")) and got[("a", 2)] == (7, digest("h5x"), digest(digest("h5x") + "y"))
    assert got[("b", 1)] == (1, "", digest("")) and got[(None, 1)] == (1, "", digest("z"))
    assert findings.append_hash_chain(rows.where("false"), tails, "log", "at", "body").count() == 0


def test_a_failed_logon_is_no_access(spark):
    rows = events_of(spark, event(1, 0, "LOGIN_FAILURE", user="Ann", source_host="A", destination_host="b", outcome="failure"), event(2, 1, "RDP_LOGIN", user="ann", source_host="A", destination_host="C"))
    users = spark.createDataFrame([("ANN", 0.5, True, ["B", "c", "D"])], "name string, privilege double, is_privileged boolean, accessible_hosts array<string>")
    hosts = spark.createDataFrame([("B", "server", 0.9)], "name string, role string, criticality double")
    got = {r.host: (r.activity_seen, r.access_succeeded, r.event_ids, r.criticality) for r in entities.user_access(rows, users, hosts).collect()}
    assert got == {"B": (True, False, ["e1"], 0.9), "C": (True, True, ["e2"], 0.0), "D": (False, False, [], 0.0)}


def test_chains_with_an_inventory_have_targets_in_their_risk(spark):
    rows = events_of(
        spark,
        event(1, 0, "POWERSHELL_EXEC", event_type="endpoint", user="ann", source_host="A", destination_host="A", suspicious=True, severity="high"),
        event(2, 53, "CREDENTIAL_ACCESS", event_type="endpoint", user="ann", source_host="A", destination_host="A", suspicious=True, severity="high"),
        event(3, 323, "RDP_LOGIN", user="ann", source_host="A", destination_host="B"),
    )
    hosts = spark.createDataFrame([("A", 0.1), ("B", 0.5), ("C", 1.0)], "name string, criticality double")
    users = spark.createDataFrame([("ann", 0.9, True, ["B", "C"])], "name string, privilege double, is_privileged boolean, accessible_hosts array<string>")
    plain, full = chains.build_chains(rows), chains.build_chains(rows, hosts=hosts, users=users)
    target = full["targets"].where("rank = 1").first()
    assert target.host == "C" and full["chains"].first().risk == min(100, round(plain["chains"].first().risk + 0.15 * target.score))
    cause = full["root_causes"].first()
    assert (cause.initial_event_id, cause.next_target) == ("e1", "C") and "inferred: movement" in cause.notes and cause.progression[-1] == "Lateral Movement on B"


def test_backtest_uses_earlier_events_only(spark):
    rows = events_of(spark, event(1, 0, "RDP_LOGIN", destination_host="X"), event(2, 10, "RDP_LOGIN", destination_host="Y"))
    us = lambda s: int(datetime.datetime(2026, 9, 30, 10, tzinfo=datetime.timezone.utc).timestamp() + s) * 1_000_000
    moves = spark.createDataFrame([("m1", "x", us(5)), ("m2", "X", us(20)), ("m3", "X", us(0))], "move_id string, host string, us long")
    rank = lambda e: e.select(F.dense_rank().over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy(F.desc("timestamp"))).alias("rank"), F.col("destination_host").alias("host"))
    assert datasets.backtest_targets(rows, moves, rank).first().asDict() == {"moves": 3, "predicted": 2, "top_1": 1, "top_3": 2}


def raw_rows(spark, *records):
    return spark.createDataFrame([(json.dumps(r), "feed", i) for i, r in enumerate(records)], "raw string, source_log string, position long")


def test_foreign_objects_are_translated_by_class(spark):
    meta = {"uid": "u1"}
    rows = raw_rows(
        spark,
        {"class_uid": 3002, "metadata": meta, "time": 1790762400000, "status_id": 2, "user": {"name": "ann"}, "src_endpoint": {"hostname": "a.corp", "ip": "10.0.0.1"}, "dst_endpoint": {"hostname": "srv"}, "logon_type_id": 10},
        {"class_uid": 4003, "metadata": {"uid": "u2"}, "time": "2026-09-30T10:00:00Z", "query": {"hostname": "x.example.com", "type": "A"}, "src_endpoint": {"hostname": "a"}},
        {"class_uid": 1007, "activity_id": 1, "metadata": {"uid": "u3"}, "time": 1790762400000, "device": {"hostname": "w1"}, "actor": {"user": {"name": "bob"}}, "process": {"name": "powershell.exe", "cmd_line": "powershell -enc AAAA", "parent_process": {"name": "winword.exe"}}},
        {"class_uid": 3003, "metadata": {"uid": "u4"}, "time": 1790762400000, "device": {"hostname": "w1"}, "user": {"name": "root1"}},
        {"class_uid": 2004, "metadata": {}},
        {"class_uid": 9999, "metadata": {}},
    )
    out = translate.normalize_ocsf(rows).collect()
    good = {r.event_id: r for r in out if r.parse_error is None}
    assert set(good) == {"u1", "u2", "u3", "u4"} and sorted(r.parse_error for r in out if r.parse_error) == ["a finding is no input event", "class 9999 is not read"]
    assert (good["u1"].action, good["u1"].user, good["u1"].source_host, good["u1"].destination_host) == ("LOGIN_FAILURE", "ann", "A", "SRV")
    assert good["u2"].domain == "x.example.com" and good["u2"].source_host == "A" and good["u2"].timestamp == good["u1"].timestamp
    assert good["u3"].action == "POWERSHELL_EXEC" and good["u3"].parent_process == "winword.exe" and '"class_uid": 1007' in good["u3"].raw
    assert good["u4"].action == "PRIVILEGED_LOGIN"


def test_export_rows_take_one_of_several_values(spark):
    rows = raw_rows(
        spark,
        {"result": {"sourcetype": "WinEventLog:Security", "EventCode": "4624", "RecordNumber": "7", "ComputerName": "we1.corp.local", "Account_Name": ["SYS$", "ann"], "Account_Domain": ["CORP", "CORP"], "Logon_Type": "3", "Workstation_Name": "WS9", "_time": "2016-08-24 10:00:00 MDT"}},
        {"sourcetype": "stream:dns", "query{}": ["q.example.com", "z"], "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "timestamp": "2016-08-24T16:00:00Z", "transaction_id": "5"},
        {"sourcetype": "stream:dns", "timestamp": "2016-08-24T16:00:00Z"},
        {"sourcetype": "stream:http", "_time": "2016-08-24 10:00:00 MDT"},
    )
    out = translate.normalize_export(rows, "exercise").collect()
    good = {r.event_id: r for r in out if r.parse_error is None}
    assert set(good) == {"exercise-sec-we1-7", "exercise-dns-2016-08-24T16:00:00Z-10.0.0.1-5"}
    logon, lookup = good["exercise-sec-we1-7"], good["exercise-dns-2016-08-24T16:00:00Z-10.0.0.1-5"]
    assert (logon.user, logon.source_host, logon.destination_host) == ("ann", "WS9", "WE1") and logon.timestamp == lookup.timestamp
    assert lookup.domain == "q.example.com" and "dataset:exercise" in lookup.tags and len(out) == 4


def test_trimmed_records_keep_lists_and_refuse_text(spark):
    lines = spark.createDataFrame([('{"a": [1, "x"], "b": 2}',), ("no json",), (None,)], "value string")
    got = [r.record and json.loads(r.record) for r in datasets.trim_record(lines, ("a", "c"), "d").collect()]
    assert got == [{"a": [1, "x"], "dataset": "d"}, None, None]


def test_latest_rows_before_a_move_are_met_by_place(spark):
    day = 86_400_000_000
    given = [(f"e{i:03}", "ann" if i % 3 else "bob", (i // 2) * (day // 10), f"H{i % 7}") for i in range(200)]
    rows = datasets.numbered(spark.createDataFrame(given, "event_id string, user string, us bigint, host string"), "user")
    moves = rows.where("host = 'H3'").withColumnRenamed("event_id", "move_id")
    found = datasets.latest_before(moves, rows, "user", 5)
    want = set()
    for e, user, us, host in given:
        past = sorted(((t, i, h) for i, u, t, h in given if u == user and t < us), reverse=True)[:5]
        want |= {(e, k + 1, h) for k, (_, _, h) in enumerate(past)} if host == "H3" else set()
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 100
