"""Readers and normalisers on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.sources import normalize as N
from socspark.sources import datasets, readers

AT = "2026-09-30T10:00:00Z"


def raw_rows(spark, *records):
    rows = [(r if isinstance(r, str) or r is None else json.dumps(r), "log", i) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, readers.RAW_SCHEMA)


def normal(spark, *records, **more):
    return N.normalize(raw_rows(spark, *records), **more).collect()


def test_formats_are_told_apart(spark):
    records = {
        "windows_security": {"EventID": "4624", "TimeCreated": AT},
        "sysmon": {"EventID": "1", "Image": "a.exe", "UtcTime": AT},
        "zeek_dns": {"query": "a.b", "ts": 1.0},
        "native": {"event_type": "dns", "action": "DNS_QUERY"},
        "cef": {"message": "CEF:0|a|b|1|1|x|1|act=deny"},
        "auditd": {"message": "type=EXECVE msg=audit(1.0:1): argc=0"},
        "cloudtrail": {"eventName": "x", "eventSource": "y", "awsRegion": "z"},
        "entra_signin": {"userPrincipalName": "a@b", "appDisplayName": "c"},
        "ecs": {"@timestamp": AT, "event": {"category": ["authentication"]}},
    }
    rows = N.detect_format(N.with_fields(raw_rows(spark, *records.values(), "not json", None, {"x": 1}))).orderBy("position").collect()
    assert [r.log_format for r in rows] == [*records, None, None, None]


def test_credential_switch_turns_its_sides(spark):
    (r,) = normal(spark, {"EventID": "4648", "TimeCreated": AT, "Computer": "ws1.corp.local", "TargetServerName": "srv9", "SubjectUserName": "ann", "TargetUserName": "CORP\\bob", "RecordId": "7"})
    assert (r.event_id, r.source_host, r.destination_host, r.user, r.action) == ("7", "WS1", "SRV9", "bob", "NETWORK_LOGON")
    assert {"credential-switch:ann", "explicit-credentials", "remote-origin", "finding:ann used the credentials of bob to reach SRV9"} <= set(r.tags)


def test_known_addresses_and_admin_shares(spark):
    hosts = spark.createDataFrame([("10.0.0.5", "hr-pc"), ("10.0.0.9", "file01"), (None, "x")], "ip string, name string")
    got = {r.event_id: r for r in normal(spark, {"EventID": "5140", "TimeCreated": AT, "Computer": "FILE01", "IpAddress": "10.0.0.5", "ShareName": "\\\\*\\admin$", "RecordId": "1"}, {"message": "CEF:0|a|b|1|1|x|1|rt=1790761620000 src=10.0.0.5 dst=10.0.0.9 dpt=445 act=accept externalId=2"}, hosts=hosts)}
    assert (got["1"].source_host, got["1"].severity, got["1"].suspicious) == ("HR-PC", "high", True)
    assert (got["2"].source_host, got["2"].destination_host) == ("HR-PC", "FILE01") and "finding:SMB connection between internal hosts 10.0.0.5 -> 10.0.0.9" in got["2"].tags


@pytest.mark.parametrize(
    ("record", "action", "severity"),
    [
        ({"EventID": "10", "SourceImage": "C:\\x\\evil.exe", "TargetImage": "C:\\Windows\\lsass.exe", "GrantedAccess": "0x1010"}, "CREDENTIAL_ACCESS", "critical"),
        ({"EventID": "11", "Image": "C:\\outlook.exe", "TargetFilename": "C:\\in\\bill.docm"}, "MALICIOUS_ATTACHMENT", "high"),
        ({"EventID": "11", "Image": "C:\\a.exe", "TargetFilename": "C:\\in\\bill.docm"}, "SUSPICIOUS_EXECUTABLE", "high"),
        ({"EventID": "11", "Image": "C:\\a.exe", "TargetFilename": "C:\\in\\note.txt"}, "PROCESS_CREATE", "info"),
        ({"EventID": "1", "Image": "psexec.exe", "CommandLine": "psexec.exe \\\\b cmd"}, "REMOTE_SERVICE_EXEC", "high"),
        ({"EventID": "1", "Image": "cmd.exe", "CommandLine": "cmd.exe /c dir"}, "COMMAND_EXEC", "low"),
        ({"EventID": "1", "Image": "wscript.exe", "CommandLine": "x"}, "SCRIPT_EXEC", "high"),
    ],
)
def test_sysmon_branches(spark, record, action, severity):
    row = N.sysmon(N.prepared(raw_rows(spark, record | {"UtcTime": AT, "Computer": "a"}), log_format="sysmon")).first()
    assert (row.action, row.severity) == (action, severity)


def test_ecs_is_routed(spark):
    got = normal(
        spark,
        {"@timestamp": AT, "winlog": {"channel": "Security", "event_id": 4625, "computer_name": "srv1.corp.local", "record_id": 5, "event_data": {"TargetUserName": "ann", "IpAddress": "10.1.1.1", "eventid": "1"}}},
        {"@timestamp": AT, "winlog.channel": "Microsoft-Windows-Sysmon/Operational", "winlog.event_id": "22", "winlog.computer_name": "srv1", "winlog.event_data": {"QueryName": "a.example.com", "Image": "c:\\x.exe"}},
        {"@timestamp": AT, "dns": {"question": {"name": "b.example.com"}}, "source": {"ip": "10.0.0.1"}, "event": {"id": "q1"}},
        {"@timestamp": AT, "event": {"category": ["authentication"], "outcome": "failure", "id": "e1"}, "user": {"name": "bob"}, "host": {"name": "web1"}},
        {"@timestamp": AT, "event": {"category": ["file"]}},
    )
    assert sorted((r.action, r.domain or "") for r in got if r.parse_error is None) == [("DNS_QUERY", "a.example.com"), ("DNS_QUERY", "b.example.com"), ("LOGIN_FAILURE", ""), ("LOGIN_FAILURE", "")]
    assert {"ecs-srv1-Security-5", "ecs-dns-q1", "e1"} <= {r.event_id for r in got} and sum(r.parse_error is not None for r in got) == 1


def test_bad_records_go_to_quarantine_and_equal_ones_stay_apart(spark):
    same = {"EventID": "4624", "TimeCreated": AT, "Computer": "a"}
    out = N.normalize(raw_rows(spark, same, same, "junk", None, {"query": "", "ts": 1}, {"EventID": "4624", "TimeCreated": "soon"}))
    good, bad = N.split_quarantine(out)
    assert good.select("event_id").distinct().count() == 2
    assert sorted(r.parse_error for r in bad.collect()) == ["DNS record has no query", "no readable time", "unable to detect the log format", "unable to detect the log format"]


def test_empty_input(spark):
    assert normal(spark) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('# note\n\n{"query": "a.b", "ts": 1}\n[{"query": "c.d", "ts": 2}, {"query": "e.f", "ts": 3}]\n{"records": [{"x": 1}]}\n')
    (tmp_path / "b.csv").write_text("EventID,TimeCreated\n4624,2026-09-30T10:00:00Z\n")
    (tmp_path / "_c.json").write_text('{"query": "hidden"}')
    rows = readers.read_log_dir(spark, str(tmp_path)).collect()
    assert sorted((r.source_log, r.raw) for r in rows) == [("a.jsonl", '{"query": "a.b", "ts": 1}'), ("a.jsonl", '{"query":"c.d","ts":2}'), ("a.jsonl", '{"query":"e.f","ts":3}'), ("a.jsonl", '{"x":1}'), ("b.csv", '{"EventID":"4624","TimeCreated":"2026-09-30T10:00:00Z"}')]


def test_syslog_and_sudo(spark):
    lines = ["<38>Sep 30 10:00:01 web1 sshd[12]: Failed password for invalid user ann from 10.0.0.1 port 2", "<86>1 2026-09-30T10:00:02Z web1.corp sudo 1 - - bob : TTY=x ; USER=root ; COMMAND=/bin/cat /etc/shadow", "<1>Sep 30 10:00:01 web1 cron: run", "junk", None]
    out = N.normalize(readers.parse_syslog(spark.createDataFrame([(x,) for x in lines], "value string"), 2026)).where("parse_error is null")
    assert sorted((r.action, r.user, r.destination_host) for r in out.collect()) == [("LOGIN_FAILURE", "ann", "WEB1"), ("PROCESS_CREATE", "bob", "WEB1")]


def test_intel(spark):
    lines = spark.createDataFrame([("# x",), ("Evil.Example.com,bad",), ("10.0.0.1",), ("??",), ("evil.example.com,again",)], "value string")
    assert sorted((r.kind, r.value, r.description) for r in readers.load_intel_lines(lines).collect()) == [("domain", "evil.example.com", "again"), ("ip", "10.0.0.1", "")]
    bundle = json.dumps({"objects": [{"type": "indicator", "name": "n", "pattern": "[domain-name:value = 'a.example.com']"}, {"type": "indicator", "revoked": True, "pattern": "[domain-name:value = 'b.example.com']"}]})
    assert [(r.kind, r.value) for r in readers.load_stix(spark.createDataFrame([(bundle,)], "value string")).collect()] == [("domain", "a.example.com")]


def test_page_after_a_bookmark(spark):
    df = spark.range(10).select(F.col("id").alias("t"))
    page, bookmark = readers.incremental_pull(df, "t", 3, 2)
    assert [r.t for r in page.collect()] == [4, 5] and bookmark.first().bookmark == 5


def test_pages_go_on_between_rows_of_one_time(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "t int, id string")
    page, mark = readers.incremental_pull(rows, "t", 0, 2, "id")
    b = mark.first()
    rest, last = readers.incremental_pull(rows, "t", b.bookmark, 9, "id", b.last_id)
    assert [r.id for r in page.collect() + rest.collect()] == ["a", "b", "c", "d"] and tuple(last.first()) == (2, "d")


def test_far_hosts_and_late_arguments_are_not_cut(spark):
    from socspark.operators import graph

    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(24)], "a string, b string")
    start = spark.createDataFrame([("n00",)], "id string")
    assert graph.hops(chain, start).agg({"hops": "max"}).first()[0] == 24
    assert graph.hops(chain, start, most=3).count() == 4
    assert len(graph.attack_path(chain, "n00", "n24").first().path) == 25 and graph.attack_path(chain, "n00", "n24", most=5).count() == 0
    keys = [f"a{i}" for i in range(70)][::-1] + ["argc", "auid"]
    got = spark.createDataFrame([(keys,)], "k array<string>").select(N._numbered(F.col("k"))["name"]).first()[0]
    assert got == [f"a{i}" for i in range(70)]


def planned(spark, rows) -> str:
    """The optimised plan's text in full."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_export_lines_are_parsed_once_for_all_fields(spark):
    record = {"EventCode": "4624", "Account_Name": ["-", "ann"], "other": 1}
    lines = spark.range(2).select(F.concat(F.lit(json.dumps({"result": record})[:-2]), F.lit(', "RecordNumber": "'), F.col("id").cast("string"), F.lit('"}}')).alias("value"))
    out = datasets.select_security_fields(lines, "d")
    assert planned(spark, out).lower().count("parsejson") == 1
    kept = {k: v for k, v in record.items() if k != "other"} | {"dataset": "d"}
    assert sorted((r.code, json.loads(r.record)["RecordNumber"]) for r in out.collect()) == [("4624", "0"), ("4624", "1")]
    assert all(json.loads(r.record).items() >= kept.items() and "other" not in r.record for r in out.collect())


def test_text_lines_are_searched_once_for_all_their_pairs(spark):
    text = lambda line: F.to_json(F.struct(F.concat(F.lit(line), F.col("id").cast("string")).alias("message")))
    rows = lambda line: N.prepared(spark.range(1).select(text(line).alias("raw"), F.lit("log").alias("source_log"), F.col("id").alias("position")), log_format="x")
    firewall = N.cef(rows("CEF:0|a|b|1|1|x|1|src=10.0.0.5 SRC=10.0.0.6 dst=10.0.0.9 dpt=445 act=accept externalId=2"))
    audit = N.auditd(rows("type=USER_LOGIN msg=audit(1.0:1): acct=\"ann\" acct=\"bob\" addr=10.0.0.5 res=success node=a"))
    for out in (firewall, audit):
        assert planned(spark, out).count("regexp_extract_all(") == 2
    (r,) = firewall.collect()
    assert (r.event_id, r.source_ip, r.destination_ip) == ("20", "10.0.0.5", "10.0.0.9") and any(t.endswith("10.0.0.5 -> 10.0.0.9") for t in r.tags)
    (r,) = audit.collect()
    assert (r.user, r.destination_host, r.action) == ("ann", "A0", "NETWORK_LOGON")


def test_private_addresses(spark):
    cases = {"10.0.0.0": True, "11.0.0.0": False, "172.31.255.255": True, "172.32.0.0": False, "192.168.1.1": True, "127.0.0.1": True, "169.254.0.9": True, "0.0.0.1": True, "8.8.8.8": False, "::1": False, "x": False, None: False}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "ip string, holds boolean")
    assert rows.where(~F.col("holds").eqNullSafe(C.is_private_ip(F.col("ip")))).count() == 0


def test_degrees_count_pairs_and_not_sets_of_neighbours(spark, monkeypatch):
    from socspark.operators import graph

    plans = []
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(planned(spark, df)) or df)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c"), ("a", None), (None, "c")], "a string, b string")
    got = {r.id: (r.degree, r.score) for r in graph.connectivity(pairs, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")).collect()}
    assert got == {"a": (2, 1.0), "b": (1, 0.5), "c": (2, 1.0), "d": (0, 0.0)}
    assert len(plans) == 1 and "distinct" not in plans[0].lower()
