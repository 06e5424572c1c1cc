"""Queries of rules and indicators over events that carry a raw record."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socspark.operators import detect, enrich, search, sigma, techniques
from socspark.plans.config import DetectionConfig
from socspark.plans.queries import EV, PRIMARY, as_security_events, query, security_events, table

NUMBER = "CAST(substr(event_id, 4) AS INT)"


def raw_events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Security events whose raw record holds hashes, a process number, a level and a nested zone, all from the event's number.

    With ``spread`` the narrow table is dealt over all cores first, as a small file is one task.
    """
    rows = table(spark, sf_dir, "events")
    events = as_security_events(rows.repartition(spark.sparkContext.defaultParallelism, "event_id") if spread else rows)
    n = F.expr(NUMBER)
    fields = F.struct(
        F.concat(F.lit("MD5=00,SHA256="), F.sha2((n % 750).cast("string"), 256)).alias("hashes"),
        (n % 4000).alias("ProcessId"),
        F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High"))), (n % 3 + 1).cast("int")).alias("integrityLEVEL"),
        F.struct(F.concat(F.lit("Z"), (n % 5).cast("string")).alias("Zone")).alias("Origin"),
    )
    return events.withColumn("raw", F.to_json(fields))


def generated_rules(count: int = 3000) -> list[dict]:
    """Rules of four kinds by their number: account and process, hash without a level, keywords, and (each hundredth) zone and process."""
    out = []
    for i in range(count):
        if i % 100 == 2:
            detection = {"zone": {"Origin.Zone": f"z{i % 5}", "ProcessId|gte": i}, "condition": "zone"}
        elif i % 3 == 0:
            detection = {"selection": {"User": f"USER{i % 40}", "ProcessId": i}, "condition": "selection"}
        elif i % 3 == 1:
            detection = {"selection": {"Hashes|contains": hashlib.sha256(str(i % 750).encode()).hexdigest()[:20]}, "filter": {"IntegrityLevel": "low"}, "condition": "selection and not filter"}
        else:
            detection = {"words": [f"app{i % 9}.exe  --run {i % 5}"], "condition": "1 of wor*"}
        out.append({"id": f"g{i:04}", "title": f"Generated {i}", "level": "high" if i % 2 else "low", "detection": detection})
    return out


MANY_SQL = rf"""WITH {EV}, n AS (SELECT *, {NUMBER} AS n FROM ev), r AS (SELECT unnest(range(3000)) AS i),
hit AS (SELECT event_id, i FROM n JOIN r ON i % 100 = 2 AND n % 5 = i % 5 AND n % 4000 >= i
  UNION ALL SELECT event_id, i FROM n JOIN r ON n % 4000 = i AND user = 'user' || i % 40 WHERE i % 100 <> 2 AND i % 3 = 0
  UNION ALL SELECT event_id, i FROM n JOIN r ON n % 750 = i % 750 WHERE i % 100 <> 2 AND i % 3 = 1 AND n % 3 <> 0
  UNION ALL SELECT event_id, i FROM n JOIN r ON command_line = 'app' || i % 9 || '.exe  --run ' || i % 5 WHERE i % 100 <> 2 AND i % 3 = 2)
SELECT event_id, coalesce(c, 0) AS n_rules, coalesce(ids, '') AS rules, suspicious OR coalesce(top, false) AS suspicious
FROM ev LEFT JOIN (SELECT event_id, count(*) AS c, string_agg('sigma:g' || lpad(i::VARCHAR, 4, '0'), ',' ORDER BY i) AS ids, bool_or(i % 2 = 1) AS top FROM hit GROUP BY 1) USING (event_id)"""


@query(MANY_SQL)
def match_many_rules(spark, sf_dir):
    """DET-3 with 3,000 rules, through the index."""
    out = sigma.match_sigma(raw_events(spark, sf_dir, spread=True), [sigma.compile_sigma(r) for r in generated_rules()])
    found = F.filter("tags", lambda t: t.startswith("sigma:"))
    return out.select("event_id", F.size(found).cast("long").alias("n_rules"), F.array_join(found, ",").alias("rules"), "suspicious")


@query(rf"WITH {EV}, n AS (SELECT event_id, {NUMBER} % 750 AS n FROM ev) SELECT event_id, 'hash' AS kind, sha256(n::VARCHAR) AS value FROM n WHERE n % 11 = 0")
def match_hashes(spark, sf_dir):
    """JOIN-5: hashes in raw records."""
    events = raw_events(spark, sf_dir)
    listed = events.select((F.expr(NUMBER) % 750).alias("n")).where("n % 11 = 0").distinct().select(F.lit("hash").alias("kind"), F.sha2(F.col("n").cast("string"), 256).alias("value"), F.lit("listed").alias("description"))
    return detect.match_intel(events, listed)


@query(rf"WITH {EV} SELECT DISTINCT ev.event_id, p.command_line AS pattern FROM ev JOIN (SELECT DISTINCT command_line FROM ev WHERE length(command_line) > 0) p ON contains(ev.command_line, p.command_line)")
def find_patterns(spark, sf_dir):
    """Every command line of the table as a pattern, in every command line."""
    events = security_events(spark, sf_dir)
    return search.occurrences(events.select("event_id", "command_line"), "command_line", events.select(F.col("command_line").alias("pattern")), "pattern")


@query(rf"WITH {EV}, n AS (SELECT *, {NUMBER} AS n FROM ev) SELECT event_id, n % 4000 > 3999.5 - 2000 AS gt, n % 4000 <= -5 AS lte, n % 5 = 3 AS zone, n % 750 = 12 AS word, n % 3 = 2 AS level, source_ip LIKE '10.0.2.%' AS net FROM n")
def rule_tests(spark, sf_dir):
    """DET-2: numbers with a sign or fraction, a path, keywords among values only, names in any case, networks."""
    events = raw_events(spark, sf_dir)
    test = lambda spec: sigma.compile_sigma({"detection": {"s": spec, "condition": "s"}}).predicate
    return events.select(
        "event_id",
        test({"processid|gt": "1999.5"}).alias("gt"),
        test({"ProcessId|lte": -5}).alias("lte"),
        test({"Origin.Zone": "z3"}).alias("zone"),
        test(["integritylevel", hashlib.sha256(b"12").hexdigest()]).alias("word"),
        test({"IntegrityLevel|re": "^h.gh$"}).alias("level"),
        test({"SourceIp|cidr": "10.0.2.0/24"}).alias("net"),
    )


#: Sign-ins at the console, service accounts, and the rest as it is.
CONSOLE = {
    "action": "CASE WHEN action = 'RDP_LOGIN' AND logon_type = 'Interactive' THEN 'LOGIN_SUCCESS' ELSE action END",
    "source_host": "CASE WHEN action = 'RDP_LOGIN' AND logon_type = 'Interactive' THEN destination_host ELSE source_host END",
    "source_ip": "CASE WHEN action = 'RDP_LOGIN' AND logon_type = 'Interactive' THEN CASE WHEN severity = 'info' THEN '127.0.0.1' END ELSE source_ip END",
    "user": f"CASE WHEN {NUMBER} % 23 = 0 AND action = 'PRIVILEGED_LOGIN' THEN 'DWM-1' WHEN {NUMBER} % 2 = 0 THEN upper(user) ELSE user END",
}


@query(
    f"""WITH RECURSIVE {EV}, e AS (SELECT * REPLACE ({', '.join(f"{sql} AS {name}" for name, sql in CONSOLE.items())}) FROM ev),
b AS (SELECT *, epoch_us(timestamp) AS us, {PRIMARY} AS host FROM e), s AS (SELECT lower(user) AS u, host AS h, us AS at_us FROM b WHERE action = 'LOGIN_SUCCESS' AND user IS NOT NULL AND destination_host IS NOT NULL),
w AS (SELECT *, CASE WHEN user = 'DWM-1' THEN 'service' WHEN user IS NULL THEN 'unnamed' WHEN EXISTS (SELECT 1 FROM s WHERE u = lower(b.user) AND h = b.host AND at_us BETWEEN b.us - 21600000000 AND b.us + 21600000000) THEN 'console' END AS why FROM b WHERE action = 'PRIVILEGED_LOGIN'),
p AS (SELECT *, row_number() OVER (PARTITION BY user, host ORDER BY us, event_id) AS n FROM w WHERE why IS NULL),
walk AS (SELECT event_id, user, host, n, us AS kept, event_id AS keeper, false AS again FROM p WHERE n = 1
  UNION ALL SELECT p.event_id, p.user, p.host, p.n, CASE WHEN p.us - kept <= 14400000000 THEN kept ELSE p.us END, CASE WHEN p.us - kept <= 14400000000 THEN keeper ELSE p.event_id END, p.us - kept <= 14400000000 FROM walk JOIN p ON p.user = walk.user AND p.host = walk.host AND p.n = walk.n + 1)
SELECT b.event_id, coalesce(why, CASE WHEN again THEN 'repeat of ' || keeper END) AS why FROM b LEFT JOIN w ON w.event_id = b.event_id LEFT JOIN walk ON walk.event_id = b.event_id"""
)
def console_suppression(spark, sf_dir):
    """WIN-1 and JOIN-9 over rows of all four kinds: service and unnamed accounts, console users, repeats."""
    events = security_events(spark, sf_dir)
    events = events.select(*[F.expr(CONSOLE[c]).alias(c) if c in CONSOLE else F.col(c) for c in events.columns])
    out = enrich.suppress_privileged(events, DetectionConfig(console_hours=6, privileged_repeat_seconds=14400))
    kind = F.when(F.contains("suppressed", F.lit("service account")), "service").when(F.contains("suppressed", F.lit("no named account")), "unnamed").when(F.contains("suppressed", F.lit("console user")), "console")
    return out.select("event_id", F.coalesce(kind, F.regexp_extract("suppressed", "^(repeat of [^ ]+)", 1)).alias("why"))


#: What an event does in each case, so that every technique rule meets rows: number, action, command line, process, tags, raw record, suspicious, whether it goes to another host.
CASES = [
    (0, "MALICIOUS_ATTACHMENT", None, None, ["file-create"], None, True, False),
    (1, "MALICIOUS_ATTACHMENT", None, None, [], None, True, False),
    (2, "POWERSHELL_EXEC", "powershell.exe -EncodedCommand x", "powershell.exe", [], None, True, False),
    (3, "COMMAND_EXEC", "dir", "cmd.exe", [], None, False, False),
    (4, "COMMAND_EXEC", "WHOAMI", "sh", ["linux"], None, False, False),
    (5, "PROCESS_CREATE", "net localgroup administrators", "net.exe", None, None, False, False),
    (6, "CREDENTIAL_ACCESS", "procdump -ma LSASS.exe", "procdump.exe", [], None, True, False),
    (7, "CREDENTIAL_ACCESS", "reg.exe save x", "reg.exe", [], None, True, False),
    (8, "LOGIN_FAILURE", None, None, ["credential-guessing"], None, True, False),
    (9, "RDP_LOGIN", None, None, [], None, False, True),
    (10, "RDP_LOGIN", None, None, [], None, False, False),
    (11, "SMB_AUTH", None, None, ["admin-share"], None, False, True),
    (12, "REMOTE_SERVICE_EXEC", "\\\\srv\\share\\x", "x", [], None, True, True),
    (13, "PRIVILEGED_LOGIN", None, None, [], None, False, False),
    (14, "SUSPICIOUS_DOMAIN", None, None, ["beaconing", "finding:DGA-like name"], None, True, False),
    (15, "DNS_QUERY", None, None, ["beaconing"], None, False, False),
    (16, "PROCESS_CREATE", None, "a.exe", [], '{"Image":"C:\\\\Users\\\\Temp\\\\a.exe"}', False, False),
    (17, "PROCESS_CREATE", None, "b.exe", [], '{"TargetFilename":"c:\\\\temp\\\\x.PS1"}', False, False),
    (18, "CLOUD_LOGGING_DISABLED", None, "StopLogging", [], None, True, False),
    (19, "CLOUD_PRIVILEGE_CHANGE", None, "CreateAccessKey", [], None, True, False),
    (20, "CLOUD_PRIVILEGE_CHANGE", None, "PutUserPolicy", [], None, True, False),
    (21, "LOGIN_SUCCESS", None, None, ["entra"], None, True, False),
    (22, "COMMAND_EXEC", "bash -i", "bash", ["auditd", "linux", "finding:reverse shell"], None, True, False),
    (23, "CREDENTIAL_ACCESS", None, "x.exe", ["finding:LSASS opened"], None, True, False),
    (24, "LOGIN_SUCCESS", None, None, ["entra"], None, False, False),
    (25, "PROCESS_CREATE", None, "c.exe", [], '{"TargetFilename":"c:\\\\temp\\\\x.txt"}', False, False),
]
EXPECTED = """(0, 'T1566.001', 'TA0001', 'high'), (1, 'T1204.002', 'TA0002', 'high'), (2, 'T1059.001', 'TA0002', 'high'), (2, 'T1027', 'TA0005', 'medium'), (3, 'T1059.003', 'TA0002', 'medium'), (4, 'T1033', 'TA0007', 'medium'),
 (5, 'T1069.002', 'TA0007', 'medium'), (6, 'T1003.001', 'TA0006', 'high'), (7, 'T1003.002', 'TA0006', 'high'), (8, 'T1110', 'TA0006', 'medium'), (9, 'T1021.001', 'TA0008', 'high'), (11, 'T1021.002', 'TA0008', 'high'),
 (12, 'T1569.002', 'TA0002', 'high'), (12, 'T1021.002', 'TA0008', 'high'), (13, 'T1078', 'TA0004', 'medium'), (14, 'T1071.004', 'TA0011', 'high'), (14, 'T1568.002', 'TA0011', 'medium'), (15, 'T1071.001', 'TA0011', 'medium'),
 (16, 'T1105', 'TA0011', 'medium'), (17, 'T1105', 'TA0011', 'medium'), (18, 'T1562.008', 'TA0005', 'high'), (19, 'T1098.001', 'TA0003', 'medium'), (20, 'T1098.003', 'TA0004', 'medium'), (21, 'T1078.004', 'TA0001', 'medium'),
 (22, 'T1059.004', 'TA0002', 'high'), (23, 'T1003.001', 'TA0006', 'high')"""


@query(f"WITH {EV}, x AS (SELECT * FROM (VALUES {EXPECTED}) AS t(c, technique, tactic, confidence)) SELECT event_id, technique, tactic, confidence FROM ev JOIN x ON {NUMBER} % {len(CASES)} = c")
def every_technique(spark, sf_dir):
    """DET-7: all rules, each with rows that it claims, and rows that none claims."""
    given = "c int, action string, command_line string, process string, tags array<string>, raw string, suspicious boolean, away boolean"
    told = spark.createDataFrame(CASES, given)
    events = security_events(spark, sf_dir).drop(*[c for c in told.columns if c != "c"]).withColumn("c", F.expr(NUMBER) % len(CASES))
    events = events.join(F.broadcast(told), "c").withColumns({"source_host": F.lit("A"), "destination_host": F.when(F.col("away"), "B").otherwise("A")})
    return techniques.map_techniques(events)
