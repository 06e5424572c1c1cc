"""Vendor records to normalised events.

A raw row is (raw, source_log, position): the record as JSON text, the file or
stream it came from, and its place there. Every normaliser is a narrow
projection; only known addresses and known domains are joined in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators.detect import unknown_domains
from socspark.plans.schemas import EVENT_SCHEMA
from socspark.plans.storage import shared_path

# Codes, labels and word lists of the vendors.
LOGON_ACTIONS = {"3": "NETWORK_LOGON", "8": "NETWORK_LOGON", "10": "RDP_LOGIN"}
LOGON_LABELS = {"2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive (RDP)", "11": "CachedInteractive"}
BLOCK_WORDS = ("deny", "denied", "drop", "dropped", "block", "blocked", "reject", "rejected", "reset-both", "reset")
LATERAL_PORTS = {"445": "SMB", "3389": "RDP", "5985": "WinRM", "5986": "WinRM", "135": "RPC"}
AUDIT_COMMANDS = ("EXECVE", "SYSCALL", "USER_CMD")
AUDIT_ACCOUNTS = ("ADD_USER", "ADD_GROUP", "USER_CHAUTHTOK")
AUDIT_LOGONS = ("USER_LOGIN", "USER_AUTH", "USER_START", "CRED_ACQ", "USER_ACCT")
REVERSE_SHELLS = ("/dev/tcp/", "nc -e", "bash -i", "mkfifo /tmp")
RISKY_CALLS = {
    "StopLogging": ("CloudTrail logging was stopped", "critical"),
    "DeleteTrail": ("a CloudTrail trail was deleted", "critical"),
    "UpdateTrail": ("a CloudTrail trail was changed", "medium"),
    "PutEventSelectors": ("CloudTrail event selection was changed", "medium"),
    "DeleteFlowLogs": ("VPC flow logs were deleted", "high"),
    "DisableGuardDuty": ("GuardDuty was disabled", "critical"),
    "DeleteDetector": ("a GuardDuty detector was deleted", "critical"),
    "CreateAccessKey": ("a new access key was created", "high"),
    "CreateLoginProfile": ("a console password was set for an IAM user", "high"),
    "UpdateLoginProfile": ("an IAM user's console password was changed", "medium"),
    "CreateUser": ("an IAM user was created", "medium"),
    "AttachUserPolicy": ("a policy was attached to an IAM user", "medium"),
    "AttachRolePolicy": ("a policy was attached to a role", "medium"),
    "PutUserPolicy": ("an inline policy was added to an IAM user", "medium"),
    "AddUserToGroup": ("an IAM user was added to a group", "medium"),
    "PutBucketPolicy": ("an S3 bucket policy was changed", "medium"),
    "PutBucketAcl": ("an S3 bucket ACL was changed", "medium"),
    "DeleteBucketEncryption": ("S3 bucket encryption was removed", "high"),
    "AuthorizeSecurityGroupIngress": ("a security group was opened for inbound traffic", "medium"),
}
LOGGING_CALLS = ("StopLogging", "DeleteTrail", "DeleteFlowLogs", "DisableGuardDuty", "DeleteDetector")
DENIED_ERRORS = ("AccessDenied", "UnauthorizedOperation", "Client.UnauthorizedOperation")
LEGACY_CLIENTS = ("Exchange ActiveSync", "IMAP4", "POP3", "Authenticated SMTP", "Other clients")

OBJECT = "map<string,string>"


def lower_keys(fields: Column, names: Column | None = None) -> Column:
    """The map with lower-case keys; of two spellings the first stays. ``names`` are those keys where a column has them."""
    names = F.transform(F.map_keys(fields), F.lower) if names is None else names
    pairs = F.arrays_zip(names.alias("k"), F.map_values(fields).alias("v"))
    single = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, F.map_values(fields))).otherwise(F.map_from_entries(single))


def with_fields(raw: DataFrame) -> DataFrame:
    """``raw`` with ``_f``: its top-level fields as text by lower-case name, null where the text is no JSON object."""
    parsed = raw.withColumn("_m", F.from_json("raw", OBJECT)).withColumn("_n", F.transform(F.map_keys("_m"), F.lower))
    return parsed.withColumn("_f", lower_keys(F.col("_m"), F.col("_n"))).drop("_m", "_n")


def field(*names: str) -> Column:
    """The first of the fields that is neither null, empty nor a dash."""
    return F.coalesce(*[C.present(F.col("_f")[n.lower()]) for n in names])


def inner(name: str, path: str) -> Column:
    """A value inside an object field; the first element where it is a list."""
    value = F.get_json_object(F.col("_f")[name.lower()], f"$.{path}")
    return C.present(F.when(value.startswith("["), F.get_json_object(value, "$[0]")).otherwise(value))


def lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def _texts(*parts: tuple[Column, Column | str]) -> Column:
    return C.findings(*[(c, F.lit(t) if isinstance(t, str) else t) for c, t in parts])


def _tags(tags: Column, found: Column) -> Column:
    return F.concat(tags, F.transform(found, lambda t: F.concat(F.lit("finding:"), t)))


def _minted(kind: str) -> Column:
    """An id from the record's place, so that equal records stay apart and a second run gives the same ids."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.concat_ws("|", "source_log", F.col("position").cast("string"), "raw"), 256), 1, 16))


def _event(rows: DataFrame, error: Column | None = None, **values: Column) -> DataFrame:
    """The columns of an event and ``parse_error``, which says why a record cannot be used."""
    values = {"source_log": F.coalesce("source_log", F.lit("unknown")), "raw": F.col("raw")} | values
    columns = [F.nullif(values[f.name], F.lit("")).alias(f.name) if f.dataType.typeName() == "string" and f.name in values else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA]
    late = F.when(values["timestamp"].isNull(), F.lit("no readable time"))
    return rows.select(*columns, (late if error is None else F.coalesce(error, late)).alias("parse_error"))


def windows_security(rows: DataFrame) -> DataFrame:
    """NORM-2. A credential switch (4648) is written where the sign-in comes from, so its sides are turned."""
    host, name = C.clean_host(field("Computer", "ComputerName", "destination_host")), C.clean_user(field("TargetUserName"))
    r = rows.withColumns(
        {
            "_code": F.coalesce(F.trim(field("EventID", "event_id")), F.lit("")),
            "_host": host,
            "_src": F.coalesce(C.clean_host(field("WorkstationName", "SourceWorkstation", "source_host")), F.col("_src_host")),
            "_server": C.clean_host(field("TargetServerName")),
            "_type": F.trim(field("LogonType", "logon_type")),
            "_share": field("ShareName", "RelativeTargetName"),
            "_acting": C.clean_user(field("SubjectUserName")),
            "_used": name,
        }
    )
    code, explicit = F.col("_code"), F.col("_code") == "4648"
    turned = explicit & F.coalesce((F.col("_server") != "LOCALHOST") & ~F.col("_server").eqNullSafe(F.col("_host")), F.lit(False))
    logon = F.coalesce(lookup(F.col("_type"), LOGON_ACTIONS), F.lit("LOGIN_SUCCESS"))
    shared = (logon == "NETWORK_LOGON") & F.col("_share").isNotNull()
    named = F.when(code == "4625", "LOGIN_FAILURE").when(code == "4672", "PRIVILEGED_LOGIN").when(code == "5140", "SMB_AUTH").when(code == "7045", "REMOTE_SERVICE_EXEC").when(explicit, "NETWORK_LOGON")
    r = r.withColumns(
        {
            "_action": F.coalesce(named, F.when(shared, "SMB_AUTH").otherwise(logon)),
            "_other": named.isNull(),
            "_from": F.when(explicit, F.col("_host")).otherwise(F.col("_src")),
            "_to": F.when(turned, F.col("_server")).otherwise(F.col("_host")),
            "_switch": F.coalesce(explicit & (F.col("_acting") != F.col("_used")), F.lit(False)),
        }
    )
    action = F.col("_action")
    admin = F.coalesce((action == "SMB_AUTH") & F.upper("_share").contains("ADMIN$"), F.lit(False))
    remote = F.coalesce((F.col("_from") != F.col("_to")) & action.isin("RDP_LOGIN", "SMB_AUTH", "NETWORK_LOGON"), F.lit(False))
    tags = _texts(
        (code != "", F.concat(F.lit("win:"), code)),
        (code == "4625", "failed-logon"),
        (code == "4672", "privileged"),
        (code == "5140", "smb-share"),
        (code == "7045", "service-install"),
        (explicit, "explicit-credentials"),
        (F.col("_switch"), F.concat(F.lit("credential-switch:"), F.col("_acting"))),
        (F.col("_switch"), F.concat(F.lit("finding:"), F.col("_acting"), F.lit(" used the credentials of "), F.col("_used"), F.lit(" to reach "), F.coalesce("_to", F.lit("a server")))),
        (F.col("_other") & (action == "RDP_LOGIN"), "rdp"),
        (F.col("_other") & (action == "SMB_AUTH"), "smb-share"),
        (admin, "admin-share"),
        (remote, "remote-origin"),
    )
    severity = F.when(admin | (code == "7045"), "high").when((code == "4672") | (F.col("_other") & (action == "RDP_LOGIN")), "medium").when(code.isin("4625", "5140", "4648"), "low").otherwise("info")
    process = C.basename(field("ProcessName", "process"))
    return _event(
        r,
        event_id=F.coalesce(field("RecordId", "record_id"), _minted("auth")),
        timestamp=C.parse_ts(field("TimeCreated", "timestamp", "@timestamp", "UtcTime")),
        event_type=F.lit("authentication"),
        action=action,
        user=C.clean_user(field("TargetUserName", "SubjectUserName", "user")),
        source_host=F.col("_from"),
        destination_host=F.col("_to"),
        source_ip=C.clean_ip(field("IpAddress", "SourceIp", "source_ip")),
        destination_ip=C.clean_ip(field("DestinationIp", "destination_ip")),
        process=F.when(code == "7045", F.coalesce(process, C.basename(field("ServiceFileName", "ImagePath")))).otherwise(process),
        logon_type=F.coalesce(lookup(F.col("_type"), LOGON_LABELS), F.col("_type")),
        outcome=F.when(code == "4625", "failure").otherwise("success"),
        severity=severity,
        suspicious=admin | (code == "7045"),
        tags=tags,
    )


def sysmon(rows: DataFrame) -> DataFrame:
    """NORM-3: process creation, process access (10) and file creation (11)."""
    r = rows.withColumns(
        {
            "_code": F.trim(F.coalesce(field("EventID", "event_id"), F.lit("1"))),
            "_host": C.clean_host(field("Computer", "ComputerName", "source_host")),
            "_image": C.basename(field("Image", "SourceImage", "process")),
            "_parent": C.basename(field("ParentImage", "parent_process")),
            "_command": field("CommandLine", "command_line"),
            "_file": C.basename(field("TargetFilename", "file_name")),
            "_target": C.basename(field("TargetImage")),
            "_access": field("GrantedAccess"),
        }
    )
    image, parent, command = F.col("_image"), F.col("_parent"), F.col("_command")
    low = F.lower(F.coalesce(image, F.lit("")))
    by_office = C.contains_any(F.lower(parent), C.OFFICE_PROCESSES)
    r = r.withColumns({"_found": C.process_findings(image, command, parent), "_discovery": C.discovery_findings(command), "_bad": F.coalesce(C.any_of(F.lower("_file").endswith(e) for e in C.ATTACHMENT_EXTENSIONS), F.lit(False))})
    some, bad = F.size("_found") > 0, F.col("_bad")
    in_office = C.contains_any(low, C.OFFICE_PROCESSES)
    branch = (
        F.when(F.col("_code") == "10", "access")
        .when(F.col("_code") == "11", F.when(~bad, "file").when(by_office | in_office, "attachment").otherwise("dropped"))
        .when(C.is_credential_activity(image, command), "credentials")
        .when(C.is_remote_exec(image, command), "remote")
        .when(low.isin("powershell.exe", "pwsh.exe"), "powershell")
        .when(low.isin("wscript.exe", "cscript.exe", "mshta.exe"), "script")
        .when((some & in_office) | by_office, "office")
        .when(F.size("_discovery") > 0, "discovery")
        .when(low == "cmd.exe", "cmd")
        .when(some, "other")
        .otherwise("plain")
    )
    r = r.withColumn("_branch", branch)
    # The action of each branch.
    actions = {"access": "CREDENTIAL_ACCESS", "file": "PROCESS_CREATE", "attachment": "MALICIOUS_ATTACHMENT", "dropped": "SUSPICIOUS_EXECUTABLE", "credentials": "CREDENTIAL_ACCESS", "remote": "REMOTE_SERVICE_EXEC"}
    actions |= {"powershell": "POWERSHELL_EXEC", "script": "SCRIPT_EXEC", "office": "MALICIOUS_ATTACHMENT", "discovery": "DISCOVERY_COMMAND", "cmd": "COMMAND_EXEC", "other": "SUSPICIOUS_EXECUTABLE", "plain": "PROCESS_CREATE"}
    b = F.col("_branch")
    severity = (
        F.when(b.isin("access", "credentials"), "critical")
        .when(b.isin("attachment", "dropped", "remote", "script", "office", "other") | ((b == "powershell") & some), "high")
        .when(b.isin("powershell", "discovery") | ((b == "cmd") & some), "medium")
        .when(b == "cmd", "low")
        .otherwise("info")
    )
    suspicious = some | b.isin("access", "attachment", "dropped", "credentials", "remote", "script", "office")
    more = _texts(
        (F.coalesce((b == "access") & (F.col("_target") != ""), F.lit(False)), F.concat(F.coalesce(image, F.lit("process")), F.lit(" opened a handle to "), F.col("_target"))),
        (F.coalesce((b == "access") & (F.col("_access") != ""), F.lit(False)), F.concat(F.lit("GrantedAccess="), F.col("_access"))),
        (b.isin("attachment", "dropped"), F.concat(F.lit("Suspicious file "), F.col("_file"), F.lit(" written to disk"))),
    )
    found = F.concat("_found", more, F.when(b == "discovery", F.col("_discovery")).otherwise(F.array().cast("array<string>")))
    tags = _texts(
        (F.lit(True), F.concat(F.lit("sysmon:"), F.col("_code"))),
        (b == "access", "process-access"),
        (F.col("_code") == "11", "file-create"),
        (b == "discovery", "discovery"),
        (suspicious, "suspicious-process"),
    )
    return _event(
        r,
        event_id=F.coalesce(field("RecordId", "record_id"), _minted("edr")),
        timestamp=C.parse_ts(field("UtcTime", "TimeCreated", "timestamp", "@timestamp")),
        event_type=F.lit("endpoint"),
        action=lookup(b, actions),
        user=C.clean_user(field("User", "SubjectUserName")),
        source_host=F.col("_host"),
        destination_host=F.col("_host"),
        source_ip=C.clean_ip(field("SourceIp", "source_ip")),
        destination_ip=C.clean_ip(field("DestinationIp", "destination_ip")),
        process=image,
        parent_process=parent,
        command_line=command,
        file_name=F.col("_file"),
        outcome=F.lit("success"),
        severity=severity,
        suspicious=suspicious,
        tags=_tags(tags, found),
    )


def dns(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """NORM-4. With a table of ``known`` domains, others are marked as new; distinct names are tested once and joined back."""
    r = rows.withColumn("_domain", F.lower(F.regexp_replace(F.trim(field("query", "domain")), r"\.+$", "")))
    if known is None:
        r = r.withColumn("_new", F.lit(False))
    else:
        names = r.select(F.col("_domain").alias("domain")).distinct().withColumn("event_id", F.col("domain"))
        fresh = unknown_domains(names, known).select(F.col("domain").alias("_domain"), F.lit(True).alias("_new"))
        r = r.join(fresh, "_domain", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    domain = F.col("_domain")
    r = r.withColumn("_found", C.domain_findings(domain))
    bad, new = F.size("_found") > 0, F.col("_new")
    found = F.concat("_found", _texts((new & ~bad, F.concat(domain, F.lit(" has not been observed in this environment before")))))
    return _event(
        r,
        F.when(domain.isNull() | (domain == ""), F.lit("DNS record has no query")),
        event_id=F.coalesce(field("uid", "record_id"), _minted("dns")),
        timestamp=C.parse_ts(field("ts", "timestamp", "@timestamp")),
        event_type=F.lit("dns"),
        action=F.when(bad, "SUSPICIOUS_DOMAIN").when(new, "NEWLY_OBSERVED_DOMAIN").otherwise("DNS_QUERY"),
        user=C.clean_user(field("user")),
        source_host=F.coalesce(C.clean_host(field("host", "source_host", "Computer")), F.col("_src_host")),
        source_ip=C.clean_ip(field("id.orig_h", "id_orig_h", "src_ip", "source_ip")),
        destination_ip=C.clean_ip(field("id.resp_h", "id_resp_h", "dst_ip", "destination_ip")),
        process=C.basename(field("process", "Image")),
        domain=domain,
        outcome=F.coalesce(field("rcode_name"), F.lit("NOERROR")),
        severity=F.when(bad, "high").when(new, "medium").otherwise("info"),
        suspicious=bad | new,
        tags=_tags(_texts((F.lit(True), "zeek:dns"), (F.lit(True), F.concat(F.lit("qtype:"), F.coalesce(field("qtype_name", "qtype"), F.lit("A"))))), found),
    )


def native(rows: DataFrame) -> DataFrame:
    """NORM-5: rows that already have the event columns; unknown types and severities are errors."""
    texts = {f.name: F.col("_f")[f.name] for f in EVENT_SCHEMA if f.dataType.typeName() == "string" and f.name != "raw"}
    texts |= {"source_log": F.coalesce(field("source_log"), F.col("source_log")), "event_id": F.coalesce(field("event_id"), _minted("evt")), "severity": F.coalesce(field("severity"), F.lit("low"))}
    error = F.when(~F.coalesce(texts["event_type"].isin("authentication", "dns", "endpoint", "network", "cloud"), F.lit(False)), F.lit("unknown event type")).when(C.severity_rank(texts["severity"]).isNull(), F.lit("unknown severity"))
    more = {"timestamp": C.parse_ts(field("timestamp")), "suspicious": F.coalesce(F.expr("try_cast(_f['suspicious'] AS BOOLEAN)"), F.lit(False)), "tags": F.coalesce(F.from_json(F.col("_f")["tags"], "array<string>"), F.array().cast("array<string>"))}
    return _event(rows, error, **(texts | more))


def ecs_logon(rows: DataFrame) -> DataFrame:
    """NORM-6, the part that is no Windows, Sysmon or DNS record: sign-ins of Linux, VPN and cloud."""
    failed = F.lower(F.coalesce(_ecs("event", "outcome"), F.lit("success"))) == "failure"
    signs_in = F.coalesce(F.col("_f")["event.category"], F.get_json_object(F.col("_f")["event"], "$.category")).contains("authentication")
    return _event(
        rows,
        F.when(~F.coalesce(signs_in, F.lit(False)), F.lit("ECS document is not a Windows, Sysmon, DNS or authentication event")),
        event_id=F.coalesce(_ecs("event", "id"), _minted("auth")),
        timestamp=C.parse_ts(F.coalesce(field("@timestamp"), _ecs("event", "created"))),
        event_type=F.lit("authentication"),
        action=F.when(failed, "LOGIN_FAILURE").otherwise("LOGIN_SUCCESS"),
        user=C.clean_user(_ecs("user", "name")),
        source_host=F.coalesce(C.clean_host(_ecs("source", "domain")), F.col("_src_host")),
        destination_host=C.clean_host(F.coalesce(_ecs("host", "hostname"), _ecs("host", "name"))),
        source_ip=C.clean_ip(_ecs("source", "ip")),
        process=_ecs("process", "name"),
        outcome=F.when(failed, "failure").otherwise("success"),
        severity=F.when(failed, "low").otherwise("info"),
        suspicious=F.lit(False),
        tags=_texts((F.lit(True), "ecs:authentication"), (failed, "failed-logon"), (F.lit(True), "ecs")),
    )


def _ecs(group: str, path: str) -> Column:
    """A value under its dotted name or inside its object."""
    return F.coalesce(field(f"{group}.{path}"), inner(group, path))


def route_ecs(rows: DataFrame) -> DataFrame:
    """ECS documents of Windows, Sysmon and DNS as records of those formats: ``_f`` and ``log_format`` change, ``_ecs`` marks them."""
    r = rows.withColumns(
        {
            "_ecs": F.col("log_format") == "ecs",
            "_channel": F.coalesce(_ecs("winlog", "channel"), F.lit("")),
            "_number": F.coalesce(_ecs("winlog", "event_id"), _ecs("event", "code")),
            "_name": F.coalesce(_ecs("winlog", "computer_name"), _ecs("host", "hostname"), _ecs("host", "name")),
            "_record": F.coalesce(_ecs("winlog", "record_id"), _ecs("event", "id")),
            "_when": F.coalesce(field("@timestamp"), _ecs("event", "created")),
            "_data": F.from_json(F.coalesce(F.col("_f")["winlog.event_data"], F.get_json_object(F.col("_f")["winlog"], "$.event_data")), OBJECT),
            "_query": F.coalesce(_ecs("dns", "question.name"), _ecs("zeek", "dns.query")),
        }
    )
    r = r.withColumn("_data", lower_keys(F.coalesce("_data", F.create_map().cast(OBJECT))))
    uid = F.concat(F.lit("ecs-"), F.lower(F.substring_index(F.coalesce("_name", F.lit("host")), ".", 1)), F.lit("-"), F.coalesce(F.nullif(F.substring_index("_channel", "/", 1), F.lit("")), F.lit("event")), F.lit("-"), F.col("_record"))
    by_number = (F.col("_channel") == "") & (F.expr("try_cast(_number AS INT)") >= 4600) & (F.size("_data") > 0)
    in_sysmon = F.lower("_channel").contains("sysmon")
    log_format = (
        F.when(F.col("_channel").isin("Security", "System") | F.coalesce(by_number, F.lit(False)), "windows_security")
        .when(in_sysmon & (F.col("_number") == "22"), "zeek_dns")
        .when(in_sysmon, "sysmon")
        .when(F.col("_query").isNotNull(), "zeek_dns")
        .otherwise("ecs")
    )

    def record(**values: Column) -> Column:
        """Event data with the given fields in place of its own; no key appears twice."""
        names = [n.lower() for n in values]
        rest = F.map_filter("_data", lambda k, v: ~k.isin(*names))
        return F.map_concat(rest, F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n.lower()), v)]), lambda k, v: v.isNotNull()))

    source = _ecs("source", "ip")
    lookup_fields = {
        "timestamp": F.col("_when"),
        "query": F.when(in_sysmon, F.col("_data")["queryname"]).otherwise(F.col("_query")),
        "host": F.when(in_sysmon, F.col("_name")).when(source.isNull(), F.coalesce(_ecs("host", "hostname"), _ecs("host", "name"))),
        "process": F.when(in_sysmon, F.col("_data")["image"]).otherwise(_ecs("process", "name")),
        "id.orig_h": F.coalesce(source, _ecs("client", "ip")),
        "id.resp_h": F.coalesce(_ecs("destination", "ip"), _ecs("server", "ip")),
        "qtype_name": _ecs("dns", "question.type"),
        "uid": F.when(in_sysmon, uid).otherwise(F.concat(F.lit("ecs-dns-"), F.coalesce(_ecs("zeek", "session_id"), _ecs("event", "id")))),
    }
    fields = (
        F.when(log_format == "windows_security", record(EventID=F.col("_number"), TimeCreated=F.col("_when"), Computer=F.col("_name"), RecordId=uid))
        .when(log_format == "sysmon", record(EventID=F.col("_number"), UtcTime=F.coalesce(F.col("_data")["utctime"], F.col("_when")), Computer=F.col("_name"), RecordId=uid))
        .when(log_format == "zeek_dns", F.map_filter(F.create_map(*[x for n, v in lookup_fields.items() for x in (F.lit(n), v)]), lambda k, v: v.isNotNull()))
        .otherwise(F.col("_f"))
    )
    changed = r.withColumns({"_f": F.when(F.col("_ecs"), fields).otherwise(F.col("_f")), "log_format": F.when(F.col("_ecs"), log_format).otherwise(F.col("log_format"))})
    return changed.drop("_channel", "_number", "_name", "_record", "_when", "_data", "_query")


def _with_pairs(rows: DataFrame, text: Column, pattern: str, value: Callable[[Column], Column]) -> DataFrame:
    """``_f`` with the pairs that a two-group pattern finds in a text line, where it lacks them; the first value of a key stays.

    Keys and values are columns, so that the line is searched once for each and not again for every pair.
    """
    found = lambda group: F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    r = rows.withColumn("_text", text).withColumns({"_keys": F.transform(found(1), F.lower), "_values": F.transform(found(2), value)})
    first = F.filter(F.arrays_zip(F.col("_keys").alias("k"), F.col("_values").alias("v")), lambda p, i: F.array_position(F.col("_keys"), p["k"]) == i + 1)
    r = r.withColumn("_p", F.coalesce(F.map_from_entries(first), F.create_map().cast(OBJECT)))
    return r.withColumn("_f", F.map_concat("_f", F.map_filter("_p", lambda k, v: ~F.map_contains_key(F.col("_f"), k)))).drop("_text", "_keys", "_values", "_p")


CEF_PART = r"((?:[^|\\]|\\.)*+)"
CEF_HEADER = r"(?s)CEF:\d+\|" + r"\|".join([CEF_PART] * 6) + r"\|(.*)$"
CEF_PAIR = r"(\w+)=((?:[^=\\]|\\.)*?)(?=\s+\w+=|\s*$)"


def cef(rows: DataFrame) -> DataFrame:
    """NORM-9: firewall lines, or records with the same fields."""
    line = field("message", "raw", "_raw")
    r = rows.withColumn("_line", F.when(line.contains("CEF:"), line)).withColumn("_ext", F.regexp_extract("_line", CEF_HEADER, 7))
    r = _with_pairs(r, F.col("_ext"), CEF_PAIR, C.cef_unescape)
    r = r.withColumns({"_vendor": F.coalesce(field("deviceVendor"), F.nullif(F.regexp_extract("_line", CEF_HEADER, 1), F.lit(""))), "_at": field("rt", "end", "start", "timestamp", "@timestamp"), "_port": F.coalesce(field("dpt"), F.lit("")), "_act": F.lower(F.coalesce(field("act", "outcome", "deviceAction"), F.lit("")))})
    src, dst = field("src"), field("dst")
    milliseconds = F.timestamp_millis(F.expr("try_cast(_at AS BIGINT)"))
    r = r.withColumns(
        {
            "_time": F.when(F.col("_at").rlike("^[0-9]+$"), milliseconds).otherwise(C.parse_ts(F.col("_at"))),
            "_blocked": F.col("_act").isin(*BLOCK_WORDS) | F.arrays_overlap(F.split("_act", r"\s+"), F.array(*map(F.lit, BLOCK_WORDS))),
            "_in": F.coalesce(C.is_private_ip(src), F.lit(False)),
            "_within": F.coalesce(C.is_private_ip(dst), F.lit(False)),
        }
    )
    blocked, port = F.col("_blocked"), F.col("_port")
    outbound = blocked & dst.isNotNull() & F.col("_in") & ~F.col("_within")
    service = lookup(port, LATERAL_PORTS)
    sideways = service.isNotNull() & F.col("_in") & F.col("_within") & ~blocked
    found = _texts(
        (outbound, F.concat(F.lit("outbound connection from "), src, F.lit(" to "), dst, F.lit(":"), F.coalesce(F.nullif(port, F.lit("")), F.lit("?")), F.lit(" was blocked by the firewall"))),
        (sideways, F.concat(service, F.lit(" connection between internal hosts "), src, F.lit(" -> "), dst)),
    )
    seconds = F.format_string("%d.%03d", F.floor(F.unix_millis("_time") / 1000), F.pmod(F.unix_millis("_time"), F.lit(1000)))
    return _event(
        r,
        F.when(F.col("_line").isNotNull() & ~F.col("_line").rlike(CEF_HEADER), F.lit("not a CEF line")),
        event_id=F.coalesce(field("externalId", "eventId"), F.concat(F.lit("cef-"), seconds, F.lit("-"), F.coalesce(src, F.lit("None")), F.lit("-"), F.coalesce(dst, F.lit("None")), F.lit("-"), port)),
        timestamp=F.col("_time"),
        event_type=F.lit("network"),
        action=F.when(blocked, "CONNECTION_BLOCKED").otherwise("NETWORK_CONNECTION"),
        user=C.clean_user(field("suser", "duser")),
        source_host=F.col("_src_host"),
        destination_host=F.coalesce(F.col("_dst_host"), field("dhost")),
        source_ip=src,
        destination_ip=dst,
        domain=F.when(F.col("_dst_host").isNull(), field("dhost")),
        outcome=F.when(blocked, "failure").otherwise("success"),
        severity=F.when(outbound, "low").otherwise("info"),
        suspicious=F.lit(False),
        tags=_tags(_texts((F.lit(True), "network"), (F.lit(True), "cef"), (F.lit(True), F.concat(F.lit("vendor:"), F.lower(F.coalesce("_vendor", F.lit("unknown")))))), found),
    )


AUDIT_PAIR = r"(\w+)=(\"[^\"]*\"|[^\s'\"]+)"


def _numbered(keys):
    """The names ``a0``, ``a1``, ... among ``keys``, in order of their numbers."""
    found = F.filter(keys, lambda k: k.rlike("^a[0-9]{1,9}$"))
    return F.array_sort(F.transform(found, lambda k: F.struct(F.substring(k, F.lit(2), F.length(k)).cast("int").alias("n"), k.alias("name"))))


def auditd(rows: DataFrame) -> DataFrame:
    """NORM-10: commands, account changes and sign-ins of Linux hosts."""
    line = field("message", "raw")
    r = rows.withColumn("_line", F.when(line.contains("type="), line))
    flat = F.replace(F.regexp_replace("_line", r"msg='", " "), F.lit("'"), F.lit(" "))
    r = _with_pairs(r, flat, AUDIT_PAIR, lambda v: F.regexp_replace(v, '^"|"$', ""))
    stamp = F.coalesce(F.col("_line"), field("msg"))
    name = F.upper(field("node", "hostname", "host"))
    r = r.withColumns(
        {
            "_kind": F.upper(F.coalesce(field("type"), F.lit(""))),
            "_at": F.nullif(F.regexp_extract(stamp, r"audit\((\d+(?:\.\d+)?):\d+\)", 1), F.lit("")),
            "_serial": F.nullif(F.regexp_extract(stamp, r"audit\(\d+(?:\.\d+)?:(\d+)\)", 1), F.lit("")),
            "_host": F.when(~name.isin("?", "(NONE)"), name),
            "_args": F.array_compact(F.transform(_numbered(F.map_keys("_f")), lambda k: C.hex_decode(F.col("_f")[k["name"]]))),
            "_addr": F.coalesce(field("addr"), F.lit("")),
        }
    )
    r = r.withColumn("_time", C.parse_ts(F.coalesce(field("timestamp", "@timestamp"), F.col("_at"))))
    exe = field("exe")
    command = F.coalesce(F.nullif(F.array_join("_args", " "), F.lit("")), C.hex_decode(field("cmd")), exe)
    r = r.withColumns({"_command": command, "_process": F.element_at(F.split(F.coalesce(exe, F.get("_args", F.lit(0))), "/"), -1)})
    kind = F.col("_kind")
    runs, changes, remote = kind.isin(*AUDIT_COMMANDS), kind.isin(*AUDIT_ACCOUNTS), ~F.col("_addr").isin("", "?", "127.0.0.1", "::1")
    shell = runs & C.contains_any(F.lower("_command"), REVERSE_SHELLS)
    nothing = F.array().cast("array<string>")
    r = r.withColumn(
        "_found",
        F.when(runs, F.concat(C.process_findings(F.col("_process"), F.col("_command"), F.lit(None).cast("string")), _texts((shell, "reverse shell pattern in command line"))))
        .when(changes, F.array(F.concat(F.lit("account change on Linux host: "), kind)))
        .otherwise(nothing),
    )
    some, worked = F.size("_found") > 0, F.coalesce(F.lower(field("res")).isin("success", "yes", "1"), F.lit(False))
    logon = ~runs & ~changes
    return _event(
        r,
        F.when(~kind.isin(*AUDIT_COMMANDS, *AUDIT_ACCOUNTS, *AUDIT_LOGONS), F.concat(F.lit("auditd record type "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("?")), F.lit(" is not used"))),
        event_id=F.concat(F.lit("auditd-"), F.coalesce("_host", F.lit("linux")), F.lit("-"), F.coalesce("_serial", F.unix_millis("_time").cast("string")), F.lit("-"), F.lower(kind)),
        timestamp=F.col("_time"),
        event_type=F.when(logon, "authentication").otherwise("endpoint"),
        action=F.when(logon, F.when(worked & remote, "NETWORK_LOGON").when(worked, "LOGIN_SUCCESS").otherwise("LOGIN_FAILURE")).when(some, "COMMAND_EXEC").otherwise("PROCESS_CREATE"),
        user=C.clean_user(field("acct", "AUID", "UID", "user", "auid_name")),
        source_host=F.when(logon & remote, F.col("_src_host")).otherwise(F.col("_host")),
        destination_host=F.col("_host"),
        source_ip=F.when(logon & remote, F.col("_addr")),
        process=F.when(runs | changes, F.col("_process")),
        command_line=F.when(runs, F.col("_command")),
        logon_type=F.when(logon, F.when(remote, "ssh").otherwise("local")),
        outcome=F.when(logon & ~worked, "failure").otherwise("success"),
        severity=F.when(logon, F.when(worked, "low").otherwise("info")).when(shell, "high").when(some, "medium").otherwise("info"),
        suspicious=~logon & some,
        tags=_tags(_texts((F.lit(True), "auditd"), (F.lit(True), F.concat(F.lit("auditd:"), F.lower(kind))), (F.lit(True), "linux")), F.col("_found")),
    )


def cloudtrail(rows: DataFrame) -> DataFrame:
    """NORM-11: console sign-ins and calls of a cloud account."""
    last = F.nullif(F.element_at(F.split(inner("userIdentity", "arn"), "/"), -1), F.lit(""))
    address = field("sourceIPAddress")
    r = rows.withColumns(
        {
            "_call": F.coalesce(field("eventName"), F.lit("")),
            "_who": F.coalesce(inner("userIdentity", "userName"), inner("userIdentity", "sessionContext.sessionIssuer.userName"), last, inner("userIdentity", "type")),
            "_root": F.coalesce(inner("userIdentity", "type") == "Root", F.lit(False)),
            "_error": field("errorCode"),
            "_params": F.coalesce(field("requestParameters"), F.lit("")),
        }
    )
    call, params, error = F.col("_call"), F.col("_params"), F.col("_error")
    console = call == "ConsoleLogin"
    failed = F.when(console, F.coalesce(inner("responseElements", "ConsoleLogin") == "Failure", F.lit(False)) | error.isNotNull()).otherwise(error.isNotNull())
    admin = call.isin("AttachUserPolicy", "AttachRolePolicy", "AttachGroupPolicy") & params.contains("AdministratorAccess")
    public = call.isin("PutBucketPolicy", "PutBucketAcl") & C.contains_any(params, ('"*"', "AllUsers", "'*'", '\\"*\\"'))
    text = F.when(admin, "the AdministratorAccess policy was attached").when(public, "an S3 bucket was made public").otherwise(lookup(call, {k: t for k, (t, _) in RISKY_CALLS.items()}))
    level = F.when(admin | public, "high").otherwise(lookup(call, {k: s for k, (_, s) in RISKY_CALLS.items()}))
    r = r.withColumns({"_risk": F.when(~console & error.isNull(), text), "_level": level, "_failed": failed})
    risky, denied = F.col("_risk").isNotNull(), F.coalesce(~console & error.isin(*DENIED_ERRORS), F.lit(False))
    bare = console & ~F.col("_failed") & F.coalesce(F.lower(inner("additionalEventData", "MFAUsed")) == "no", F.lit(False))
    found = _texts(
        (bare, "console sign-in without MFA"),
        (console & F.col("_root"), "sign-in as the AWS root user"),
        (risky, F.concat(F.col("_risk"), F.lit(" by "), F.coalesce("_who", F.lit("unknown identity")))),
        (denied, F.concat(call, F.lit(" was denied ("), error, F.lit(")"))),
    )
    account = F.coalesce(field("recipientAccountId"), inner("userIdentity", "accountId"), F.lit("aws"))
    return _event(
        r,
        event_id=F.concat(F.lit("aws-"), F.coalesce(field("eventID"), F.concat_ws("-", call, field("eventTime")))),
        timestamp=C.parse_ts(field("eventTime")),
        event_type=F.when(console, "authentication").otherwise("cloud"),
        action=F.when(console, F.when(F.col("_failed"), "LOGIN_FAILURE").otherwise("LOGIN_SUCCESS")).when(risky & call.isin(*LOGGING_CALLS), "CLOUD_LOGGING_DISABLED").when(risky, "CLOUD_PRIVILEGE_CHANGE").otherwise("CLOUD_API_CALL"),
        user=C.clean_user(F.col("_who")),
        destination_host=F.concat(F.lit("AWS-"), account),
        source_ip=F.when(address.rlike("^[0-9a-fA-F:.]+$"), address),
        process=F.when(~console, call),
        logon_type=F.when(console, "cloud-console"),
        outcome=F.when(F.col("_failed"), "failure").otherwise("success"),
        severity=F.when(console, F.when(bare | F.col("_root"), "medium").otherwise("low")).when(risky, F.col("_level")).when(denied, "low").otherwise("info"),
        suspicious=F.when(console, F.col("_root")).otherwise(risky & F.coalesce(F.col("_level").isin("high", "critical"), F.lit(False))),
        tags=_tags(_texts((F.lit(True), "cloud"), (F.lit(True), "aws"), (F.lit(True), "cloudtrail"), (F.lit(True), F.concat(F.lit("aws:"), F.coalesce(F.substring_index(field("eventSource"), ".", 1), F.lit(""))))), found),
    )


def entra(rows: DataFrame) -> DataFrame:
    """NORM-12: sign-ins to cloud applications; the fields may lie inside ``properties``."""
    own = F.from_json(F.col("_f")["properties"], OBJECT)
    r = rows.withColumn("_outer", F.col("_f")).withColumn("_f", F.coalesce(lower_keys(own), F.col("_f")))
    app = F.coalesce(field("appDisplayName", "resourceDisplayName"), F.lit("Microsoft 365"))
    r = r.withColumns(
        {
            "_code": F.coalesce(F.get_json_object(F.col("_f")["status"], "$.errorCode"), F.col("_f")["resulttype"], F.lit("0")),
            "_risk": F.lower(F.coalesce(field("riskLevelDuringSignIn", "riskLevelAggregated"), F.lit("none"))),
            "_app": app,
            "_place": F.concat_ws(", ", inner("location", "city"), inner("location", "countryOrRegion")),
            "_who": field("userPrincipalName", "userDisplayName"),
            "_client": field("clientAppUsed"),
        }
    )
    failed, risk = ~F.col("_code").isin("0", ""), F.col("_risk")
    legacy = F.coalesce((F.lower(F.coalesce(F.col("_f")["isinteractive"], F.lit("true"))) == "true") & F.col("_client").isin(*LEGACY_CLIENTS), F.lit(False))
    reason = F.coalesce(inner("status", "failureReason"), field("resultDescription"), F.concat(F.lit("error "), F.col("_code")))
    r = r.withColumn("_found", _texts((failed, F.concat(F.lit("sign-in to "), F.col("_app"), F.lit(" failed: "), reason)), (risk.isin("medium", "high"), F.concat(F.lit("Microsoft rated this sign-in "), risk, F.lit(" risk"))), (legacy, F.concat(F.lit("legacy authentication protocol used ("), F.col("_client"), F.lit(")")))))
    label = F.regexp_replace(F.regexp_replace("_app", "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    outer = F.col("_outer")
    return _event(
        r,
        event_id=F.concat(F.lit("entra-"), F.coalesce(field("id"), C.present(outer["correlationid"]), F.concat_ws("-", F.col("_who"), field("createdDateTime")))),
        timestamp=C.parse_ts(F.coalesce(field("createdDateTime"), C.present(outer["time"]))),
        event_type=F.lit("authentication"),
        action=F.when(failed, "LOGIN_FAILURE").otherwise("LOGIN_SUCCESS"),
        user=C.clean_user(F.substring_index("_who", "@", 1)),
        destination_host=F.concat(F.lit("M365-"), F.substring(F.upper(label), 1, 30)),
        source_ip=field("ipAddress"),
        logon_type=F.lit("cloud"),
        outcome=F.when(failed, "failure").otherwise("success"),
        severity=F.when(risk == "high", "high").when((risk == "medium") | (F.size("_found") > 1), "medium").otherwise("low"),
        suspicious=risk == "high",
        tags=_tags(_texts((F.lit(True), "cloud"), (F.lit(True), "entra"), (F.lit(True), "m365"), (F.col("_place") != "", F.concat(F.lit("location:"), F.col("_place")))), F.col("_found")),
    )


#: EXT-1: name -> (test of the field names and ``_f``, normaliser), in the order of the tests.
NORMALIZERS: dict[str, tuple[Column | Callable[[], Column], Callable[[DataFrame], DataFrame]]] = {}


def register_normalizer(name: str, test: Callable[[], Column], normaliser: Callable[[DataFrame], DataFrame], first: bool = False) -> None:
    """Adds a source format; ``first`` puts its test before the others."""
    old = {k: v for k, v in NORMALIZERS.items() if k != name}
    NORMALIZERS.clear()
    NORMALIZERS.update({name: (test, normaliser)} | old if first else old | {name: (test, normaliser)})


def _has_all(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains("_k", n) for n in names])


def _has_any(*names: str) -> Column:
    return F.arrays_overlap("_k", F.array(*map(F.lit, names)))


def _line_has(text: str) -> Column:
    return C.contains_any(F.substring(field("message", "raw", "_raw"), 1, 200), (text,))


def _audit_line() -> Column:
    line = field("message", "raw")
    named = F.upper(F.coalesce(F.col("_f")["type"], F.lit(""))).isin(*AUDIT_COMMANDS, *AUDIT_ACCOUNTS, *AUDIT_LOGONS)
    return F.coalesce(line.startswith("type=") & line.contains("audit("), F.lit(False)) | (named & _has_any("msg", "auid"))


def _entra_keys() -> Column:
    keys = F.transform(F.coalesce(F.json_object_keys(F.col("_f")["properties"]), F.col("_k")), F.lower)
    return F.array_contains(keys, "userprincipalname") & F.arrays_overlap(keys, F.array(F.lit("appdisplayname"), F.lit("createddatetime")))


def _ecs_keys() -> Column:
    return F.exists("_k", lambda k: (k == "winlog") | k.startswith("winlog.") | (k == "ecs.version")) | (_has_all("@timestamp") & _has_any("event", "host", "dns", "source", "ecs", "agent"))


register_normalizer("cloudtrail", lambda: _has_all("eventname", "eventsource") & _has_any("awsregion", "useridentity"), cloudtrail)
register_normalizer("entra_signin", _entra_keys, entra)
register_normalizer("cef", lambda: _line_has("CEF:") | _has_all("devicevendor", "deviceproduct"), cef)
register_normalizer("auditd", _audit_line, auditd)
register_normalizer("ecs", _ecs_keys, ecs_logon)
register_normalizer("native", lambda: _has_all("event_type", "action"), native)
register_normalizer("zeek_dns", lambda: _has_any("query", "qtype_name", "id.orig_h", "id_orig_h"), dns)
register_normalizer("sysmon", lambda: _has_any("image", "parentimage", "commandline", "targetfilename", "targetimage"), sysmon)
register_normalizer("windows_security", lambda: _has_any("eventid", "event_id"), windows_security)


def detect_format(rows: DataFrame) -> DataFrame:
    """NORM-1: ``log_format`` by the first test that holds; null for text that is no object or has no known fields."""
    r = rows.withColumn("_k", F.map_keys("_f"))
    branches = [F.when(F.coalesce(test(), F.lit(False)), F.lit(name)) for name, (test, _) in NORMALIZERS.items()]
    return r.withColumn("log_format", F.coalesce(*branches)).drop("_k")


def resolve_hosts(rows: DataFrame, hosts: DataFrame | None) -> DataFrame:
    """JOIN-1: ``_src_host`` and ``_dst_host`` from an inventory of (ip, name). Spark measures the inventory before it broadcasts it."""
    if hosts is None:
        return rows.withColumns({"_src_host": F.lit(None).cast("string"), "_dst_host": F.lit(None).cast("string")})
    audit = F.nullif(F.regexp_extract(field("message", "raw"), r"\baddr=([0-9A-Fa-f:.]+)", 1), F.lit(""))
    line = field("message", "raw", "_raw")
    src = F.coalesce(field("IpAddress", "SourceIp", "source_ip", "id.orig_h", "id_orig_h", "src_ip", "src", "addr"), _ecs("source", "ip"), F.nullif(F.regexp_extract(line, r"\bsrc=(\S+)", 1), F.lit("")), audit)
    dst = F.coalesce(field("dst"), F.nullif(F.regexp_extract(line, r"\bdst=(\S+)", 1), F.lit("")))
    known = hosts.where(F.col("ip").isNotNull() & F.col("name").isNotNull()).groupBy("ip").agg(F.min("name").alias("name"))
    sides = rows.withColumns({"_src_ip": src, "_dst_ip": dst})
    for side in ("_src", "_dst"):
        sides = sides.join(known.select(F.col("ip").alias(f"{side}_ip"), F.upper("name").alias(f"{side}_host")), f"{side}_ip", "left")
    return sides.drop("_src_ip", "_dst_ip")


def prepared(raw: DataFrame, hosts: DataFrame | None = None, log_format: str | None = None) -> DataFrame:
    """``raw`` with fields, format and known hosts; a given ``log_format`` is not tested."""
    rows = with_fields(raw)
    rows = detect_format(rows) if log_format is None else rows.withColumn("log_format", F.lit(log_format))
    return resolve_hosts(route_ecs(rows), hosts)


def normalize(raw: DataFrame, hosts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """NORM-13: events and ``parse_error`` of records of any known format.

    The sniffed records are written once, in a folder for each format, so that
    every normaliser reads its own records only.
    """
    spark = raw.sparkSession
    path = shared_path(spark, "sniffed")
    rows = prepared(raw, hosts).withColumn("log_format", F.coalesce("log_format", F.lit("none")))
    rows.write.partitionBy("log_format").parquet(path)
    again = spark.read.schema(rows.schema).parquet(path)
    parts = []
    for name, (_, normaliser) in NORMALIZERS.items():
        mine = again.where(F.col("log_format") == name)
        out = dns(mine, known) if name == "zeek_dns" else normaliser(mine)
        parts.append(out)
    nothing = again.where(F.col("log_format") == "none")
    parts.append(_event(nothing, F.lit("unable to detect the log format"), event_id=_minted("bad"), timestamp=F.lit(None).cast("timestamp")))
    return reduce(DataFrame.unionByName, parts)


def split_quarantine(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-4: usable events, and the rest as (source_log, raw, parse_error)."""
    good = normalised.where(F.col("parse_error").isNull()).drop("parse_error")
    return good, normalised.where(F.col("parse_error").isNotNull()).select("source_log", "raw", "parse_error")
