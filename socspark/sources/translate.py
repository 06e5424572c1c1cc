"""Records of other tools' formats as native records, so that the normalisers of Windows, Sysmon and DNS judge them.

A raw row is (raw, source_log, position), as in `normalize`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socspark.plans.storage import shared_path
from socspark.sources import normalize as N
from socspark.sources.sinks import from_ocsf

# Event classes, source types, and the offset of the export's local clock.
LOGON, PRIVILEGE, LOOKUP, FILE, PROCESS, FINDING = "3002", "3003", "4003", "1001", "1007", "2004"
EXPORT_SECURITY = "WinEventLog:Security"
EXPORT_SYSMON = "XmlWinEventLog:Microsoft-Windows-Sysmon/Operational"
EXPORT_DNS = "stream:dns"
EXPORT_OFFSET_HOURS = 6

#: The formats that records are translated to.
FORMATS = ("windows_security", "zeek_dns", "sysmon")


def _record(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k.replace("__", ".")) for k, v in fields.items()]))


def _normalised(rows: DataFrame, native: Column, log_format: Column, refused: Column, hosts: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """Events of ``native`` texts by the normalisers of their formats, their ``raw`` the original; where the format is null, an error.

    The translated records are written once, with their fields, in a folder for each format, so that a
    normaliser reads its own records only and no plan holds a translation and a normaliser in one.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "translated")
    kind = F.coalesce(log_format, F.lit("none"))
    texts = rows.select(F.when(kind != "none", native).alias("raw"), "source_log", "position", F.col("raw").alias("_original"), F.when(kind == "none", refused).alias("_why"), kind.alias("log_format"))
    written = N.resolve_hosts(N.route_ecs(N.with_fields(texts)), hosts)
    written.write.partitionBy("log_format").parquet(path)
    again = spark.read.schema(written.schema).parquet(path).withColumn("raw", F.col("_original"))
    of = lambda name: again.where(F.col("log_format") == name)
    parts = [N.dns(of(name), known) if name == "zeek_dns" else N.NORMALIZERS[name][1](of(name)) for name in FORMATS]
    parts.append(_refused(of("none"), F.col("_why")))
    return reduce(DataFrame.unionByName, parts)


def _refused(rows: DataFrame, why: Column) -> DataFrame:
    return N._event(rows, why, event_id=N._minted("bad"), timestamp=F.lit(None).cast("timestamp"))


def _value(path: str) -> Column:
    return F.get_json_object("raw", f"$.{path}")


def _program(path: str) -> Column:
    return F.coalesce(_value(f"{path}.file.path"), _value(f"{path}.name"))


def normalize_ocsf(raw: DataFrame, hosts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """NORM-7: events and ``parse_error`` of sign-in, privilege, DNS, process and file objects.

    Objects that this library exported come back as they were; others are
    translated by class. Findings and other classes are errors.
    """
    own = _value("unmapped.event.event_id").isNotNull()
    restored = from_ocsf(raw.where(own).select(F.col("raw").alias("value"))).withColumn("parse_error", F.lit(None).cast("string"))
    rest = raw.where(~own).withColumn("_class", F.coalesce(_value("class_uid"), F.lit("")))
    time = _value("time")
    when = F.when(time.rlike("^[0-9]{1,15}$"), (time.cast("decimal(20,3)") / 1000).cast("decimal(20,3)").cast("string")).otherwise(time)
    host, uid, name = _value("device.hostname"), _value("metadata.uid"), _value("user.name")
    failed = F.coalesce(_value("status_id"), F.lit("1")) == "2"
    logon = _record(
        EventID=F.coalesce(_value("metadata.event_code"), F.when(failed, "4625").otherwise("4624")),
        TimeCreated=when,
        Computer=F.coalesce(_value("dst_endpoint.hostname"), host),
        WorkstationName=_value("src_endpoint.hostname"),
        IpAddress=_value("src_endpoint.ip"),
        DestinationIp=_value("dst_endpoint.ip"),
        TargetUserName=name,
        LogonType=F.nullif(_value("logon_type_id"), F.lit("0")),
        ShareName=_value("unmapped.share_name"),
        RecordId=uid,
    )
    privilege = _record(EventID=F.lit("4672"), TimeCreated=when, Computer=F.coalesce(host, _value("dst_endpoint.hostname")), SubjectUserName=name, TargetUserName=name, RecordId=uid)
    address = _value("src_endpoint.ip")
    lookup = _record(
        ts=when,
        query=_value("query.hostname"),
        qtype_name=_value("query.type"),
        id__orig_h=address,
        id__resp_h=_value("dst_endpoint.ip"),
        host=F.when(address.isNull(), _value("src_endpoint.hostname")),
        process=_value("actor.process.name"),
        uid=uid,
    )
    user = F.coalesce(_value("actor.user.name"), _value("process.user.name"))
    base = {"UtcTime": when, "Computer": host, "User": user, "RecordId": uid}
    opened = _record(EventID=F.lit("10"), **base, SourceImage=_program("actor.process"), Image=_program("actor.process"), TargetImage=_program("process"), GrantedAccess=_value("unmapped.granted_access"), CommandLine=_value("actor.process.cmd_line"))
    dropped = _record(EventID=F.lit("11"), **base, TargetFilename=F.coalesce(_value("file.path"), _value("file.name")), Image=_program("actor.process"), ParentImage=_program("actor.process.parent_process"))
    started = _record(EventID=F.lit("1"), **base, Image=_program("process"), CommandLine=_value("process.cmd_line"), ParentImage=_program("process.parent_process"))
    of = lambda *classes: F.col("_class").isin(*classes)
    native = F.when(of(LOGON), logon).when(of(PRIVILEGE), privilege).when(of(LOOKUP), lookup).when(of(FILE), dropped).when(_value("activity_id") == "3", opened).otherwise(started)
    log_format = F.when(of(LOGON, PRIVILEGE), "windows_security").when(of(LOOKUP), "zeek_dns").when(of(FILE, PROCESS), "sysmon")
    why = F.when(of(FINDING), "a finding is no input event").otherwise(F.concat(F.lit("class "), "_class", F.lit(" is not read")))
    return restored.unionByName(_normalised(rest, native, log_format, why, hosts, known))


def normalize_export(raw: DataFrame, dataset: str, hosts: DataFrame | None = None, known: DataFrame | None = None, offset_hours: int = EXPORT_OFFSET_HOURS) -> DataFrame:
    """NORM-8: events and ``parse_error`` of search-export rows, wrapped in ``result`` or not, by their source type.

    Fields with several values are lists: of accounts the first acts and the
    last is meant, of other fields the first counts. A time in UTC goes before
    the local one, which lies ``offset_hours`` behind. Events carry a tag of the data set.
    """
    inside = F.get_json_object("raw", "$.result")
    rows = raw.withColumns({"_wrapped": F.col("raw"), "raw": F.coalesce(F.when(inside.startswith("{"), inside), F.col("raw"))})
    value = lambda f: F.get_json_object("raw", f"$['{f}']")

    def listed(f: str, at: int) -> Column:
        v = value(f)
        many = F.from_json(v, "array<string>")
        return F.when(v.startswith("["), F.try_element_at(many, F.lit(at))).otherwise(v)

    first, last = (lambda f: listed(f, 1)), (lambda f: listed(f, -1))
    short = lambda v: F.when(~v.isin("", "-", "::1", "127.0.0.1"), F.substring_index(v, ".", 1))
    local = F.try_to_timestamp(F.substring(value("_time"), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")) + F.expr(f"INTERVAL {offset_hours} HOURS")
    stamp = value("timestamp")
    utc = F.coalesce(F.concat(F.replace(value("UtcTime"), F.lit(" "), F.lit("T")), F.lit("Z")), F.when(stamp.endswith("Z"), stamp), F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    uid = lambda kind, host, number: F.concat_ws("-", F.lit(f"{dataset}-{kind}"), F.coalesce(host, F.lit("unknown")), F.coalesce(number, F.lit("")))
    domain, account = last("Account_Domain"), last("Account_Name")
    computer = short(F.coalesce(first("ComputerName"), first("host")))
    security = _record(
        RecordId=uid("sec", computer, value("RecordNumber")),
        EventID=value("EventCode"),
        TimeCreated=utc,
        Computer=computer,
        WorkstationName=short(first("Workstation_Name")),
        TargetUserName=F.when((F.length(account) > 0) & (F.length(domain) > 0) & (domain != "-"), F.concat(domain, F.lit("\\"), account)).otherwise(account),
        SubjectUserName=first("Account_Name"),
        LogonType=value("Logon_Type"),
        IpAddress=first("Source_Network_Address"),
        ShareName=first("Share_Name"),
        ProcessName=first("Process_Name"),
        ServiceFileName=value("Service_File_Name"),
    )
    machine = short(F.coalesce(first("Computer"), first("host")))
    # Field names that a Sysmon row keeps.
    copied = ("User", "Image", "SourceImage", "ParentImage", "CommandLine", "TargetFilename", "TargetImage", "GrantedAccess", "SourceIp", "DestinationIp")
    sysmon = _record(RecordId=uid("sysmon", machine, value("RecordID")), EventID=value("EventCode"), UtcTime=utc, Computer=machine, **{f: value(f) for f in copied})
    lookup = _record(
        uid=F.concat_ws("-", F.lit(f"{dataset}-dns"), utc, F.coalesce(value("src_ip"), F.lit("")), F.coalesce(value("transaction_id"), F.lit(""))),
        ts=utc,
        id__orig_h=value("src_ip"),
        id__resp_h=value("dest_ip"),
        query=F.coalesce(first("query{}"), value("query")),
        qtype_name=first("query_type{}"),
        rcode_name=first("reply_code{}"),
    )
    kind = F.coalesce(value("sourcetype"), F.lit(""))
    typed = rows.withColumn("_kind", kind)
    of = lambda k: F.col("_kind") == k
    native = F.when(of(EXPORT_SECURITY), security).when(of(EXPORT_SYSMON), sysmon).otherwise(lookup)
    log_format = F.when(of(EXPORT_SECURITY), "windows_security").when(of(EXPORT_SYSMON), "sysmon").when(of(EXPORT_DNS), "zeek_dns")
    out = _normalised(typed, native, log_format, F.concat(F.lit("source type "), "_kind", F.lit(" is not read")), hosts, known)
    tag = F.array(F.lit(f"dataset:{dataset}"))
    return out.withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), tag))
