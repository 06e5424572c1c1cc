"""ATT&CK technique rules (DET-7) and tactics of events (WIN-8, WIN-9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.plans.schemas import TACTIC_ORDER


@dataclass(frozen=True)
class TechniqueRule:
    technique: str
    tactic: str
    confidence: str
    matches: Column


def _tag(name: str) -> Column:
    return F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), name)


def _finding(text: str) -> Column:
    return F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("finding:") & t.contains(text))


def default_rules() -> list[TechniqueRule]:
    """The rules in their fixed order; the first that names a technique counts."""
    action = lambda *names: F.coalesce(F.col("action").isin(*names), F.lit(False))
    cmd = F.lower(F.coalesce("command_line", F.lit("")))
    call = F.coalesce("process", F.lit(""))
    lsass = cmd.contains("lsass") | _finding("lsass") | _finding("LSASS")
    image, target = (F.lower(F.coalesce(F.get_json_object("raw", f"$.{n}"), F.lit(""))) for n in ("Image", "TargetFilename"))
    staged = image.contains("\\temp\\") | (target.contains("\\temp\\") & target.rlike(r"\.(exe|dll|ps1|bat|cmd|vbs|js|hta|scr)$"))
    moved = F.coalesce(F.col("source_host") != F.col("destination_host"), F.lit(False))
    R = TechniqueRule
    return [
        R("T1566.001", "TA0001", "high", action("MALICIOUS_ATTACHMENT") & _tag("file-create")),
        R("T1204.002", "TA0002", "high", action("MALICIOUS_ATTACHMENT") & ~_tag("file-create")),
        R("T1059.001", "TA0002", "high", action("POWERSHELL_EXEC")),
        R("T1027", "TA0005", "medium", C.contains_any(cmd, ("-enc", "-encodedcommand", "hidden", "frombase64string"))),
        R("T1059.003", "TA0002", "medium", action("COMMAND_EXEC") & ~_tag("linux")),
        R("T1033", "TA0007", "medium", cmd.contains("whoami")),
        R("T1069.002", "TA0007", "medium", cmd.contains("net group") | cmd.contains("net localgroup")),
        R("T1003.001", "TA0006", "high", action("CREDENTIAL_ACCESS") & lsass),
        R("T1003.002", "TA0006", "high", action("CREDENTIAL_ACCESS") & (cmd.contains("hklm\\sam") | cmd.contains("reg.exe save"))),
        R("T1110", "TA0006", "medium", action("LOGIN_FAILURE") & _tag("credential-guessing")),
        R("T1021.001", "TA0008", "high", action("RDP_LOGIN") & moved),
        R("T1021.002", "TA0008", "high", action("SMB_AUTH") & _tag("admin-share")),
        R("T1569.002", "TA0002", "high", action("REMOTE_SERVICE_EXEC")),
        R("T1021.002", "TA0008", "high", action("REMOTE_SERVICE_EXEC") & cmd.contains("\\\\")),
        R("T1078", "TA0004", "medium", action("PRIVILEGED_LOGIN")),
        R("T1071.004", "TA0011", "high", action("SUSPICIOUS_DOMAIN")),
        R("T1568.002", "TA0011", "medium", _finding("DGA")),
        R("T1071.001", "TA0011", "medium", _tag("beaconing") & ~action("SUSPICIOUS_DOMAIN")),
        R("T1105", "TA0011", "medium", staged),
        R("T1562.008", "TA0005", "high", action("CLOUD_LOGGING_DISABLED")),
        R("T1098.001", "TA0003", "medium", action("CLOUD_PRIVILEGE_CHANGE") & call.isin("CreateAccessKey", "CreateLoginProfile", "UpdateLoginProfile")),
        R("T1098.003", "TA0004", "medium", action("CLOUD_PRIVILEGE_CHANGE") & call.isin("AttachUserPolicy", "AttachRolePolicy", "AttachGroupPolicy", "PutUserPolicy", "AddUserToGroup")),
        R("T1078.004", "TA0001", "medium", action("LOGIN_SUCCESS") & F.coalesce("suspicious", F.lit(False)) & (_tag("entra") | _tag("cloudtrail"))),
        R("T1059.004", "TA0002", "high", _tag("auditd") & _finding("reverse shell")),
    ]


# Tactics of actions that no rule claims.
FALLBACK_TACTIC = {
    "MALICIOUS_ATTACHMENT": "TA0001",
    "PROCESS_CREATE": "TA0002",
    "SCRIPT_EXEC": "TA0002",
    "SUSPICIOUS_EXECUTABLE": "TA0002",
    "DISCOVERY_COMMAND": "TA0007",
    "CREDENTIAL_ACCESS": "TA0006",
    "LOGIN_FAILURE": "TA0006",
    "RDP_LOGIN": "TA0008",
    "SMB_AUTH": "TA0008",
    "NETWORK_LOGON": "TA0008",
    "REMOTE_SERVICE_EXEC": "TA0008",
    "PRIVILEGED_LOGIN": "TA0004",
    "SUSPICIOUS_DOMAIN": "TA0011",
    "NEWLY_OBSERVED_DOMAIN": "TA0011",
    "HIGH_VOLUME_DNS": "TA0011",
}


def mappings(rules: list[TechniqueRule] | None = None) -> Column:
    """The techniques of an event, each once by its first rule, as (technique, tactic, confidence)."""
    rules = default_rules() if rules is None else rules
    every = F.array_compact(F.array(*[F.when(r.matches, F.struct(F.lit(r.technique).alias("technique"), F.lit(r.tactic).alias("tactic"), F.lit(r.confidence).alias("confidence"))) for r in rules]))
    names = F.transform(every, lambda m: m["technique"])
    return F.filter(every, lambda m, i: F.array_position(names, m["technique"]) == i + 1)


def map_techniques(events: DataFrame, rules: list[TechniqueRule] | None = None) -> DataFrame:
    """One row for each (event, technique); no shuffle."""
    return events.select("event_id", F.explode(mappings(rules)).alias("m")).select("event_id", "m.*")


def event_tactic(maps: Column) -> Column:
    """The tactic of the most confident mapping, the later stage on a tie; else that of the action."""
    order = F.array(*map(F.lit, TACTIC_ORDER))
    ranked = F.transform(maps, lambda m: F.struct(F.when(m["confidence"] == "high", 2).when(m["confidence"] == "medium", 1).otherwise(0).alias("c"), F.array_position(order, m["tactic"]).alias("o"), m["tactic"].alias("t")))
    fallback = F.element_at(F.create_map(*[F.lit(x) for kv in FALLBACK_TACTIC.items() for x in kv]), F.col("action"))
    return F.coalesce(F.array_max(ranked)["t"], fallback, F.lit("TA0002"))
