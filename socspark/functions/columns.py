"""Column builders over normalised events and raw fields."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from socspark.plans.schemas import NOTABLE_ACTIONS, SEVERITIES

# Fragments that mark a process, command or domain.
CREDENTIAL_TOOLS = ("mimikatz.exe", "procdump.exe", "lsass", "secretsdump.py", "ntdsutil.exe", "vaultcmd.exe", "reg.exe save")
REMOTE_EXEC_TOOLS = ("psexec.exe", "psexesvc.exe", "wmic.exe", "winrs.exe", "paexec.exe")
SCRIPT_INTERPRETERS = ("powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "cmd.exe")
OFFICE_PROCESSES = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe")
ATTACHMENT_EXTENSIONS = (".docm", ".xlsm", ".js", ".vbs", ".hta", ".lnk", ".iso", ".scr")
COMMAND_FRAGMENTS = ("-enc", "-encodedcommand", "-nop", "-w hidden", "-windowstyle hidden", "frombase64string", "downloadstring", "invoke-expression", "iex ", "bypass", "-noni")
DISCOVERY_COMMANDS = ("whoami /all", "whoami /groups", "net group", "net localgroup", "net view", "net user", "nltest", "dsquery", "quser", "systeminfo")
SUSPICIOUS_TLDS = (".xyz", ".top", ".tk", ".click", ".rest", ".zip", ".cc", ".su")
DENIED_DOMAINS = ("update-svc-cdn.xyz", "cdn-telemetry-sync.top", "mail-secure-login.click")
INTERNAL_SUFFIXES = (".corp.local", ".internal", "in-addr.arpa")
SYSTEM_USERS = ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS LOGON")

IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
_GROUP, _TAIL = "[0-9A-Fa-f]{1,4}", IPV4[1:-1]


def _ipv6_pattern() -> str:
    """Eight groups, the last two maybe as an IPv4 address, or fewer around one ``::``."""
    def end(n: int) -> str:
        """Up to ``n`` groups, an IPv4 address standing for two."""
        groups = f"(?:{_GROUP}:){{0,{n - 1}}}{_GROUP}" if n else ""
        dotted = f"(?:{_GROUP}:){{0,{n - 2}}}{_TAIL}" if n >= 2 else ""
        return "(?:" + "|".join(x for x in (groups, dotted) if x) + ")?" if n else ""

    whole = f"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_TAIL}"
    short = "|".join((f"(?:{_GROUP}:){{{left - 1}}}{_GROUP}" if left else "") + "::" + end(7 - left) for left in range(8))
    return f"^(?:{whole}|{short})(?:%[0-9A-Za-z]+)?$"


IPV6 = _ipv6_pattern()


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """False for a null text."""
    return F.coalesce(any_of(text.contains(p) for p in parts), F.lit(False))


def present(value: Column) -> Column:
    """Null for an empty text or a dash."""
    return F.when(~value.isin("", "-"), value)


def first_present(raw: Column, *names: str) -> Column:
    """The first named field of JSON text that is neither null, empty nor a dash; names match in the given or the lower case."""
    return F.coalesce(*[present(F.get_json_object(raw, f"$['{n}']")) for name in names for n in dict.fromkeys((name, name.lower()))])


def parse_ts(value: Column) -> Column:
    """Seconds since 1970 or ISO text to a timestamp; text without a zone is UTC; anything else is null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[0-9]{1,11}(\.[0-9]+)?$|^[0-9]\.[0-9]+[eE]\+?(10|[0-9])$"), F.timestamp_micros(F.round(text.try_cast("double") * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(text))


def is_ip(value: Column) -> Column:
    return value.rlike(IPV4) | value.rlike(IPV6)


def clean_ip(value: Column) -> Column:
    text = F.trim(value)
    return F.when(is_ip(text), text)


def clean_host(value: Column) -> Column:
    """First label in upper case; null for addresses and placeholders."""
    text = F.regexp_replace(F.trim(value), r"\$+$", "")
    return F.when(~text.isin("", "-") & ~is_ip(text), F.upper(F.substring_index(text, ".", 1)))


def clean_user(value: Column) -> Column:
    """Account without domain, in lower case; null for machine and system accounts."""
    text = F.trim(value)
    name = F.element_at(F.split(text, r"\\"), -1)
    return F.when(~text.isin("", "-") & ~text.endswith("$") & ~F.upper(text).isin(*SYSTEM_USERS), F.lower(F.substring_index(name, "@", 1)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(present(path), F.lit("/"), F.lit("\\")), r"\\"), -1)


def is_internal_domain(domain: Column) -> Column:
    low = F.regexp_replace(F.lower(domain), r"\.+$", "")
    return low.endswith(".in-addr.arpa") | low.endswith(".ip6.arpa") | ~low.contains(".") | contains_any(low, INTERNAL_SUFFIXES)


def looks_like_dga(domain: Column) -> Column:
    label = F.lower(F.substring_index(domain, ".", 1))
    digits = F.length(F.regexp_replace(label, "[^0-9]", ""))
    vowels = F.length(F.regexp_replace(label, "[^aeiou]", ""))
    return label.rlike("^[a-z0-9]{12,}$") & ((digits >= 2) | (vowels <= F.floor(F.length(label) / 6)))


def findings(*pairs: tuple[Column, Column]) -> Column:
    """Texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, text) for condition, text in pairs]))


def domain_findings(domain: Column) -> Column:
    low = F.lower(domain)
    outside = ~is_internal_domain(low)
    return findings(
        (outside & low.isin(*DENIED_DOMAINS), F.concat(domain, F.lit(" is on the threat-intel deny list"))),
        (outside & any_of(low.endswith(t) for t in SUSPICIOUS_TLDS), F.concat(domain, F.lit(" uses a TLD associated with commodity C2"))),
        (outside & looks_like_dga(low), F.concat(domain, F.lit(" has a high-entropy label consistent with DGA"))),
    )


def _blob(process: Column, command: Column) -> Column:
    return F.concat(F.lower(F.coalesce(process, F.lit(""))), F.lit(" "), F.lower(F.coalesce(command, F.lit(""))))


def is_credential_activity(process: Column, command: Column) -> Column:
    return contains_any(_blob(process, command), CREDENTIAL_TOOLS)


def is_remote_exec(process: Column, command: Column) -> Column:
    return contains_any(_blob(process, command), REMOTE_EXEC_TOOLS)


def process_findings(process: Column, command: Column, parent: Column) -> Column:
    proc, cmd, par = (F.lower(F.coalesce(x, F.lit(""))) for x in (process, command, parent))
    return findings(
        (is_credential_activity(process, command), F.lit("Command touches LSASS or a known credential-dumping tool")),
        (is_remote_exec(process, command), F.lit("Remote-execution utility invoked")),
        (contains_any(cmd, COMMAND_FRAGMENTS), F.lit("Command line contains obfuscation or remote-download flags")),
        (contains_any(par, OFFICE_PROCESSES) & contains_any(proc, SCRIPT_INTERPRETERS), F.concat(F.lit("Office process "), parent, F.lit(" spawned interpreter "), process)),
        (any_of(proc.endswith(e) for e in ATTACHMENT_EXTENSIONS), F.lit("Executed file uses an extension common to malicious attachments")),
        (contains_any(cmd, ATTACHMENT_EXTENSIONS), F.lit("Command line references a suspicious attachment file")),
    )


def discovery_findings(command: Column) -> Column:
    cmd = F.lower(F.coalesce(command, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(cmd.contains(c), F.lit(c)) for c in DISCOVERY_COMMANDS]))
    return F.when(F.size(hits) > 0, F.array(F.concat(F.lit("Enumeration command executed: "), F.array_join(hits, ", ")))).otherwise(F.array().cast("array<string>"))


def domain_suffixes(domain: Column) -> Column:
    """The domain and each parent of two labels or more, longest first."""
    labels = F.split(F.regexp_replace(F.lower(domain), r"\.+$", ""), r"\.")
    return F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def base_domain(domain: Column) -> Column:
    return F.substring_index(domain, ".", -2)


def hex_decode(value: Column) -> Column:
    """Text of an even run of four hex digits or more; anything else as it is."""
    return F.when(value.rlike("^(?:[0-9A-Fa-f]{2}){2,}$"), F.replace(F.try_validate_utf8(F.unhex(value).cast("string")), F.lit("\x00"), F.lit(" "))).otherwise(value)


def cef_escape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"([\\|=])", r"\\$1"), r"[\r\n]+", " ")


def cef_unescape(value: Column) -> Column:
    return F.trim(F.replace(F.replace(value, F.lit("\\="), F.lit("=")), F.lit("\\\\"), F.lit("\\")))


def classify_indicator(value: Column) -> Column:
    text = F.trim(value)
    return (
        F.when(F.lower(text).rlike("^https?://"), F.lit("url"))
        .when(is_ip(text), F.lit("ip"))
        .when(text.rlike("^(?:[A-Fa-f0-9]{32}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64})$"), F.lit("hash"))
        .when(text.rlike(r"^(?:[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?\.)+[A-Za-z]{2,}$"), F.lit("domain"))
    )


def format_delta(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def normalize_command(command: Column, process: Column) -> Column:
    text = F.coalesce(F.nullif(command, F.lit("")), process, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def indicator_of() -> Column:
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.lower(F.coalesce(empty("process"), empty("domain"), empty("file_name"), F.lit("")))


def extract_findings(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: t.startswith("finding:")), lambda t: F.substring(t, F.lit(9), F.length(t)))


def severity_rank(severity: Column) -> Column:
    """0 to 4; null for an unknown severity."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1, F.lit(-1)).cast("int")


def raise_severity(severity: Column, least: str) -> Column:
    return F.when(severity_rank(severity) < SEVERITIES.index(least), F.lit(least)).otherwise(severity)


def confidence_from_score(score: Column) -> Column:
    return F.when(score >= 0.80, F.lit("high")).when(score >= 0.55, F.lit("medium")).otherwise(F.lit("low"))


def stream_name(raw: Column, fallback: str = "api") -> Column:
    name = F.substring(F.regexp_replace(F.trim(raw), r"[^A-Za-z0-9_.:-]+", "-"), 1, 48)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def primary_host() -> Column:
    return F.coalesce(F.nullif(F.col("destination_host"), F.lit("")), F.nullif(F.col("source_host"), F.lit("")))


def is_notable() -> Column:
    return F.col("suppressed").isNull() & (F.coalesce("suspicious", F.lit(False)) | F.coalesce(F.col("action").isin(*NOTABLE_ACTIONS), F.lit(False)) | F.coalesce(severity_rank(F.col("severity")) >= 2, F.lit(False)))


def entity_set(*names: str) -> Column:
    """Distinct values of the named columns that are neither null nor empty."""
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(n), F.lit("")) for n in names])))


def hosts() -> Column:
    return entity_set("source_host", "destination_host")


def ips() -> Column:
    return entity_set("source_ip", "destination_ip")


def micros() -> Column:
    return F.unix_micros(F.col("timestamp").cast("timestamp"))


def ipv4_number(ip: Column) -> Column:
    parts = F.transform(F.split(F.when(ip.rlike(IPV4), ip), r"\."), lambda x: x.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)


def ipv6_hex(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, null for anything else; their order is that of the addresses."""
    text = F.lower(F.substring_index(F.when(ip.rlike(IPV6), ip), "%", 1))
    last = F.substring_index(text, ":", -1)
    dotted = F.lpad(F.hex(ipv4_number(last)), 8, "0")
    text = F.when(F.contains(last, F.lit(".")), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(last)), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))).otherwise(text)
    halves = F.split(text, "::", -1)
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    return F.when(text.isNotNull(), F.lower(F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")))


def ip_in_cidr(ip: Column, network: str) -> Column:
    """Whether an address lies in an IPv4 or IPv6 network; false for anything else."""
    net = ipaddress.ip_network(network, strict=False)
    first, last = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return F.coalesce(ipv4_number(ip).between(first, last), F.lit(False))
    return F.coalesce(ipv6_hex(ip).between(f"{first:032x}", f"{last:032x}"), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    # Private, loopback and link-local networks.
    nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8")
    ends = [(int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, nets)]
    # Inside a function of an array, so that the number is worked out once and not for each network.
    return F.exists(F.array(F.coalesce(ipv4_number(ip), F.lit(-1).cast("long"))), lambda number: any_of(number.between(*e) for e in ends))


def event_summary() -> Column:
    """One line about an event."""
    text = lambda c, other="unknown": F.coalesce(F.col(c), F.lit(other))
    return (
        F.when(F.col("event_type") == "authentication", F.concat(F.col("action"), F.lit(" by "), text("user"), F.lit(" from "), text("source_host"), F.lit(" to "), text("destination_host")))
        .when(F.col("event_type") == "dns", F.concat(text("source_host"), F.lit(" resolved "), text("domain")))
        .otherwise(F.concat(F.coalesce("process", "action"), F.lit(" on "), F.coalesce(primary_host(), F.lit("unknown"))))
    )
