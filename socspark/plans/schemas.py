"""Row types and code lists."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = "action user source_host destination_host source_ip destination_ip process parent_process command_line domain file_name logon_type outcome severity"

#: One normalised event.
EVENT_SCHEMA = T.StructType(
    [T.StructField("event_id", T.StringType(), False), T.StructField("timestamp", T.TimestampType(), False), T.StructField("event_type", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in _TEXTS.split()]
    + [T.StructField("suspicious", T.BooleanType()), T.StructField("suppressed", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("source_log", T.StringType()), T.StructField("raw", T.StringType())]
)

# The codes of the event format.
EVENT_TYPES = ("authentication", "dns", "endpoint", "network", "cloud")
SEVERITIES = ("info", "low", "medium", "high", "critical")
MOVEMENT_ACTIONS = ("RDP_LOGIN", "SMB_AUTH", "NETWORK_LOGON", "PRIVILEGED_LOGIN", "REMOTE_SERVICE_EXEC")
NOTABLE_ACTIONS = (
    "MALICIOUS_ATTACHMENT",
    "POWERSHELL_EXEC",
    "SCRIPT_EXEC",
    "CREDENTIAL_ACCESS",
    "SUSPICIOUS_EXECUTABLE",
    "DISCOVERY_COMMAND",
    "SUSPICIOUS_DOMAIN",
    "NEWLY_OBSERVED_DOMAIN",
    "HIGH_VOLUME_DNS",
    "RDP_LOGIN",
    "PRIVILEGED_LOGIN",
    "REMOTE_SERVICE_EXEC",
    "CLOUD_PRIVILEGE_CHANGE",
    "CLOUD_LOGGING_DISABLED",
)
#: Kill-chain order of the tactics that rules name.
TACTIC_ORDER = ("TA0001", "TA0002", "TA0003", "TA0004", "TA0005", "TA0006", "TA0007", "TA0008", "TA0009", "TA0011", "TA0010", "TA0040")
# Names of the tactics.
TACTIC_NAMES = {
    "TA0001": "Initial Access",
    "TA0002": "Execution",
    "TA0003": "Persistence",
    "TA0004": "Privilege Escalation",
    "TA0005": "Defense Evasion",
    "TA0006": "Credential Access",
    "TA0007": "Discovery",
    "TA0008": "Lateral Movement",
    "TA0009": "Collection",
    "TA0010": "Exfiltration",
    "TA0011": "Command and Control",
    "TA0040": "Impact",
}
