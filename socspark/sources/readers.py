"""Files, envelopes and syslog lines to raw rows (raw, source_log, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from socspark.functions import columns as C

RAW_SCHEMA = "raw string, source_log string, position bigint"
#: Extensions read from a folder of logs.
LOG_FILES = "*.{json,jsonl,ndjson,csv,log}"
# Fields that carry the time of a record.
TIME_FIELDS = ("TimeCreated", "UtcTime", "ts", "timestamp", "@timestamp", "_time")


def _placed(df: DataFrame) -> DataFrame:
    """``position`` orders rows within a read; it is stable as long as the files are."""
    return df.withColumn("position", F.monotonically_increasing_id()).select("raw", "source_log", "position")


def read_csv_logs(spark: SparkSession, path) -> DataFrame:
    """SRC-1: rows of files with a header, every value as text; a quote inside quotes is doubled."""
    df = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return _placed(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw"), F.col("_metadata.file_name").alias("source_log")))


def explode_records(text: Column) -> Column:
    """SRC-6: the objects of ``{"records": [...]}``, of an array, or the one object itself."""
    inside = F.get_json_object(text, "$.records")
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(inside.startswith("["), F.from_json(inside, "array<string>")).otherwise(F.array(text))


def read_json_logs(spark: SparkSession, path, whole: bool = False) -> DataFrame:
    """SRC-2: JSON lines; blank lines and comments go. ``whole`` reads files that hold one array or one object over several lines."""
    lines = spark.read.option("wholetext", whole).text(path)
    kept = lines.select(F.trim("value").alias("value"), F.col("_metadata.file_name").alias("source_log")).where(~F.col("value").rlike(r"^\s*$|^#"))
    return _placed(kept.select(F.explode(explode_records(F.col("value"))).alias("raw"), "source_log"))


def read_log_dir(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: every log file of a folder, by its extension; Spark itself skips names that begin with ``_``."""
    lines = read_json_logs(spark, f"{path.rstrip('/')}/*.{{json,jsonl,ndjson,log}}")
    try:
        return lines.unionByName(read_csv_logs(spark, f"{path.rstrip('/')}/*.csv"))
    except Exception as e:  # no CSV file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return lines


def unwrap_hec(lines: DataFrame) -> DataFrame:
    """SRC-7: (value) of collector envelopes to raw rows. Text events go; the envelope's time counts only where the event has none."""
    event = F.get_json_object("value", "$.event")
    d = lines.withColumns({"_event": event, "_time": F.get_json_object("value", "$.time"), "_source": F.coalesce(C.present(F.get_json_object("value", "$.source")), C.present(F.get_json_object("value", "$.sourcetype")), F.lit("splunk"))})
    d = d.where(F.col("_event").startswith("{")).withColumn("_keys", F.json_object_keys("_event"))
    timed = F.arrays_overlap("_keys", F.array(*map(F.lit, TIME_FIELDS)))
    rest = F.substring("_event", 2, 1_000_000_000)
    stamp = F.to_json(F.struct(F.col("_time").alias("timestamp")))
    opened = F.concat(F.expr("left(_stamp, length(_stamp) - 1)"), F.when(F.size("_keys") > 0, F.lit(",")).otherwise(F.lit("")), rest)
    d = d.withColumn("_stamp", stamp).withColumn("raw", F.when(timed | F.col("_time").isNull(), F.col("_event")).otherwise(opened))
    return _placed(d.withColumn("source_log", C.stream_name(F.concat(F.lit("hec-"), F.col("_source")), "hec")))


def unwrap_search_export(lines: DataFrame, source_log: str = "search") -> DataFrame:
    """SRC-8, SRC-11: export lines ``{"preview", "result"}``; previews go, an embedded JSON record takes the place of its envelope."""
    result = F.get_json_object("value", "$.result")
    inside = F.get_json_object("value", "$.result._raw")
    kept = lines.where(F.coalesce(F.get_json_object("value", "$.preview"), F.lit("false")) != "true").where(result.isNotNull())
    return _placed(kept.select(F.when(inside.rlike(r"^\s*\{"), inside).otherwise(F.to_json(F.struct(F.from_json(result, "map<string,string>").alias("result")))).alias("raw"), F.lit(source_log).alias("source_log")))


def incremental_pull(df: DataFrame, time: str, bookmark, most: int, id_col: str | None = None, last_id=None) -> tuple[DataFrame, DataFrame]:
    """SRC-9: the oldest ``most`` rows after the bookmark, and a frame with the next bookmark.

    With ``id_col`` rows of one time go on in order of their ids, and the next
    bookmark has a ``last_id``, so that a page may end between them.
    """
    after = F.col(time) > F.lit(bookmark)
    if id_col is None:
        page = df.where(after).orderBy(time).limit(most)
        return page, page.agg(F.coalesce(F.max(time), F.lit(bookmark)).alias("bookmark"))
    if last_id is not None:
        after = after | ((F.col(time) == F.lit(bookmark)) & (F.col(id_col) > F.lit(last_id)))
    page = df.where(after).orderBy(time, id_col).limit(most)
    last = page.agg(F.max(F.struct(F.col(time).alias("t"), F.col(id_col).alias("i"))).alias("x"))
    return page, last.select(F.coalesce("x.t", F.lit(bookmark)).alias("bookmark"), F.coalesce("x.i", F.lit(last_id)).alias("last_id"))


NEW_SYSLOG = r"^<\d{1,3}>1 (\S+) (\S+) (\S+) \S+ \S+ (?:-|(?:\[[^\]]*\])+) ?(.*)$"
OLD_SYSLOG = r"^<\d{1,3}>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[\d+\])?: ?(.*)$"
SSH = r"(?:(Accepted) \S+ for|(?:Failed) \S+ for (?:invalid user )?|Invalid user) ?(\S+) from ([\d.:a-fA-F]+)"
SUDO = r"^\s*(\S+) : .*?USER=\S+ ; COMMAND=(.+)$"


def parse_syslog(lines: DataFrame, year: int, source_log: str = "syslog") -> DataFrame:
    """SRC-10: (value) lines of sshd and sudo to raw rows; others go. ``year`` completes the old format, which names none and is taken as UTC."""
    text = F.trim("value")
    new = text.rlike(NEW_SYSLOG)
    part = lambda i: F.when(new, F.regexp_extract(text, NEW_SYSLOG, i)).otherwise(F.regexp_extract(text, OLD_SYSLOG, i))
    old_time = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(part(1), " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    d = lines.where(new | text.rlike(OLD_SYSLOG)).withColumns({"_t": F.when(new, F.try_to_timestamp(part(1))).otherwise(old_time), "_h": F.upper(F.substring_index(part(2), ".", 1)), "_a": F.lower(part(3)), "_m": part(4)})
    d = d.where(F.col("_t").isNotNull()).withColumn("_s", F.date_format("_t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    word = lambda i: F.regexp_extract("_m", SSH, i)
    named = lambda c, n: F.struct(c.alias(n))
    outcome = F.when(word(1) == "Accepted", "success").otherwise("failure")
    logon = F.to_json(
        F.struct(
            F.col("_s").alias("@timestamp"),
            F.struct(F.array(F.lit("authentication")).alias("category"), outcome.alias("outcome")).alias("event"),
            named(word(2), "name").alias("user"),
            named(word(3), "ip").alias("source"),
            named(F.col("_h"), "name").alias("host"),
            named(F.lit("sshd"), "name").alias("process"),
            named(text, "message").alias("syslog"),
        )
    )
    command = F.trim(F.regexp_extract("_m", SUDO, 2))
    run = F.to_json(
        F.struct(
            F.lit("1").alias("EventID"),
            F.col("_s").alias("UtcTime"),
            F.col("_h").alias("Computer"),
            F.regexp_extract("_m", SUDO, 1).alias("User"),
            F.substring_index(command, " ", 1).alias("Image"),
            command.alias("CommandLine"),
            F.lit("sudo").alias("ParentImage"),
        )
    )
    raw = F.when((F.col("_a") == "sshd") & F.col("_m").rlike(SSH), logon).when((F.col("_a") == "sudo") & F.col("_m").rlike(SUDO), run)
    return _placed(d.select(raw.alias("raw"), F.lit(source_log).alias("source_log")).where(F.col("raw").isNotNull()))


def load_inventory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-12: hosts, users and known domains of an inventory file."""
    schema = "hosts array<struct<name string, ip string, role string, criticality double, is_critical_infrastructure boolean, os string, zone string, owner string, reachable_hosts array<string>>>, users array<struct<name string, display_name string, department string, privilege double, is_privileged boolean, groups array<string>, accessible_hosts array<string>>>, known_domains array<string>"
    whole = spark.read.option("multiLine", True).schema(schema).json(path)
    return {"hosts": whole.select(F.inline("hosts")), "users": whole.select(F.inline("users")), "known_domains": whole.select(F.explode("known_domains").alias("domain"))}


PATTERN_VALUE = r"=\s*'([^']+)'"


def load_intel_lines(lines: DataFrame) -> DataFrame:
    """SRC-13: (value) plain lines to indicators, each with its recognised kind; the smallest description of a value stays."""
    value = F.trim(F.substring_index("value", ",", 1))
    rest = F.when(F.col("value").contains(","), F.trim(F.expr("substring(value, instr(value, ',') + 1)"))).otherwise("")
    d = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select(value.alias("value"), rest.alias("description")).withColumn("kind", C.classify_indicator(F.col("value")))
    return d.where(F.col("kind").isNotNull()).groupBy("kind", F.lower("value").alias("value")).agg(F.min("description").alias("description"))


def load_stix(bundles: DataFrame) -> DataFrame:
    """SRC-13: (value) bundles to indicators; revoked ones go."""
    objects = bundles.select(F.explode(F.from_json(F.get_json_object("value", "$.objects"), "array<string>")).alias("o"))
    at = lambda p: F.get_json_object("o", f"$.{p}")
    live = objects.where((at("type") == "indicator") & (F.coalesce(at("revoked"), F.lit("false")) != "true"))
    values = live.select(F.explode(F.regexp_extract_all(at("pattern"), F.lit(PATTERN_VALUE), F.lit(1))).alias("value"), F.coalesce(at("name"), F.lit("")).alias("description"))
    d = values.withColumn("kind", C.classify_indicator(F.col("value"))).where(F.col("kind").isNotNull())
    return d.groupBy("kind", F.lower("value").alias("value")).agg(F.min("description").alias("description"))
