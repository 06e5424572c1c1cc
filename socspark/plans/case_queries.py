"""Queries of next targets, case checks, derived tables, sinks and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators import cases, chains, correlate, graph, predict, techniques
from socspark.plans.queries import EV, HOSTS, PAIRS, PRIMARY, RANK, TECHNIQUES, query, security_events, table
from socspark.plans.storage import shared_path, stored
from socspark.sources import sinks

NUMBER = "CAST(substr(event_id, 4) AS BIGINT)"
ORDER = f"(epoch_us(timestamp)::HUGEINT * 1000000000 + {NUMBER}::HUGEINT)"
#: An account's events of one day stand for a chain; command lines name hosts.
DAYS = f"""c AS (SELECT ev.* REPLACE (command_line || ' on host-' || right(event_id, 2) AS command_line), user || '/' || strftime(timestamp, '%Y-%m-%d') AS ck FROM ev WHERE user IS NOT NULL),
at_ AS (SELECT ck, any_value(user) AS user, arg_max({PRIMARY}, {ORDER}) AS cur, count(*) AS n FROM c GROUP BY ck),
rc AS (SELECT DISTINCT ck, h FROM (SELECT ck, source_host AS h FROM c WHERE event_type = 'authentication' UNION ALL SELECT ck, destination_host FROM c WHERE event_type = 'authentication' AND outcome <> 'failure' UNION ALL SELECT ck, {PRIMARY} FROM c WHERE event_type <> 'authentication') WHERE h IS NOT NULL)"""


def day_rows(events: DataFrame) -> DataFrame:
    rows = events.where("user IS NOT NULL").withColumn("command_line", F.concat("command_line", F.lit(" on host-"), F.expr("right(event_id, 2)")))
    return rows.withColumns({"chain_key": F.concat_ws("/", "user", F.date_format("timestamp", "yyyy-MM-dd")), "_primary": C.primary_host(), "_order": F.struct(C.micros().alias("t"), "event_id")})


def day_chains(rows: DataFrame) -> DataFrame:
    base = rows.groupBy("chain_key").agg(F.collect_set("user").alias("users"), F.max_by("_primary", "_order").alias("current_host"), F.count(F.lit(1)).alias("event_count"))
    return base.join(chains.reached_and_targeted(rows), "chain_key")


def inventory(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hosts, accounts and extra links named after the nations."""
    nations = table(spark, sf_dir, "nation")
    host = lambda n: F.concat(F.lit("HOST-"), n.cast("string"))
    key, share = F.col("n_nationkey"), F.col("n_regionkey") / 4
    hosts = nations.select(host(key).alias("name"), share.alias("criticality"))
    users = nations.select(F.concat(F.lit("user"), key.cast("string")).alias("name"), share.alias("privilege"), (F.col("n_regionkey") >= 3).alias("is_privileged"), F.array(host(key), host(key * 3 % 25)).alias("accessible_hosts"))
    links = nations.select(F.concat(F.lit("host:"), host(key)).alias("src"), F.concat(F.lit("host:"), host((key * 5 + 11) % 25)).alias("dst"), F.lit("CONNECTED_TO").alias("kind"), F.lit(1).cast("bigint").alias("weight"))
    return hosts, users, links


TARGETS = f"""hosts AS (SELECT 'HOST-' || n_nationkey AS h, n_regionkey / 4 AS crit FROM nation),
us AS (SELECT 'user' || n_nationkey AS user, n_regionkey / 4 AS priv, n_regionkey >= 3 AS p, unnest(['HOST-' || n_nationkey, 'HOST-' || (n_nationkey * 3 % 25)]) AS h FROM nation),
pr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT source_host AS a, destination_host AS b FROM ev WHERE event_type = 'authentication' UNION ALL SELECT 'HOST-' || n_nationkey, 'HOST-' || ((n_nationkey * 5 + 11) % 25) FROM nation) WHERE a <> b),
bo AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr), dg AS (SELECT x AS h, count(*) AS d FROM bo GROUP BY x), cn AS (SELECT h, round(d / (SELECT max(d) FROM dg), 6) AS share FROM dg),
w AS (SELECT DISTINCT cur AS start, cur AS id, 0 AS hops FROM at_ UNION SELECT start, y, hops + 1 FROM w JOIN bo ON x = id WHERE hops < 20), hp AS (SELECT start, id, min(hops) AS hops FROM w GROUP BY ALL),
ob AS (SELECT user, destination_host AS h, count(*) AS n FROM ev WHERE event_type = 'authentication' AND outcome <> 'failure' AND user IS NOT NULL AND destination_host <> source_host GROUP BY ALL),
ac AS (SELECT ck, us.h FROM at_ JOIN us USING (user) UNION SELECT ck, ob.h FROM at_ JOIN ob USING (user) WHERE user NOT IN (SELECT user FROM us)),
tc AS (SELECT ck, h, max(t) AS t FROM (SELECT ck, destination_host AS h, 1.0 AS t FROM c WHERE event_type = 'authentication' UNION ALL SELECT ck, hosts.h, 0.6 FROM c JOIN hosts ON contains(upper(c.command_line), hosts.h)) GROUP BY ALL),
f AS (SELECT at_.ck, hosts.h, CASE WHEN ac.h IS NULL THEN 0 ELSE 3000 END AS access, coalesce((SELECT round(2500 * max(priv)) FROM us WHERE us.h = hosts.h AND p), 0) AS privilege, coalesce(round(2000 * share), 0) AS connectivity, round(2000 * crit) AS criticality, coalesce(round(1500 * t), 0) AS recent, coalesce(round(2000 / greatest(hops, 1)), 0) AS proximity
  FROM at_ CROSS JOIN hosts LEFT JOIN ac ON ac.ck = at_.ck AND ac.h = hosts.h LEFT JOIN cn ON cn.h = hosts.h LEFT JOIN tc ON tc.ck = at_.ck AND tc.h = hosts.h LEFT JOIN hp ON hp.start = at_.cur AND hp.id = hosts.h LEFT JOIN rc ON rc.ck = at_.ck AND rc.h = hosts.h WHERE rc.h IS NULL),
sc AS (SELECT *, CAST(access + privilege + connectivity + criticality + recent + proximity AS BIGINT) AS raw FROM f), tg AS (SELECT *, least(100.0, ((2 * raw + 14) // 28) / 10) AS score FROM sc WHERE raw > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY score DESC, h) AS k FROM tg) WHERE k <= 4)"""


def _targets(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = stored(security_events(spark, sf_dir), "events")
    rows = stored(day_rows(events), "day-rows")
    days = stored(day_chains(rows), "day-chains")
    hosts, users, links = inventory(spark, sf_dir)
    edges = graph.entity_edges(events).unionByName(links)
    projection = stored(graph.host_projection(edges, hosts.select(F.concat(F.lit("host:"), "name").alias("id"))), "projection")
    return events, days, predict.score_targets(rows, days, hosts, users, projection, predict.observed_access(events))


@query(f"WITH RECURSIVE {EV}, {DAYS}, {TARGETS} SELECT ck AS chain_key, k AS rank, h AS host, access / 100 AS access, privilege / 100 AS privilege, connectivity / 100 AS connectivity, criticality / 100 AS criticality, recent / 100 AS recent, proximity / 100 AS proximity, raw / 100 AS raw_score, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS confidence FROM best")
def next_targets(spark, sf_dir):
    return _targets(spark, sf_dir)[2]


@query(
    f"""WITH RECURSIVE {EV}, {DAYS}, {TARGETS}, st AS (SELECT unnest({HOSTS}) AS host, CASE WHEN suspicious THEN 1 ELSE 0 END AS s, CAST(NULL AS DOUBLE) AS score FROM ev UNION ALL SELECT h, 3, NULL FROM rc UNION ALL SELECT cur, 4, NULL FROM at_ UNION ALL SELECT h, 2, score FROM best)
SELECT host, ['normal', 'suspicious', 'potential_target', 'compromised', 'current_position'][max(s) + 1] AS state, max(score) AS score FROM st GROUP BY host"""
)
def host_states(spark, sf_dir):
    events, days, targets = _targets(spark, sf_dir)
    return predict.host_state(events, days, targets)


@query(f"WITH {EV} SELECT user, destination_host AS host, count(*) AS n FROM ev WHERE event_type = 'authentication' AND outcome <> 'failure' AND user IS NOT NULL AND destination_host <> source_host GROUP BY ALL")
def observed_access(spark, sf_dir):
    return predict.observed_access(security_events(spark, sf_dir))


@query(
    f"""WITH {EV}, {DAYS}, z AS (SELECT * REPLACE (CASE WHEN severity = 'high' AND action = 'RDP_LOGIN' THEN 'critical' ELSE severity END AS severity, CASE action WHEN 'PRIVILEGED_LOGIN' THEN 'REMOTE_SERVICE_EXEC' ELSE action END AS action), {HOSTS} AS hs FROM c),
x AS (SELECT ck, count(*) FILTER (WHERE suspicious) AS flagged, coalesce(string_agg(DISTINCT action, ',' ORDER BY action) FILTER (WHERE suspicious AND action IN ('CREDENTIAL_ACCESS', 'MALICIOUS_ATTACHMENT', 'SUSPICIOUS_DOMAIN', 'REMOTE_SERVICE_EXEC')), '') AS escalating, bool_or(suspicious AND severity = 'critical') AS critical FROM z GROUP BY ck),
m AS (SELECT ck, count(DISTINCT h) > 1 AS several FROM (SELECT ck, unnest(hs) AS h FROM z WHERE suspicious) GROUP BY ck)
SELECT ck AS chain_key, flagged, escalating, critical, coalesce(several, false) AS multi_host, true AS single_account, CASE WHEN critical AND several THEN 'critical' WHEN critical OR (escalating <> '' AND several) THEN 'high' WHEN escalating <> '' THEN 'medium' ELSE 'low' END AS severity, escalating <> '' OR critical AS open_case FROM x LEFT JOIN m USING (ck)"""
)
def triage_chains(spark, sf_dir):
    rows = day_rows(security_events(spark, sf_dir))
    rows = rows.withColumns({"severity": F.when((F.col("severity") == "high") & (F.col("action") == "RDP_LOGIN"), "critical").otherwise(F.col("severity")), "action": F.when(F.col("action") == "PRIVILEGED_LOGIN", "REMOTE_SERVICE_EXEC").otherwise(F.col("action"))})
    return cases.triage_chains(rows).withColumn("escalating", F.array_join("escalating", ","))


@query(f"WITH {EV}, {TECHNIQUES}, x AS (SELECT *, CASE confidence WHEN 'high' THEN 0.9 ELSE 0.65 END AS w FROM tq) SELECT technique, arg_min(tactic, (1 - w) * 1e12 + {NUMBER}) AS tactic, arg_min(event_id, (1 - w) * 1e12 + {NUMBER}) AS event_id, arg_min(confidence, (1 - w) * 1e12 + {NUMBER}) AS confidence, count(*) AS mappings, round(avg(w), 4) AS mean_weight FROM x GROUP BY technique")
def technique_best(spark, sf_dir):
    return cases.technique_best(techniques.map_techniques(security_events(spark, sf_dir)))


@query()
def factor_counts(spark, sf_dir):
    return correlate.factor_totals(security_events(spark, sf_dir))


@query(f"WITH {EV}, {PAIRS} SELECT source_event_id, target_event_id, round(raw, 4) AS score FROM links ORDER BY score DESC, source_event_id, target_event_id LIMIT 50")
def top_links(spark, sf_dir):
    return cases.top_links(correlate.correlate_pairs(security_events(spark, sf_dir)), 50).select("source_event_id", "target_event_id", "score")


@query(f"WITH {EV} SELECT event_id, epoch_us(timestamp) AS us, user, process, parent_process, command_line FROM ev WHERE event_type = 'endpoint' AND {PRIMARY} = 'HOST-3'")
def process_listing(spark, sf_dir):
    return cases.process_listing(security_events(spark, sf_dir), "host-3")


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS t, role AS h, lag(length(text)) OVER w AS pt, lag(role) OVER w AS ph FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT CAST(conv_id AS VARCHAR) AS chain_key, count(*) AS stages, count(*) FILTER (WHERE t < pt) AS out_of_order, coalesce(string_agg(ph || ' -> ' || h, ',' ORDER BY turn) FILTER (WHERE h <> ph), '') AS crossings FROM s GROUP BY conv_id""")
def stage_checks(spark, sf_dir):
    """Turns stand for stages, roles for hosts and lengths for times."""
    stages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("chain_key"), F.col("turn").alias("stage"), F.length("text").alias("first_us"), F.col("role").alias("host"))
    return cases.stage_checks(stages).withColumn("crossings", F.array_join("crossings", ","))


@query(f"WITH {EV} SELECT event_type AS source_log, count(*) FILTER (WHERE NOT suspicious) AS accepted, CAST(sum(CASE WHEN suspicious THEN 2 ELSE 1 END) AS BIGINT) AS duplicates, max(epoch_us(timestamp)) AS last_us FROM ev GROUP BY event_type")
def source_status(spark, sf_dir):
    events = security_events(spark, sf_dir).withColumn("source_log", F.col("event_type"))
    return cases.stream_status(events.unionByName(events), events.where("suspicious"))


@query(f"WITH {EV} SELECT DISTINCT regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) AS domain FROM ev WHERE domain IS NOT NULL AND timestamp < TIMESTAMP '2024-01-10'")
def known_domains(spark, sf_dir):
    return cases.derive_known_domains(security_events(spark, sf_dir), "2024-01-10")


@query(
    f"""WITH {EV}, a AS (SELECT destination_host AS host, destination_ip AS ip, count(*) AS n FROM ev WHERE destination_ip IS NOT NULL AND destination_host <> 'HOST-4' GROUP BY ALL), b AS (SELECT source_host AS host, source_ip AS ip, count(*) AS n FROM ev GROUP BY ALL),
r AS (SELECT *, 'dns' AS basis FROM a UNION ALL SELECT *, 'reported' FROM b WHERE host NOT IN (SELECT host FROM a)) SELECT host, ip, basis FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, ip) AS k FROM r) WHERE k = 1"""
)
def ip_of_hosts(spark, sf_dir):
    events = security_events(spark, sf_dir)
    answers = events.where("destination_host <> 'HOST-4'").select(F.col("destination_host").alias("host"), F.col("destination_ip").alias("ip"))
    return cases.derive_ip_host(answers, events)


@query(f"WITH {EV} SELECT 'events' AS source_log, action, count(*) FILTER (WHERE {RANK} >= 2) AS kept, count(*) FILTER (WHERE {RANK} < 2) AS dropped FROM ev GROUP BY action")
def selection_manifest(spark, sf_dir):
    return cases.selection_manifest(security_events(spark, sf_dir), C.severity_rank(F.col("severity")) >= 2)


@query("SELECT event_type AS source_log, 'k' AS field, count(*) AS rows, count(*) AS filled, count(DISTINCT regexp_extract(props, '([0-9]+)', 1)) AS n_distinct FROM events GROUP BY event_type")
def profile_fields(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_log"), F.col("props").alias("raw"))
    return cases.profile_fields(raw)


def export_rows(events: DataFrame) -> DataFrame:
    """Search-export rows with times in one of two fields, codes that may be missing and lists; some stand without a wrapper, some are cut off."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    lookup = F.col("event_type") == "dns"
    inner = F.struct(
        F.when(~lookup, stamp).alias("_time"),
        F.when(lookup, stamp).alias("UtcTime"),
        F.when(F.col("user").isNotNull(), F.col("source_host")).alias("host"),
        F.when(F.col("action") == "LOGIN_FAILURE", "4625").when(F.col("action") == "RDP_LOGIN", "4624").alias("EventCode"),
        F.array(F.coalesce("process", F.lit("none")), F.lit("other")).alias("Process"),
    )
    text = F.when(F.col("event_type") == "endpoint", F.to_json(inner)).otherwise(F.to_json(F.struct(inner.alias("result"))))
    return events.select(F.col("event_type").alias("source_log"), F.when(F.col("severity") == "high", F.substring(text, 1, 40)).otherwise(text).alias("raw"))


@query(f"""WITH {EV} SELECT event_type AS source_log, count(*) AS records, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last FROM ev WHERE severity <> 'high' GROUP BY event_type""")
def profile_span(spark, sf_dir):
    return cases.profile_span(export_rows(security_events(spark, sf_dir)))


@query(
    f"""WITH {EV}, r AS (SELECT event_type AS source_log, CASE WHEN user IS NOT NULL THEN source_host ELSE '?' END AS host, CASE action WHEN 'LOGIN_FAILURE' THEN '4625' WHEN 'RDP_LOGIN' THEN '4624' ELSE '-' END AS code, coalesce(process, 'none') AS process FROM ev WHERE severity <> 'high'),
v AS (SELECT source_log, 'host' AS field, host AS value FROM r UNION ALL SELECT source_log, 'EventCode', code FROM r UNION ALL SELECT source_log, 'Process', process FROM r UNION ALL SELECT source_log, 'Absent', 'None' FROM r),
c AS (SELECT source_log, field, value, count(*) AS n FROM v GROUP BY ALL) SELECT source_log, field, row_number() OVER (PARTITION BY source_log, field ORDER BY n DESC, value) AS place, value, n FROM c QUALIFY place <= 5"""
)
def profile_values(spark, sf_dir):
    return cases.profile_values(export_rows(security_events(spark, sf_dir)), ("Process", "Absent"), 5)


@query(
    f"""WITH {EV}, s AS (SELECT event_type AS source_log, count(*) FILTER (WHERE severity <> 'high') AS accepted, CAST(0 AS BIGINT) AS duplicates, max(epoch_us(timestamp)) FILTER (WHERE severity <> 'high') AS last_us,
 count(*) FILTER (WHERE severity = 'high') AS rejected, count(*) FILTER (WHERE severity <> 'high' AND timestamp > TIMESTAMP '2024-01-10' - INTERVAL 60 SECOND AND timestamp <= TIMESTAMP '2024-01-10') AS last_minute FROM ev GROUP BY event_type)
SELECT *, last_us AS last_received_us, epoch_us(TIMESTAMP '2024-01-10') - last_us < 30000000 AS receiving FROM s UNION ALL SELECT 'silent', 0, 0, NULL, count(*), 0, NULL, false FROM ev WHERE severity = 'info' HAVING count(*) > 0"""
)
def source_arrivals(spark, sf_dir):
    """The moment is fixed, and rows arrive at their own time; rows of severity high were rejected, and one source sent nothing else."""
    events = security_events(spark, sf_dir).withColumn("source_log", F.col("event_type"))
    bad = events.where("severity = 'high'").select("source_log").union(events.where("severity = 'info'").select(F.lit("silent")))
    return cases.stream_status(events.where("severity <> 'high'"), None, bad, "timestamp", "2024-01-10")


@query(
    f"""WITH {EV}, x AS (SELECT *, CASE event_type WHEN 'dns' THEN 4003 WHEN 'endpoint' THEN 1007 ELSE CASE action WHEN 'PRIVILEGED_LOGIN' THEN 3003 ELSE 3002 END END AS cu FROM ev)
SELECT event_id, cu AS class_uid, cu * 100 + 1 AS type_uid, epoch_us(timestamp) // 1000 AS ms, {RANK} + 1 AS severity_id, CASE outcome WHEN 'failure' THEN 'Failure' ELSE 'Success' END AS status, CASE event_type WHEN 'authentication' THEN coalesce(user, 'Unknown') END AS account, domain, CASE cu WHEN 3002 THEN destination_ip END AS ip, CASE event_type WHEN 'endpoint' THEN parent_process END AS parent,
 CASE cu WHEN 3002 THEN CASE logon_type WHEN 'Interactive' THEN 2 WHEN 'Network' THEN 3 ELSE 10 END ELSE 0 END AS logon_type_id FROM x"""
)
def ocsf_export(spark, sf_dir):
    at = lambda p, kind="string": F.get_json_object("ocsf", f"$.{p}").cast(kind)
    out = sinks.to_ocsf(security_events(spark, sf_dir))
    return out.select("event_id", at("class_uid", "int").alias("class_uid"), at("type_uid", "int").alias("type_uid"), at("time", "bigint").alias("ms"), at("severity_id", "int").alias("severity_id"), at("status").alias("status"), F.coalesce(at("user.name"), at("user.type")).alias("account"), at("query.hostname").alias("domain"), at("dst_endpoint.ip").alias("ip"), at("process.parent_process.name").alias("parent"), F.coalesce(at("logon_type_id", "int"), F.lit(0)).alias("logon_type_id"))


@query(f"WITH {EV} SELECT event_id, epoch_us(timestamp) AS us, action, user, source_host, destination_host, command_line, domain, severity, suspicious, outcome FROM ev")
def ocsf_round_trip(spark, sf_dir):
    """Written as JSON lines, read back."""
    path = shared_path(spark, "ocsf")
    sinks.export_ocsf_events(security_events(spark, sf_dir), path)
    out = sinks.from_ocsf(spark.read.text(path))
    return out.select("event_id", F.unix_micros("timestamp").alias("us"), "action", "user", "source_host", "destination_host", "command_line", "domain", "severity", "suspicious", "outcome")


@query(f"WITH {EV} SELECT event_id, CASE WHEN suspicious THEN 'high' ELSE severity END AS severity FROM ev")
def upsert_events(spark, sf_dir):
    """A first version of all events, a second of the suspicious ones; the second is written twice."""
    path, events = shared_path(spark, "event-table"), security_events(spark, sf_dir)
    sinks.upsert_events(events, path, 1)
    for _ in range(2):
        sinks.upsert_events(events.where("suspicious").withColumn("severity", F.lit("high")), path, 2)
    return sinks.read_events(spark, path).select("event_id", "severity")


@query()
def chain_alerts(spark, sf_dir):
    built = chains.build_chains(security_events(spark, sf_dir))
    mapped = techniques.map_techniques(built["events"]).join(built["members"], "event_id")
    return sinks.chain_alerts(built["chains"], mapped, built["movements"].join(built["members"], "event_id"))


@query()
def chain_findings(spark, sf_dir):
    built = chains.build_chains(security_events(spark, sf_dir))
    return sinks.chain_findings(built["chains"], built["members"], techniques.map_techniques(built["events"]))


@query(f"WITH {EV}, {DAYS}, o AS (SELECT ck, count(*) AS n, arg_max({PRIMARY}, {ORDER}) AS cur FROM c WHERE NOT suspicious GROUP BY ck) SELECT at_.ck AS chain_key, CASE WHEN o.ck IS NULL THEN 'create' ELSE 'update' END AS change FROM at_ LEFT JOIN o ON o.ck = at_.ck WHERE o.ck IS NULL OR o.n <> at_.n OR o.cur <> at_.cur")
def changed_chains(spark, sf_dir):
    rows = day_rows(security_events(spark, sf_dir))
    facts = lambda d: d.groupBy("chain_key").agg(F.count(F.lit(1)).alias("event_count"), F.max_by("_primary", "_order").alias("current_host"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("current_tactic"), F.lit(50).alias("risk"))
    return sinks.changed_chains(facts(rows), facts(rows.where("NOT suspicious"))).select("chain_key", "change")
