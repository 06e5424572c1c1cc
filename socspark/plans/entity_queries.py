"""Queries of composed detections, single entities, findings, chain texts and data-set filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators import chains, composition, correlate, detect, entities, findings, graph, predict, techniques, views
from socspark.plans import case_queries
from socspark.plans.case_queries import DAYS, NUMBER, ORDER, TARGETS
from socspark.plans.queries import COMPONENTS, EV, HOSTS, INDICATORS, NOTABLE, PAIRS, PRIMARY, RANK, SIGMA_RULES, SQL, TECHNIQUES, query, security_events, table
from socspark.plans.schemas import TACTIC_NAMES, TACTIC_ORDER
from socspark.plans.storage import stored
from socspark.sources import datasets

#: Inventory after the nations, without the first three; accounts of all.
INV = """inv AS (SELECT 'HOST-' || n_nationkey AS h, n_regionkey / 4 AS criticality, CASE WHEN n_regionkey >= 3 THEN 'server' ELSE 'workstation' END AS role FROM nation WHERE n_nationkey > 2),
us AS (SELECT DISTINCT user, h FROM (SELECT 'user' || n_nationkey AS user, unnest(['HOST-' || n_nationkey, 'HOST-' || (n_nationkey * 3 % 25)]) AS h FROM nation))"""
ACCESS = f"""a AS (SELECT user, unnest({HOSTS}) AS h, event_id, epoch_us(timestamp) AS us, NOT (destination_host IS NOT NULL AND outcome = 'failure') AS ok FROM ev WHERE user IS NOT NULL),
g AS (SELECT user, h, bool_or(ok) AS ok, array_to_string(list(event_id ORDER BY us, event_id)[1:5], ',') AS ids FROM a GROUP BY ALL),
acc AS (SELECT us.user, us.h AS host, g.user IS NOT NULL AS activity_seen, coalesce(g.ok, false) AS access_succeeded, coalesce(ids, '') AS event_ids, coalesce(inv.criticality, 0.0) AS criticality FROM us LEFT JOIN g ON g.user = us.user AND g.h = us.h LEFT JOIN inv ON inv.h = us.h)"""


def inventory(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    hosts, users, links = case_queries.inventory(spark, sf_dir)
    hosts = hosts.where("CAST(substring(name, 6) AS INT) > 2").withColumn("role", F.when(F.col("criticality") >= 0.75, "server").otherwise("workstation"))
    return hosts, users, links


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as texts, so that engines can be compared."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query(f"WITH {EV} SELECT event_id, action, domain, CASE WHEN event_type = 'dns' THEN source_host || ' resolved ' || domain WHEN event_type = 'authentication' THEN action || ' by ' || coalesce(user, 'unknown') || ' from ' || source_host || ' to ' || destination_host ELSE process || ' on ' || {PRIMARY} END AS summary, CASE WHEN suspicious THEN 'flagged,twice' ELSE '' END AS findings FROM ev")
def evidence_rows(spark, sf_dir):
    events = security_events(spark, sf_dir).withColumn("tags", F.when(F.col("suspicious"), F.array(F.lit("finding:flagged"), F.lit("beaconing"), F.lit("finding:twice"))))
    return joined(entities.evidence_row(events).select("event_id", "action", "domain", "summary", "findings"), "findings")


@query(
    f"""WITH {EV}, {INV}, e AS (SELECT unnest({HOSTS}) AS h, user, {NOTABLE} AS n FROM ev), g AS (SELECT h, count(*) AS event_count, count(*) FILTER (WHERE n) AS flagged, coalesce(string_agg(DISTINCT user, ',' ORDER BY user), '') AS accounts FROM e GROUP BY h)
SELECT coalesce(inv.h, g.h) AS host, inv.h IS NOT NULL AS known_asset, coalesce(role, 'unknown') AS role, coalesce(criticality, 0.0) AS criticality, coalesce(event_count, 0) AS event_count, coalesce(flagged, 0) AS flagged_event_count, coalesce(accounts, '') AS accounts_seen FROM inv FULL JOIN g ON inv.h = g.h"""
)
def host_profile(spark, sf_dir):
    hosts, _, _ = inventory(spark, sf_dir)
    out = joined(entities.host_profile(security_events(spark, sf_dir), hosts), "accounts_seen")
    return out.select("host", "known_asset", "role", "criticality", "event_count", "flagged_event_count", "accounts_seen")


@query(
    f"""WITH RECURSIVE {EV}, {INV}, {DAYS}, st AS (SELECT unnest({HOSTS}) AS host, CASE WHEN suspicious THEN 1 ELSE 0 END AS s FROM ev UNION ALL SELECT h, 3 FROM rc UNION ALL SELECT cur, 4 FROM at_), x AS (SELECT host, max(s) AS s FROM st GROUP BY host)
SELECT row_number() OVER (ORDER BY coalesce(s, 0) <> 4, coalesce(criticality, 0) DESC, coalesce(x.host, inv.h)) AS place, coalesce(x.host, inv.h) AS host, coalesce(role, 'unknown') AS role FROM x FULL JOIN inv ON inv.h = x.host"""
)
def ordered_hosts(spark, sf_dir):
    from pyspark.sql.window import Window

    events = stored(security_events(spark, sf_dir), "events")
    days = stored(case_queries.day_chains(stored(case_queries.day_rows(events), "day-rows")), "day-chains")
    none = spark.createDataFrame([], "host string, score double")
    views_ = entities.with_host_facts(predict.host_state(events, days, none), inventory(spark, sf_dir)[0])
    ordered = entities.order_hosts(views_).withColumn("_i", F.monotonically_increasing_id())
    return ordered.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_i")).cast("bigint").alias("place"), "host", "role")


@query(
    f"""WITH {EV}, p AS (SELECT 'user' || n_nationkey AS user, n_regionkey / 4 AS privilege, n_regionkey >= 3 AS is_privileged FROM nation), v AS (SELECT user, count(*) AS events FROM ev WHERE user IS NOT NULL GROUP BY user), k AS (SELECT DISTINCT user FROM ev WHERE suspicious AND action = 'RDP_LOGIN' AND user IS NOT NULL)
SELECT coalesce(v.user, p.user) AS user, coalesce(events, 0) AS events, coalesce(privilege, 0.0) AS privilege, coalesce(is_privileged, false) AS is_privileged, k.user IS NOT NULL AS compromised FROM v FULL JOIN p ON p.user = v.user LEFT JOIN k ON k.user = coalesce(v.user, p.user)"""
)
def account_views(spark, sf_dir):
    events = security_events(spark, sf_dir)
    held = events.where("suspicious AND action = 'RDP_LOGIN' AND user IS NOT NULL").select("user")
    out = entities.with_account_facts(views.user_views(events), inventory(spark, sf_dir)[1], held)
    return entities.order_accounts(out).select("user", F.coalesce("events", F.lit(0)).alias("events"), "privilege", "is_privileged", "compromised")


@query(f"WITH {EV}, {INV}, {ACCESS} SELECT * FROM acc")
def user_access(spark, sf_dir):
    hosts, users, _ = inventory(spark, sf_dir)
    return joined(entities.user_access(security_events(spark, sf_dir), users, hosts), "event_ids")


@query("SELECT 'user' || n_nationkey AS name, n_regionkey / 4 AS privilege FROM nation WHERE n_regionkey >= 3 AND (n_nationkey = 12 OR n_nationkey * 3 % 25 = 12)")
def privileged_users(spark, sf_dir):
    return entities.privileged_users(inventory(spark, sf_dir)[1], "host-12").select("name", "privilege")


NEIGHBORS = """pr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT source_host AS a, destination_host AS b FROM ev WHERE event_type = 'authentication' UNION ALL SELECT 'HOST-' || n_nationkey, 'HOST-' || ((n_nationkey * 5 + 11) % 25) FROM nation) WHERE a <> b),
bo AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr), ob AS (SELECT DISTINCT source_host AS h FROM ev WHERE event_type = 'authentication' AND source_host <> destination_host),
nb AS (SELECT x AS host, y AS neighbor, ob.h IS NOT NULL AS observed, coalesce(role, 'unknown') AS role, coalesce(criticality, 0.0) AS criticality FROM bo LEFT JOIN ob ON ob.h = x LEFT JOIN inv ON inv.h = y)"""


def _neighbors(spark, sf_dir, events: DataFrame) -> DataFrame:
    hosts, _, links = inventory(spark, sf_dir)
    edges = graph.entity_edges(events)
    every = case_queries.inventory(spark, sf_dir)[0].select(F.concat(F.lit("host:"), "name").alias("id"))
    projection = graph.host_projection(edges.unionByName(links), every)
    return entities.host_neighbors(projection, edges.where("kind = 'CONNECTED_TO'").select(F.col("src").alias("id")), hosts)


@query(f"WITH {EV}, {INV}, {NEIGHBORS} SELECT host, neighbor, observed, role, criticality FROM nb")
def host_neighbors(spark, sf_dir):
    return _neighbors(spark, sf_dir, security_events(spark, sf_dir)).select("host", "neighbor", "observed", "role", "criticality")


#: The suspicious events of an account's day stand for a chain.
SPELLS = f"""sp AS (SELECT user || '/' || strftime(timestamp, '%Y-%m-%d') AS ck, any_value(user) AS user, arg_min({PRIMARY}, {ORDER}) AS h, arg_max({PRIMARY}, {ORDER}) AS cur, min(epoch_us(timestamp)) AS f, max(epoch_us(timestamp)) AS l FROM ev WHERE user IS NOT NULL AND suspicious GROUP BY 1)"""
TRACE = """tr AS (SELECT ck, count(*) AS auth_events, count(*) FILTER (WHERE outcome <> 'failure' AND destination_host <> source_host) AS remote_successes, count(*) FILTER (WHERE outcome = 'failure') AS failures, coalesce(string_agg(DISTINCT destination_host, ',' ORDER BY destination_host) FILTER (WHERE outcome <> 'failure' AND destination_host <> source_host), '') AS remote_hosts
  FROM sp JOIN ev ON ev.user = sp.user AND event_type = 'authentication' AND epoch_us(timestamp) BETWEEN f - 1800000000 AND l + 1800000000 GROUP BY ck),
fd AS (SELECT source_host AS h, string_agg(DISTINCT domain, ',' ORDER BY domain) AS d FROM ev WHERE event_type = 'dns' AND suspicious AND domain IS NOT NULL GROUP BY 1)"""


def spell_chains(events: DataFrame) -> DataFrame:
    rows = events.where("suspicious AND user IS NOT NULL").withColumns({"chain_key": F.concat_ws("/", "user", F.date_format("timestamp", "yyyy-MM-dd")), "_h": C.primary_host(), "_o": F.struct(C.micros().alias("t"), "event_id")})
    return rows.groupBy("chain_key").agg(F.first("user").alias("user"), F.min_by("_h", "_o").alias("host"), F.max_by("_h", "_o").alias("current_host"), F.min("_o.t").alias("first_us"), F.max("_o.t").alias("last_us"))


@query(
    f"""WITH {EV}, {INV}, {ACCESS}, {NEIGHBORS}, {SPELLS}, e AS (SELECT ck, neighbor AS h, true AS near, criticality >= 0.75 AS crit, false AS op FROM sp JOIN nb ON nb.host = sp.cur UNION ALL SELECT ck, acc.host, false, false, true FROM sp JOIN acc ON acc.user = sp.user WHERE NOT access_succeeded),
x AS (SELECT ck, h, bool_or(near) AS near, bool_or(crit) AS crit, bool_or(op) AS op FROM e GROUP BY ALL), y AS (SELECT ck, string_agg(h, ',' ORDER BY h) FILTER (WHERE crit) AS c, string_agg(h, ',' ORDER BY h) FILTER (WHERE op) AS u, string_agg(h, ',' ORDER BY h) FILTER (WHERE near AND op) AS e, count(*) FILTER (WHERE near AND op AND crit) AS n FROM x GROUP BY ck)
SELECT ck AS chain_key, coalesce(c, '') AS critical_neighbors, coalesce(u, '') AS unreached, coalesce(e, '') AS exposed, coalesce(n, 0) AS exposed_critical FROM sp LEFT JOIN y USING (ck)"""
)
def graph_exposure(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    hosts, users, _ = inventory(spark, sf_dir)
    out = entities.graph_exposure(spell_chains(events), _neighbors(spark, sf_dir, events), entities.user_access(events, users, hosts))
    return joined(out, "critical_neighbors", "unreached", "exposed")


@query(f"WITH {EV}, {SPELLS}, {TRACE} SELECT sp.ck AS chain_key, coalesce(auth_events, 0) AS auth_events, coalesce(remote_successes, 0) AS remote_successes, coalesce(failures, 0) AS failures, coalesce(remote_hosts, '') AS remote_hosts, coalesce(d, '') AS flagged_domains FROM sp LEFT JOIN tr ON tr.ck = sp.ck LEFT JOIN fd ON fd.h = sp.h")
def account_trace(spark, sf_dir):
    events = security_events(spark, sf_dir)
    return joined(entities.account_trace(spell_chains(events), events), "remote_hosts", "flagged_domains")


@query(
    f"""WITH {EV}, {SPELLS}, {TRACE}, en AS (SELECT {PRIMARY} AS h, action, process, parent_process, {ORDER} AS o FROM ev WHERE event_type = 'endpoint'), ex AS (SELECT h, bool_or(action = 'POWERSHELL_EXEC') AS ran, array_to_string(list(parent_process || ' -> ' || process ORDER BY o)[1:6], ';') AS lineage FROM en GROUP BY h),
mo AS (SELECT DISTINCT user || '/' || strftime(timestamp, '%Y-%m-%d') AS ck FROM ev WHERE suspicious AND action = 'RDP_LOGIN' AND user IS NOT NULL)
SELECT sp.ck AS chain_key, coalesce(ran, false) AS execution, CASE WHEN NOT coalesce(ran, false) THEN 'rejected' WHEN mo.ck IS NOT NULL THEN 'confirmed' WHEN remote_successes > 0 THEN 'partial' ELSE 'contained' END AS label,
 CASE WHEN NOT coalesce(ran, false) THEN 0.3 WHEN mo.ck IS NOT NULL THEN 0.74 WHEN remote_successes > 0 THEN 0.6 ELSE 0.55 END::DOUBLE AS confidence, coalesce(lineage, '') AS lineage FROM sp LEFT JOIN ex ON ex.h = sp.h LEFT JOIN tr ON tr.ck = sp.ck LEFT JOIN mo ON mo.ck = sp.ck"""
)
def chain_hypothesis(spark, sf_dir):
    """Suspicious remote desktop sign-ins stand for recorded movements."""
    events = stored(security_events(spark, sf_dir), "events")
    spells = stored(spell_chains(events), "spells")
    moves = events.where("suspicious AND action = 'RDP_LOGIN' AND user IS NOT NULL").select(F.concat_ws("/", "user", F.date_format("timestamp", "yyyy-MM-dd")).alias("chain_key"))
    out = entities.chain_hypothesis(spells, events, entities.account_trace(spells, events), moves)
    return out.select("chain_key", "execution", "label", "confidence", F.array_join("lineage", ";").alias("lineage"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT a.chain_key, source_event_id, target_event_id, round(raw, 4) AS score FROM links JOIN mem a ON a.event_id = source_event_id JOIN mem b ON b.event_id = target_event_id AND b.chain_key = a.chain_key")
def chain_detail(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    rows = events.join(chains.chain_members(events, correlate.connecting_links(events)), "event_id")
    return correlate.correlate_pairs(rows, carried=("chain_key",)).select("chain_key", "source_event_id", "target_event_id", "score")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT chain_key, event_id, 'new-host' AS anomaly FROM ev JOIN mem USING (event_id) WHERE suspicious")
def chain_anomalies(spark, sf_dir):
    events = stored(security_events(spark, sf_dir).withColumn("tags", F.when(F.col("suspicious"), F.array(F.lit("anomaly:new-host"), F.lit("beaconing")))), "events")
    return entities.chain_anomalies(events, chains.chain_members(events, correlate.connecting_links(events)))


_NAMES = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TACTIC_NAMES.items()) + " END"
_BEST = f"CASE confidence WHEN 'high' THEN 200 ELSE 100 END + list_position({list(TACTIC_ORDER)}, tactic)"
STAGES = f"""ta AS (SELECT event_id, arg_max(tactic, {_BEST}) AS t, list(technique) AS ts FROM tq GROUP BY event_id),
ct AS (SELECT ev.*, chain_key, {ORDER} AS o, ts, coalesce(t, CASE action WHEN 'LOGIN_FAILURE' THEN 'TA0006' WHEN 'RDP_LOGIN' THEN 'TA0008' WHEN 'PRIVILEGED_LOGIN' THEN 'TA0004' ELSE 'TA0002' END) AS t, CASE WHEN outcome = 'failure' THEN source_host ELSE {PRIMARY} END AS sh FROM ev JOIN mem USING (event_id) LEFT JOIN ta USING (event_id)),
sg AS (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY o) AS stage FROM (SELECT chain_key, t, sh, min(o) AS o, min(epoch_us(timestamp)) AS first_us, max(epoch_us(timestamp)) AS last_us, count(*) AS events, arg_min(user, o) FILTER (WHERE user IS NOT NULL) AS user, array_to_string(list_sort(list_distinct(flatten(list(coalesce(ts, []))))), ',') AS technique_ids FROM ct GROUP BY ALL))"""


@query(f"WITH RECURSIVE {COMPONENTS}, {TECHNIQUES}, {STAGES} SELECT chain_key, stage, t AS tactic, sh AS host, user, events, first_us, last_us, technique_ids FROM sg")
def chain_stage_rows(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    rows = chains.chain_events(events.where(C.is_notable()), chains.chain_members(events, correlate.connecting_links(events)))
    return joined(chains.chain_stages(rows), "technique_ids").withColumn("stage", F.col("stage").cast("bigint"))


@query(
    f"""WITH RECURSIVE {COMPONENTS}, {TECHNIQUES}, {STAGES}, old AS ({SQL['attack_chains']}), sc AS (SELECT mem.chain_key, ((2 * sum(CAST(round(round(raw, 4) * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000 AS mean_score FROM links JOIN mem ON mem.event_id = source_event_id GROUP BY 1),
now_ AS (SELECT chain_key, arg_max(t, o) AS tactic, arg_max({PRIMARY}, o) FILTER (WHERE event_type = 'endpoint') AS at_, arg_max(destination_host, o) FILTER (WHERE destination_host IS NOT NULL AND outcome <> 'failure') AS to_ FROM ct GROUP BY 1)
SELECT 'ATTACK-' || lpad(CAST(row_number() OVER (ORDER BY risk DESC, last_us DESC, old.chain_key) AS VARCHAR), 3, '0') AS chain_id, old.chain_key, CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN (SELECT max(last_us) FROM old) - last_us > 3600000000 THEN 'dormant' ELSE 'active' END AS status, mean_score,
 CASE WHEN mean_score >= 0.8 THEN 'high' WHEN mean_score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, coalesce(at_, to_, split_part(reached, ',', -1)) AS current_host, tactic AS current_tactic FROM old LEFT JOIN sc ON sc.chain_key = old.chain_key LEFT JOIN now_ ON now_.chain_key = old.chain_key"""
)
def chain_overview(spark, sf_dir):
    return chains.build_chains(security_events(spark, sf_dir))["chains"].select("chain_id", "chain_key", "severity", "status", "mean_score", "confidence", "current_host", "current_tactic")


@query(
    f"""WITH RECURSIVE {COMPONENTS}, {TECHNIQUES}, {STAGES}, fi AS (SELECT chain_key, arg_min(event_id, o) AS id, arg_min({PRIMARY}, o) AS h, min_by(struct_pack(u := user), o).u AS u FROM ct GROUP BY 1), pg AS (SELECT chain_key, string_agg({_NAMES} || ' on ' || sh, ';' ORDER BY stage) AS p FROM sg GROUP BY 1)
SELECT chain_key, id AS initial_event_id, h AS initial_host, u AS initial_user, p AS progression FROM fi JOIN pg USING (chain_key)"""
)
def root_cause(spark, sf_dir):
    built = chains.build_chains(security_events(spark, sf_dir))
    out = entities.root_cause(built["rows"], built["stages"], built["chains"].drop("initial_host"))
    return out.select("chain_key", "initial_event_id", "initial_host", "initial_user", F.array_join("progression", ";").alias("progression"))


@query(
    f"""WITH RECURSIVE {EV}, {DAYS}, {TARGETS} SELECT best.ck AS chain_key, best.h AS host, score, round(score / 100 * CASE WHEN best.h LIKE '%1' THEN 1.0 ELSE 0.5 END * CASE WHEN us.user IS NULL THEN 0.7 ELSE 1.0 END, 4) AS confidence,
 concat_ws(',', CASE WHEN best.h NOT LIKE '%1' THEN 'no path' END, CASE WHEN us.user IS NULL THEN 'account not entitled' END) AS caveats FROM best JOIN at_ ON at_.ck = best.ck LEFT JOIN (SELECT DISTINCT user, h FROM us) us ON us.user = at_.user AND us.h = best.h WHERE k = 1"""
)
def target_confidence(spark, sf_dir):
    """A host whose name ends in 1 stands for one with a path."""
    _, days, targets = case_queries._targets(spark, sf_dir)
    targets = stored(targets, "targets")
    out = entities.target_confidence(targets, days.select("chain_key", F.get("users", F.lit(0)).alias("user")), targets.where("host LIKE '%1'"), case_queries.inventory(spark, sf_dir)[1])
    return joined(out, "caveats")


#: A finding for each account and hour, citing its events; some ids and nodes lead nowhere.
FINDINGS_SQL = """
SELECT *, CASE n % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'correlated' WHEN 2 THEN 'inferred' ELSE 'predicted' END AS assurance, CASE WHEN n % 3 = 0 THEN 'investigation' ELSE 'graph' END AS agent,
 CASE n % 3 WHEN 0 THEN 'Hypothesis confirmed' ELSE 'Next target: host-' || CAST(n % 25 AS VARCHAR(20)) END AS title, CASE WHEN n % 5 < 3 THEN 'A sign-in Led to a process' ELSE 'Seen together' END AS statement, 0.05 * (n % 19 + 1) AS confidence,
 CASE n % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' END AS decision FROM {groups}"""
FINDINGS = f"""co AS (SELECT user || '/' || strftime(timestamp, '%Y-%m-%d') AS chain_key, user || '/' || strftime(timestamp, '%Y-%m-%d') || '/' || CAST(hour(timestamp) // 4 AS VARCHAR) AS finding_id, event_id, epoch_us(timestamp) AS us, event_type, source_host, CAST(right(event_id, 2) AS INT) AS k FROM ev WHERE user IS NOT NULL),
gp AS (SELECT finding_id, chain_key, CAST(right(min(event_id), 6) AS INT) AS n FROM co GROUP BY ALL), fd AS ({FINDINGS_SQL.replace('{groups}', 'gp')}),
ci AS (SELECT DISTINCT finding_id, 'event' AS kind, CASE WHEN k = 7 THEN event_id || 'x' ELSE event_id END AS ref FROM co WHERE k % 10 <> 4 UNION SELECT DISTINCT finding_id, 'node', source_host FROM co WHERE k % 3 = 0),
pf AS (SELECT ci.finding_id, kind, ref, ev.event_id IS NOT NULL OR (kind = 'node' AND ref <> 'HOST-2') AS found, epoch_us(timestamp) AS us, event_type FROM ci LEFT JOIN ev ON kind = 'event' AND event_id = ref)"""


def _findings(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    day = F.date_format("timestamp", "yyyy-MM-dd")
    cited = events.where("user IS NOT NULL").select(F.concat_ws("/", "user", day).alias("chain_key"), F.concat_ws("/", "user", day, F.floor(F.hour("timestamp") / 4).cast("string")).alias("finding_id"), "event_id", "source_host", F.expr("CAST(right(event_id, 2) AS INT)").alias("k"))
    groups = cited.groupBy("finding_id", "chain_key").agg(F.expr("CAST(right(min(event_id), 6) AS INT)").alias("n"))
    rows = events.sparkSession.sql(FINDINGS_SQL, groups=groups).withColumn("confidence", F.col("confidence").cast("double"))
    ids = cited.where("k % 10 <> 4").select("finding_id", F.lit("event").alias("kind"), F.expr("CASE WHEN k = 7 THEN concat(event_id, 'x') ELSE event_id END").alias("ref"))
    return rows, ids.unionByName(cited.where("k % 3 = 0").select("finding_id", F.lit("node").alias("kind"), F.col("source_host").alias("ref")))


def _nodes(events: DataFrame) -> DataFrame:
    return events.where("source_host <> 'HOST-2'").select(F.col("source_host").alias("id")).distinct()


VERIFIED = f"""pr AS (SELECT finding_id, count(*) FILTER (WHERE kind = 'event') AS ce, count(*) FILTER (WHERE kind = 'event' AND NOT found) AS ue, count(*) FILTER (WHERE kind = 'node') AS cn, count(*) FILTER (WHERE kind = 'node' AND NOT found) AS mn, max(us) - min(us) AS span FROM pf GROUP BY 1),
vf AS (SELECT fd.finding_id, chain_key, fd.confidence, coalesce(ce, 0) AS cited_events, coalesce(ue, 0) AS unresolved_events, coalesce(cn, 0) AS cited_nodes, coalesce(mn, 0) AS missing_nodes, concat_ws(',', CASE WHEN coalesce(ce, 0) = 0 AND coalesce(cn, 0) = 0 THEN 'no evidence' END, CASE WHEN ue > 0 THEN 'unresolved events' END, CASE WHEN mn > 0 THEN 'missing nodes' END,
  CASE WHEN span > 7200000000 THEN 'wide span' END, CASE WHEN assurance = 'predicted' AND NOT upper(title) LIKE '%1' THEN 'unreachable target' END, CASE WHEN assurance = 'correlated' AND n % 5 < 3 THEN 'causal claim' END, CASE WHEN n % 3 = 0 AND NOT chain_key LIKE '%1' THEN 'no movement' END) AS failures FROM fd LEFT JOIN pr ON pr.finding_id = fd.finding_id)"""


@query(
    f"""WITH {EV}, {FINDINGS}, {VERIFIED} SELECT finding_id, failures = '' AS verified, CASE WHEN failures = '' THEN confidence::DOUBLE ELSE round(greatest(0.05, confidence::DOUBLE - 0.35), 3) END AS confidence, cited_events, unresolved_events, cited_nodes, missing_nodes, failures FROM vf"""
)
def verify_findings(spark, sf_dir):
    """Every chain has a position; hosts that end in 1 have a path, chains that end in 1 a movement."""
    events = stored(security_events(spark, sf_dir), "events")
    rows, cited = _findings(events)
    rows = stored(rows, "findings")
    at = rows.select("chain_key", F.lit("HOST-1").alias("current_host")).distinct()
    aims = rows.select("chain_key", F.trim(F.element_at(F.split("title", ":"), -1)).alias("host")).where("host LIKE '%1'")
    out = findings.verify_findings(rows, cited, events, _nodes(events), at, aims, rows.where("chain_key LIKE '%1'"))
    return joined(out, "failures").select("finding_id", "verified", "confidence", "cited_events", "unresolved_events", "cited_nodes", "missing_nodes", "failures")


@query(f"WITH {EV}, {FINDINGS} SELECT finding_id, kind, count(*) AS unresolved, min(ref) AS first_unresolved FROM pf WHERE NOT found GROUP BY ALL")
def unresolved_citations(spark, sf_dir):
    events = security_events(spark, sf_dir)
    return findings.unresolved_citations(_findings(events)[1], events, _nodes(events))


@query(f"WITH {EV}, {FINDINGS} SELECT event_type, count(DISTINCT ref) AS records FROM pf WHERE kind = 'event' AND found GROUP BY event_type")
def evidence_breakdown(spark, sf_dir):
    events = security_events(spark, sf_dir)
    return findings.evidence_breakdown(_findings(events)[1], events)


@query(f"WITH {EV}, {FINDINGS} SELECT finding_id FROM fd WHERE finding_id NOT IN (SELECT finding_id FROM ci WHERE kind = 'event')")
def unsupported_findings(spark, sf_dir):
    return findings.unsupported_findings(*_findings(security_events(spark, sf_dir))).select("finding_id")


@query(f"WITH {EV}, {FINDINGS} SELECT finding_id, CASE n % 4 WHEN 2 THEN 'inferred' WHEN 3 THEN 'predicted' ELSE 'observed' END AS section FROM fd WHERE n % 6 <> 0 AND n % 7 <> 0")
def accepted_findings(spark, sf_dir):
    rows = _findings(security_events(spark, sf_dir))[0].withColumn("verified", F.when(F.col("n") % 7 == 0, False).when(F.col("n") % 7 == 1, True))
    return findings.accepted_findings(rows).select("finding_id", "section")


@query("SELECT conv_id, turn, seq, prev_hash, hash FROM (WITH RECURSIVE n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role || '|' || coalesce(text, '') AS body FROM conversations), w AS (SELECT conv_id, turn, seq, '' AS prev_hash, sha256(body) AS hash FROM n WHERE seq = 1 UNION ALL SELECT n.conv_id, n.turn, n.seq, w.hash, sha256(w.hash || body) FROM w JOIN n ON n.conv_id = w.conv_id AND n.seq = w.seq + 1) SELECT * FROM w)")
def append_hash_chain(spark, sf_dir):
    """Two batches of turns, the second after the tails of the first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", "role", F.coalesce("text", F.lit(""))).alias("body"))
    none = rows.select("conv_id", F.lit(0).cast("long").alias("seq"), F.lit("").alias("hash")).where(F.lit(False))
    first = stored(findings.append_hash_chain(rows.where("turn < 2"), none, "conv_id", "turn", "body"), "log")
    tails = first.groupBy("conv_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    second = findings.append_hash_chain(rows.where("turn >= 2"), tails, "conv_id", "turn", "body")
    return first.unionByName(second).select("conv_id", "turn", "seq", "prev_hash", "hash")


@query(f"WITH {EV} SELECT {NUMBER} AS seq, user AS actor, action FROM ev WHERE user = 'user7' AND action = 'LOGIN_FAILURE' ORDER BY seq DESC LIMIT 20")
def audit_entries(spark, sf_dir):
    log = security_events(spark, sf_dir).select(F.expr("CAST(substring(event_id, 4) AS BIGINT)").alias("seq"), F.col("user").alias("actor"), "action")
    return findings.audit_entries(log, 20, "user7", "LOGIN_FAILURE")


def _indicators(spark, events: DataFrame) -> DataFrame:
    fixed = spark.createDataFrame([("domain", "site1.example.com"), ("url", "http://files.site1.example.com/drop")], "kind string, value string")
    found = events.where(F.col("domain").endswith(".xyz")).select(F.lit("domain").alias("kind"), F.col("domain").alias("value"))
    addresses = events.where("suspicious and user = 'user7'").select(F.lit("ip").alias("kind"), F.col("source_ip").alias("value"))
    return found.union(addresses).union(fixed).distinct().withColumn("description", F.lit("listed"))


TOUCHED = f"""{INDICATORS}, hit AS (SELECT event_id, 1 AS o, 'intel:domain:' || value AS t FROM ev JOIN ind ON kind = 'domain' AND (domain = value OR domain LIKE '%.' || value) UNION ALL SELECT event_id, 2, 'intel:ip:' || value FROM ev JOIN ind ON kind = 'ip' AND (source_ip = value OR destination_ip = value) UNION ALL SELECT event_id, 4, 'intel:url:' || value FROM ev JOIN ind ON kind = 'url' AND contains(lower(command_line), value)),
it AS (SELECT event_id, string_agg(t, ',' ORDER BY o, t) AS tags FROM hit GROUP BY 1)"""


@query(f"WITH {EV}, {TOUCHED} SELECT event_id, coalesce(it.tags, '') AS intel, suspicious OR it.tags IS NOT NULL AS suspicious, CASE WHEN it.tags IS NOT NULL AND {RANK} < 3 THEN 'high' ELSE severity END AS severity FROM ev LEFT JOIN it USING (event_id)")
def apply_intel(spark, sf_dir):
    events = security_events(spark, sf_dir)
    out = composition.apply_intel(events, _indicators(spark, events))
    return out.select("event_id", F.array_join(F.filter("tags", lambda t: t.startswith("intel:")), ",").alias("intel"), "suspicious", "severity")


@query(
    rf"""WITH {EV}, {TOUCHED}, h AS (SELECT ev.*, coalesce(process = 'powershell.exe' AND command_line LIKE '%-enc%' AND command_line LIKE '%-nop%', false) AS r1, coalesce((command_line LIKE '%net group%' OR command_line LIKE '%whoami%') AND parent_process <> 'winword.exe', false) AS r2, coalesce(domain LIKE 'x7f%.xyz' OR domain LIKE 'files5%', false) AS r3, it.tags IS NOT NULL AS hit FROM ev LEFT JOIN it USING (event_id)),
t AS (SELECT *, greatest(CASE WHEN r1 THEN 3 ELSE -1 END, CASE WHEN r2 THEN 2 ELSE -1 END, CASE WHEN r3 THEN 1 ELSE -1 END, CASE WHEN hit THEN 3 ELSE -1 END, {RANK}) AS top FROM h),
s AS (SELECT DISTINCT action, lower(coalesce(process, domain, '')) AS i, {PRIMARY} AS h, coalesce(user, '') AS u FROM ev WHERE suspicious AND source_host = 'HOST-5')
SELECT event_id, ['info', 'low', 'medium', 'high', 'critical'][top + 1] AS severity, suspicious OR r1 OR r2 OR hit AS suspicious, s.u IS NOT NULL AS suppressed, severity AS base_severity FROM t LEFT JOIN s ON t.action = s.action AND lower(coalesce(process, domain, '')) = s.i AND {PRIMARY} = s.h AND coalesce(user, '') = s.u"""
)
def apply_detections(spark, sf_dir):
    events = security_events(spark, sf_dir)
    marked = detect.new_suppressions(events, events.where("suspicious and source_host = 'HOST-5'"))
    out = composition.apply_detections(events, [detect.compile_sigma(r) for r in SIGMA_RULES], _indicators(spark, events), marked, baselines=False)
    return out.select("event_id", "severity", "suspicious", F.col("suppressed").isNotNull().alias("suppressed"), "base_severity")


@query(f"WITH {EV} SELECT event_id, severity, suspicious, 0 AS tags FROM ev")
def reset_and_evaluate(spark, sf_dir):
    """Evaluated with rules and indicators, then without any: everything is as before."""
    events = security_events(spark, sf_dir)
    once = composition.apply_detections(events, [detect.compile_sigma(r) for r in SIGMA_RULES], _indicators(spark, events), baselines=False)
    again = composition.apply_detections(stored(once, "evaluated"), [], baselines=False)
    return again.select("event_id", "severity", "suspicious", F.size("tags").alias("tags"))


@query()
def enrich_and_detect(spark, sf_dir):
    events = stored(security_events(spark, sf_dir), "events")
    out = composition.enrich_and_detect(events, [detect.compile_sigma(r) for r in SIGMA_RULES], _indicators(spark, events))
    return out.select("event_id", "action", "severity", "suspicious", "suppressed")


@query(f"WITH {EV}, {TECHNIQUES} SELECT technique, tactic, confidence, count(*) AS events FROM tq GROUP BY ALL")
def rule_coverage(spark, sf_dir):
    out = composition.rule_coverage(spark, techniques.map_techniques(security_events(spark, sf_dir)))
    return out.where("events > 0").select("technique", "tactic", "confidence", "events")


@query(f"WITH {EV}, {TECHNIQUES} SELECT event_id, event_id IN (SELECT event_id FROM tq WHERE technique = 'T1027') AS supported FROM ev")
def technique_support(spark, sf_dir):
    return composition.technique_support(security_events(spark, sf_dir), "t1027")


@query(f"WITH {EV}, {INDICATORS}, s AS (SELECT DISTINCT action, lower(coalesce(process, domain, '')) AS i, {PRIMARY} AS h, coalesce(user, '') AS u FROM ev WHERE suspicious AND source_host = 'HOST-5') SELECT count(*) AS indicators, count(*) FILTER (WHERE kind = 'domain') AS domains, count(*) FILTER (WHERE kind = 'ip') AS ips, count(*) FILTER (WHERE kind = 'hash') AS hashes, count(*) FILTER (WHERE kind = 'url') AS urls, (SELECT count(*) FROM s) AS suppressions, 3 AS rules, 1 AS skipped FROM ind")
def detection_summary(spark, sf_dir):
    events = security_events(spark, sf_dir)
    marked = detect.new_suppressions(events, events.where("suspicious and source_host = 'HOST-5'"))
    return composition.detection_summary([detect.compile_sigma(r) for r in SIGMA_RULES], [{"file": "a.yml", "reason": "no condition"}], _indicators(spark, events), marked)


@query(f"WITH {EV} SELECT CASE event_type WHEN 'dns' THEN '4624' ELSE '4648' END AS code, event_id AS record_number, CASE WHEN user IS NULL THEN 0 ELSE 2 END AS accounts FROM ev WHERE event_type <> 'endpoint'")
def security_fields(spark, sf_dir):
    """Fields that are lists stay lists."""
    code = F.when(F.col("event_type") == "dns", "4624").when(F.col("event_type") == "endpoint", "1").otherwise("4648")
    names = F.when(F.col("user").isNotNull(), F.array(F.lit("-"), F.col("user")))
    lines = security_events(spark, sf_dir).select(F.to_json(F.struct(F.struct(code.alias("EventCode"), F.col("event_id").alias("RecordNumber"), names.alias("Account_Name"), F.lit("x").alias("other")).alias("result"))).alias("value"))
    out = datasets.select_security_fields(lines, "exercise")
    at = lambda p: F.get_json_object("record", p)
    return out.select("code", at("$.RecordNumber").alias("record_number"), F.coalesce(F.json_array_length(at("$.Account_Name")), F.lit(0)).alias("accounts"))


@query(f"WITH {EV} SELECT CASE event_type WHEN 'dns' THEN 'd1-sys-' ELSE CASE event_type WHEN 'authentication' THEN 'd1-sec-' ELSE 'd1-sys-' END END || event_id || '-' || source_host AS id, domain AS query, CASE event_type WHEN 'endpoint' THEN process END AS image FROM ev WHERE event_type <> 'endpoint' OR process <> 'powershell.exe'")
def apt_records(spark, sf_dir):
    """Encoded shells stand for openings of another process than the credential one, and go."""
    kind = F.col("event_type")
    code = F.when(kind == "authentication", 4624).when(kind == "dns", 22).when(F.col("process") == "powershell.exe", 10).otherwise(1)
    channel = F.when(kind == "authentication", "Security").otherwise("Microsoft-Windows-Sysmon/Operational")
    lines = security_events(spark, sf_dir).select(F.to_json(F.struct(code.alias("EventID"), channel.alias("Channel"), F.concat("source_host", F.lit(".corp.local")).alias("Hostname"), F.col("event_id").alias("RecordNumber"), F.col("domain").alias("QueryName"), F.col("process").alias("Image"), F.lit("notepad.exe").alias("TargetImage"))).alias("value"))
    at = lambda p: F.get_json_object("record", p)
    return datasets.select_apt_records(lines, "d1").select(F.coalesce(at("$.RecordId"), at("$.uid")).alias("id"), at("$.query").alias("query"), at("$.Image").alias("image"))


@query(f"WITH {EV}, h AS (SELECT DISTINCT source_host AS host, '10.1.0.' || split_part(source_host, '-', 2) AS ip FROM ev) SELECT host, ip, CASE WHEN ip = '10.1.0.3' THEN 'domain controller' WHEN host LIKE '%1' THEN 'workstation' ELSE 'server' END AS role, (CASE WHEN ip = '10.1.0.3' THEN 1.0 WHEN host LIKE '%1' THEN 0.3 ELSE 0.6 END)::DOUBLE AS criticality FROM h")
def host_roles(spark, sf_dir):
    hosts = security_events(spark, sf_dir).select(F.col("source_host").alias("host")).distinct()
    addresses = hosts.select("host", F.concat(F.lit("10.1.0."), F.split_part("host", F.lit("-"), F.lit(2))).alias("ip"))
    return datasets.derive_host_roles(hosts, addresses, addresses.where("ip = '10.1.0.3'"), "1").select("host", "ip", "role", "criticality")


@query(f"WITH {EV}, e AS (SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, {PRIMARY} AS host, event_id, epoch_us(timestamp) AS us FROM ev WHERE process = 'powershell.exe') SELECT day, host, min(us) AS us FROM e WHERE host <> 'HOST-3' GROUP BY ALL")
def first_remote_exec(spark, sf_dir):
    events = security_events(spark, sf_dir)
    starts = events.select(F.to_date("timestamp").alias("day"), F.lit("HOST-3").alias("host")).distinct()
    return datasets.first_remote_exec(events, starts, ("powershell.exe",)).select(F.col("day").cast("string").alias("day"), "host", "us")


@query(
    f"""WITH {EV}, m AS (SELECT event_id AS id, {PRIMARY} AS h, user, epoch_us(timestamp) AS us FROM ev WHERE action = 'RDP_LOGIN' AND suspicious AND user IS NOT NULL), p AS (SELECT id, m.h AS truth, {PRIMARY} AS h, row_number() OVER (PARTITION BY id ORDER BY epoch_us(timestamp) DESC, event_id DESC) AS k FROM m JOIN ev ON ev.user = m.user AND epoch_us(timestamp) < m.us)
SELECT (SELECT count(*) FROM m) AS moves, count(DISTINCT id) AS predicted, count(DISTINCT id) FILTER (WHERE k = 1 AND h = truth) AS top_1, count(DISTINCT id) FILTER (WHERE k <= 3 AND h = truth) AS top_3 FROM p"""
)
def backtest_hits(spark, sf_dir):
    """The account's latest hosts before a sign-in stand for a ranking."""
    events = security_events(spark, sf_dir).where("user IS NOT NULL").select("event_id", "user", C.micros().alias("us"), C.primary_host().alias("host"), F.expr("action = 'RDP_LOGIN' AND suspicious").alias("move"))
    rows = stored(datasets.numbered(events, "user"), "numbered")
    moves = rows.where("move").withColumnRenamed("event_id", "move_id")
    return datasets.hit_rates(moves, datasets.latest_before(moves, rows, "user", 5))


FACTORS = {"same_user": "a.user = b.user", "same_host": "list_has_any(a.hs, b.hs)", "host_pivot": f"b.source_host = coalesce(a.destination_host, a.source_host) AND b.destination_host <> b.source_host", "shared_ip": "list_has_any(a.ips, b.ips)", "process_continuity": "a.process = b.process AND list_has_any(a.hs, b.hs)", "domain_overlap": "a.domain = b.domain", "suspicious_coincidence": "list_has_any(a.hs, b.hs) AND a.suspicious AND b.suspicious"}
SQL["factor_counts"] = f"WITH {EV}, {PAIRS}, fa AS (SELECT round(raw, 4) AS score, unnest(list_filter([{', '.join(f'CASE WHEN {t} THEN {n!r} END' for n, t in FACTORS.items())}], lambda x: x IS NOT NULL)) AS factor FROM links JOIN nt a ON a.event_id = source_event_id JOIN nt b ON b.event_id = target_event_id) SELECT factor, count(*) AS links, max(score) AS best FROM fa GROUP BY factor"
