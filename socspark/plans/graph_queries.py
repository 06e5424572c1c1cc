"""Queries of the chain graph: an account's events of one day stand for a chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from socspark.operators import chain_graph, chains, correlate, graph, predict, techniques
from socspark.plans.case_queries import DAYS, TARGETS, day_chains, day_rows, inventory
from socspark.plans.entity_queries import STAGES
from socspark.plans.queries import COMPONENTS, EV, MOVES, PRIMARY, TECHNIQUES, query, security_events
from socspark.plans.storage import stored

#: Some parents are processes of the chain, and some processes drop files.
STORY = "CASE WHEN parent_process = 'winword.exe' THEN 'powershell.exe' ELSE parent_process END"
DROPS = "CASE WHEN process LIKE 'tool1%' THEN process || '.dat' END"

LOGIN = "event_type = 'authentication'"
GRAPH = f"""{EV}, {DAYS}, {TARGETS}, {MOVES}, mem AS (SELECT event_id, ck AS chain_key FROM c), {TECHNIQUES}, {STAGES},
x AS (SELECT ct.* REPLACE ({STORY} AS parent_process, {DROPS} AS file_name), stage, {PRIMARY} AS at_host FROM ct JOIN sg USING (chain_key, t, sh)),
dr AS (SELECT * FROM best WHERE score >= 60 OR k = 1),
td AS (SELECT ck, destination_host AS h FROM c WHERE {LOGIN} AND outcome = 'failure' AND destination_host IS NOT NULL EXCEPT SELECT ck, h FROM rc),
hs AS (SELECT ck, h, max(s) AS s FROM (SELECT ck, h, 3 AS s FROM rc UNION ALL SELECT ck, h, 2 FROM dr UNION ALL SELECT ck, h, 1 FROM td UNION ALL SELECT ck, cur, 4 FROM at_) WHERE h IS NOT NULL GROUP BY ALL),
lm AS (SELECT mv.*, chain_key AS ck FROM mv JOIN mem USING (event_id)),
nh AS (SELECT chain_key AS ck, at_host AS h, stage FROM x UNION ALL SELECT chain_key, source_host, stage FROM x WHERE {LOGIN} UNION ALL SELECT chain_key, destination_host, stage FROM x WHERE {LOGIN}
  UNION ALL SELECT ck, h, NULL FROM rc UNION ALL SELECT ck, h, NULL FROM td UNION ALL SELECT ck, h, NULL FROM dr UNION ALL SELECT ck, source_host, NULL FROM lm UNION ALL SELECT ck, destination_host, NULL FROM lm),
ru AS (SELECT *, parent_process IN (SELECT process FROM x i WHERE i.chain_key = x.chain_key AND process IS NOT NULL) AS inner_ FROM x WHERE event_type = 'endpoint' AND process IS NOT NULL),
nd AS (SELECT ck, 'host:' || h AS id, h AS label, 'host' AS kind, coalesce(s, 0) AS s, stage FROM nh LEFT JOIN hs USING (ck, h) WHERE h IS NOT NULL
  UNION ALL SELECT ck, 'attack:' || ck, ck, 'attack', 3, NULL FROM at_ UNION ALL SELECT ck, 'user:' || user, user, 'user', 3, NULL FROM at_
  UNION ALL SELECT chain_key, 'domain:' || domain, domain, 'domain', suspicious::INT, stage FROM x WHERE event_type = 'dns' AND domain IS NOT NULL
  UNION ALL SELECT chain_key, 'process:' || process || '@' || at_host, process, 'process', suspicious::INT, stage FROM ru
  UNION ALL SELECT chain_key, 'process:' || parent_process || '@' || at_host, parent_process, 'process', 1, stage FROM ru WHERE inner_
  UNION ALL SELECT chain_key, 'file:' || file_name || '@' || at_host, file_name, 'file', 1, stage FROM ru WHERE file_name IS NOT NULL),
le AS (SELECT chain_key AS ck, 'user:' || user AS src, 'host:' || destination_host AS dst, 'logged_into' AS kind, action || ' (' || outcome || ')' AS label, o, 1 AS n FROM x WHERE {LOGIN}
  UNION ALL SELECT chain_key, 'host:' || source_host, 'host:' || destination_host, 'connected_to', action, o, 1 FROM x WHERE {LOGIN} AND source_host <> destination_host
  UNION ALL SELECT chain_key, 'host:' || at_host, 'domain:' || domain, 'resolved', action, o, 1 FROM x WHERE event_type = 'dns'
  UNION ALL SELECT chain_key, 'host:' || at_host, 'process:' || process || '@' || at_host, 'executed', action, o, 1 FROM ru
  UNION ALL SELECT chain_key, 'process:' || parent_process || '@' || at_host, 'process:' || process || '@' || at_host, 'executed', 'Spawned', o, 1 FROM ru WHERE inner_
  UNION ALL SELECT chain_key, 'host:' || at_host, 'file:' || file_name || '@' || at_host, 'dropped', 'Dropped', o, 1 FROM ru WHERE file_name IS NOT NULL
  UNION ALL SELECT ck, 'host:' || source_host, 'host:' || destination_host, 'lateral_move', 'Lateral Movement (' || method || ')', bus::HUGEINT * 1000000000 + CAST(substr(event_id, 4) AS INT), 1 FROM lm
  UNION ALL SELECT ck, 'attack:' || ck, 'host:' || arg_min(h, o), 'part_of', 'Origin', NULL, 0 FROM (SELECT chain_key AS ck, at_host AS h, o FROM x) GROUP BY ck
  UNION ALL SELECT ck, 'host:' || cur, 'host:' || h, 'predicted_move', 'Potential target (' || round_even(score, 0)::INT || '/100)', NULL, 0 FROM dr JOIN at_ USING (ck)
  UNION ALL SELECT dr.ck, 'user:' || at_.user, 'host:' || dr.h, 'accesses', 'Has access', NULL, 0 FROM dr JOIN at_ USING (ck) JOIN (SELECT DISTINCT user, h FROM us) us ON us.user = at_.user AND us.h = dr.h),
ed AS (SELECT * FROM le WHERE src IN (SELECT id FROM nd) AND dst IN (SELECT id FROM nd))"""


def built(spark, sf_dir) -> dict:
    events = stored(security_events(spark, sf_dir), "events")
    rows = stored(day_rows(events).withColumns({"parent_process": F.expr(STORY), "file_name": F.expr(DROPS), "maps": techniques.mappings(), "_us": F.unix_micros("timestamp")}), "day-rows")
    rows = rows.withColumn("tactic", techniques.event_tactic(F.col("maps")))
    days = stored(day_chains(rows).join(rows.groupBy("chain_key").agg(F.min_by("_primary", "_order").alias("initial_host")), "chain_key"), "day-chains")
    hosts, users, links = inventory(spark, sf_dir)
    edges = graph.entity_edges(events).unionByName(links)
    projection = stored(graph.host_projection(edges, hosts.select(F.concat(F.lit("host:"), "name").alias("id"))), "projection")
    targets = stored(predict.score_targets(rows, days, hosts, users, projection, predict.observed_access(events)), "targets")
    return chain_graph.chain_graph(rows, days, chains.chain_stages(rows), correlate.lateral_movement(events), targets, users)


@query(
    f"""WITH RECURSIVE {GRAPH}, m AS (SELECT id, min(label) AS label, any_value(kind) AS kind, max(s) AS s, min(stage) AS stage, count(DISTINCT ck) AS n_chains FROM nd GROUP BY id)
SELECT id, label, kind, ['normal', 'suspicious', 'potential_target', 'compromised', 'current_position'][s + 1] AS state, CASE WHEN kind = 'attack' THEN 'correlated' WHEN kind = 'host' AND s = 2 THEN 'predicted' ELSE 'observed' END AS assurance, stage::BIGINT AS stage, n_chains FROM m"""
)
def chain_graph_nodes(spark, sf_dir):
    """AGG-35: entities of all chains."""
    return built(spark, sf_dir)["nodes"].withColumn("stage", F.col("stage").cast("long"))


@query(
    f"""WITH RECURSIVE {GRAPH}
SELECT src, dst, kind, coalesce(arg_min(label, (o, label)) FILTER (WHERE o IS NOT NULL), min(label)) AS label, CASE WHEN kind IN ('lateral_move', 'accesses') THEN 'inferred' WHEN kind = 'part_of' THEN 'correlated' WHEN kind = 'predicted_move' THEN 'predicted' ELSE 'observed' END AS assurance, kind = 'predicted_move' AS predicted, count(DISTINCT ck) AS n_chains, sum(n)::BIGINT AS n_events
FROM ed GROUP BY src, dst, kind"""
)
def chain_graph_edges(spark, sf_dir):
    """AGG-35: what links the entities."""
    return built(spark, sf_dir)["edges"]


@query(f"WITH RECURSIVE {GRAPH} SELECT DISTINCT id, ck AS chain_key FROM nd")
def chain_graph_members(spark, sf_dir):
    """AGG-35: the chains of each entity."""
    return built(spark, sf_dir)["node_chains"]


@query(f"WITH RECURSIVE {COMPONENTS} SELECT event_id, chain_key FROM mem")
def chain_components_by_few_links(spark, sf_dir):
    """GRA-6: the members of chains from connecting links alone."""
    events = stored(security_events(spark, sf_dir), "events")
    return chains.chain_members(events, correlate.connecting_links(events)).select("event_id", "chain_key")
