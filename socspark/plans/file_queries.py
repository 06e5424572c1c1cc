"""Queries over files that each query first writes from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socspark.operators import cases, graph
from socspark.plans.queries import EDGES, EV, query, security_events, table
from socspark.plans.storage import shared_path, stored
from socspark.sources import readers, sinks

COLUMNS = ("event_id", "user", "action", "command_line")
PLAIN = f"WITH {EV} SELECT event_id, user, action, command_line FROM ev"


def _fields(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.get_json_object("raw", f"$.{c}").alias(c) for c in COLUMNS])


@query(PLAIN)
def read_csv_files(spark, sf_dir):
    """SRC-1: files with a header, quotes inside values."""
    folder = shared_path(spark, "csv")
    security_events(spark, sf_dir).select(*COLUMNS).write.option("header", True).option("escape", '"').csv(folder)
    return _fields(readers.read_csv_logs(spark, folder))


@query(PLAIN)
def read_json_files(spark, sf_dir):
    """SRC-2, SRC-3, SRC-6: lines of one object, of an array and of an envelope, with comments and blank lines."""
    folder = shared_path(spark, "json")
    n = F.expr("CAST(substr(event_id, 4) AS INT)")
    one = F.to_json(F.struct(*COLUMNS))
    line = F.when(n % 3 == 0, one).when(n % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"records":['), one, F.lit("]}")))
    lines = security_events(spark, sf_dir).select(F.explode(F.array(line, F.lit("# comment"), F.lit("  "))).alias("value"))
    lines.write.text(folder)
    return _fields(readers.read_json_logs(spark, f"{folder}/*.txt"))


@query(f"WITH {EV} SELECT event_id, user, action, command_line FROM ev WHERE CAST(substr(event_id, 4) AS INT) % 4 <> 3")
def read_search_export(spark, sf_dir):
    """SRC-8, SRC-11: a packed search export; previews go."""
    folder = shared_path(spark, "export")
    preview = F.expr("CAST(substr(event_id, 4) AS INT)") % 4 == 3
    line = F.to_json(F.struct(preview.alias("preview"), F.struct(F.to_json(F.struct(*COLUMNS)).alias("_raw"), F.col("action").alias("other")).alias("result")))
    security_events(spark, sf_dir).select(line.alias("value")).write.option("compression", "gzip").text(folder)
    return _fields(readers.unwrap_search_export(spark.read.text(folder)))


@query(f"WITH {EV}, v AS (SELECT DISTINCT 'domain' AS kind, domain AS value, action AS description FROM ev WHERE domain IS NOT NULL UNION SELECT DISTINCT 'ip', source_ip, '' FROM ev) SELECT kind, value, min(description) AS description FROM v GROUP BY kind, value")
def load_intel_files(spark, sf_dir):
    """SRC-13: indicators from lines with descriptions, comments and repeats."""
    folder = shared_path(spark, "intel")
    events = security_events(spark, sf_dir)
    named = events.where("domain is not null").select(F.concat(F.upper("domain"), F.lit(" , "), "action").alias("value"))
    named.union(events.select("source_ip")).union(events.select(F.concat(F.lit("# "), "event_id"))).write.text(folder)
    return readers.load_intel_lines(spark.read.text(folder)).select("kind", "value", "description")


@query("SELECT 'host' AS kind, 'HOST-' || n_nationkey AS name, n_regionkey / 4 AS weight FROM nation UNION ALL SELECT 'user', 'user' || n_nationkey, n_regionkey / 8 FROM nation UNION ALL SELECT 'domain', lower(n_name) || '.example', NULL FROM nation")
def load_inventory_file(spark, sf_dir):
    """SRC-12: hosts, users and known domains of one file."""
    folder = shared_path(spark, "inventory")
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey")
    one = table(spark, sf_dir, "nation").agg(
        F.collect_list(F.struct(F.concat(F.lit("HOST-"), key).alias("name"), (region / 4).alias("criticality"))).alias("hosts"),
        F.collect_list(F.struct(F.concat(F.lit("user"), key).alias("name"), (region / 8).alias("privilege"))).alias("users"),
        F.collect_list(F.concat(F.lower("n_name"), F.lit(".example"))).alias("known_domains"),
    )
    one.select(F.to_json(F.struct("*"))).write.text(folder)
    found = readers.load_inventory(spark, folder)
    rows = found["hosts"].select(F.lit("host").alias("kind"), "name", F.col("criticality").alias("weight"))
    rows = rows.unionByName(found["users"].select(F.lit("user").alias("kind"), "name", F.col("privilege").alias("weight")))
    return rows.unionByName(found["known_domains"].select(F.lit("domain").alias("kind"), F.col("domain").alias("name"), F.lit(None).cast("double").alias("weight")))


@query(f"WITH {EV} SELECT event_id FROM ev ORDER BY timestamp DESC, event_id DESC LIMIT 250")
def latest_events(spark, sf_dir):
    """SNK-2: the newest 250 of a stored table."""
    folder = shared_path(spark, "events-table")
    sinks.upsert_events(security_events(spark, sf_dir), folder, 1)
    return sinks.latest_events(sinks.read_events(spark, folder), 250).select("event_id")


@query(f"WITH {EV}, m AS (SELECT max(timestamp) - INTERVAL 10 DAYS AS a, max(timestamp) - INTERVAL 5 DAYS AS b FROM ev) SELECT event_id, CASE WHEN timestamp < a THEN 'history' ELSE 'window' END AS part, (SELECT count(*) FROM ev, m WHERE timestamp < a) AS purged FROM ev, m WHERE timestamp < b")
def windows_and_purge(spark, sf_dir):
    """FLT-13 and SNK-4: the rows of five days and those before, and how many a purge takes."""
    events = stored(security_events(spark, sf_dir), "events")
    start, end = events.agg(F.max("timestamp") - F.expr("INTERVAL 10 DAYS"), F.max("timestamp") - F.expr("INTERVAL 5 DAYS")).first()
    within, before = cases.time_window_select(events, start, end)
    rows = within.select("event_id", F.lit("window").alias("part")).unionByName(before.select("event_id", F.lit("history").alias("part")))
    return rows.join(F.broadcast(sinks.purge_older_than(events, start)[1]))


@query(f"WITH {EV}, {EDGES} SELECT src, dst, kind, weight, split_part(src, ':', 1) AS src_kind FROM ed")
def graph_tables(spark, sf_dir):
    """SNK-8: entity edges and nodes, written and read again."""
    folder = shared_path(spark, "graph-tables")
    edges = stored(graph.entity_edges(security_events(spark, sf_dir)), "edges")
    sinks.write_graph_tables(graph.entity_nodes(edges), edges, folder)
    nodes = spark.read.parquet(f"{folder}/nodes").select(F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    return spark.read.parquet(f"{folder}/edges").join(nodes, "src").select("src", "dst", "kind", "weight", "src_kind")


@query(f"WITH {EV} SELECT event_type AS source_log, count(*) AS records, count(*) AS listed FROM ev GROUP BY 1")
def scenario_files(spark, sf_dir):
    """SNK-9: records by source, and the manifest."""
    folder = shared_path(spark, "scenario")
    raw = security_events(spark, sf_dir).select(F.to_json(F.struct(*COLUMNS)).alias("raw"), F.col("event_type").alias("source_log"), F.monotonically_increasing_id().alias("position"))
    sinks.write_scenario(raw, folder)
    records = spark.read.text(f"{folder}/records").groupBy("source_log").agg(F.count(F.lit(1)).alias("records"))
    return records.join(spark.read.json(f"{folder}/manifest").withColumnRenamed("records", "listed"), "source_log")
