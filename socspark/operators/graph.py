"""Entity graph tables, host projection, hops and paths."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.plans.storage import stored


def _id(kind: str, value: Column) -> Column:
    folded = F.upper(value) if kind == "host" else F.lower(value) if kind in ("user", "domain") else value
    return F.concat(F.lit(kind + ":"), folded)


def _at_host(kind: str, value: Column, host: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value), F.lit("@"), F.upper(F.coalesce(host, F.lit("unknown"))))


def entity_edges(events: DataFrame) -> DataFrame:
    """AGG-15: (src, dst, kind, weight) from the events, by one explode and one partial aggregation."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    host, user, dest, source = C.primary_host(), full("user"), full("destination_host"), full("source_host")
    domain, process, parent, file = full("domain"), full("process"), full("parent_process"), full("file_name")
    event = F.concat(F.lit("event:"), "event_id")
    kind = F.col("event_type")
    proc, above = _at_host("process", process, host), _at_host("process", parent, host)
    login, dns, endpoint = kind == "authentication", kind == "dns", kind == "endpoint"
    edge = lambda holds, a, b, k: F.when(holds & a.isNotNull() & b.isNotNull(), F.struct(a.alias("src"), b.alias("dst"), F.lit(k).alias("kind")))
    yes = F.lit(True)
    ran = endpoint & process.isNotNull() & host.isNotNull()
    edges = F.array(
        edge(yes, event, _id("host", host), "OCCURRED_ON"),
        edge(yes, event, _id("user", user), "INVOLVES"),
        edge(yes, event, _id("ip", full("source_ip")), "INVOLVES"),
        edge(F.coalesce(F.col("destination_ip") != F.col("source_ip"), yes), event, _id("ip", full("destination_ip")), "INVOLVES"),
        edge(login, _id("user", user), _id("host", dest), "LOGGED_INTO"),
        edge(login & (source != dest), _id("host", source), _id("host", dest), "CONNECTED_TO"),
        edge(dns, _id("host", host), _id("domain", domain), "RESOLVED"),
        edge(dns & process.isNotNull(), proc, _id("domain", domain), "GENERATED"),
        edge(ran, _id("host", host), proc, "EXECUTED"),
        edge(ran, _id("user", user), proc, "EXECUTED"),
        edge(ran & parent.isNotNull(), above, proc, "EXECUTED"),
        edge(endpoint & file.isNotNull(), _id("host", host), _at_host("file", file, host), "DROPPED"),
    )
    return events.select(F.explode(F.array_compact(edges)).alias("e")).groupBy("e.src", "e.dst", "e.kind").agg(F.count(F.lit(1)).alias("weight"))


def entity_nodes(edges: DataFrame) -> DataFrame:
    """Distinct (id, kind) of the ends of edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.select("id", F.substring_index("id", ":", 1).alias("kind"))


def host_projection(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """GRA-2: undirected (a, b) between known hosts; ``hosts`` has ``id``."""
    pairs = edges.where("kind = 'CONNECTED_TO' and src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(hosts.select(F.col("id").alias("a")), "a").join(hosts.select(F.col("id").alias("b")), "b").select("a", "b")


def connectivity(projection: DataFrame, hosts: DataFrame) -> DataFrame:
    """AGG-16: degree over the largest degree, for every host; without an edge all are 0."""
    # Pairs are made distinct before they are turned, so that no task holds the set of both directions; what is counted then are numbers.
    once = projection.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = once.select(F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    degree = stored(hosts.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")), "degrees")
    peak = degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("peak"))
    return degree.join(F.broadcast(peak)).select("id", "degree", F.round(F.col("degree") / F.col("peak"), 6).alias("score"))


def hops(projection: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """GRA-3: (start, id, hops) by level-synchronous search from every start at once; unreachable pairs, and those farther than ``most``, are absent."""
    # Each edge is read once for both directions; equal edges need not go here, as every front is made distinct.
    both = stored(projection.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("id"), F.col("a").alias("nbr")))).alias("e")).select("e.*"), "adjacency")
    known = stored(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct(), "hops")
    front = known
    for level in itertools.count(1):
        if most is not None and level > most:
            break
        ahead = front.join(both, "id").select("start", F.col("nbr").alias("id")).distinct()
        front = stored(ahead.join(known.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(level)), "frontier")
        if front.isEmpty():
            break
        known = stored(known.unionByName(front), "hops")
    return known


def attack_path(projection: DataFrame, src: str, dst: str, most: int | None = None) -> DataFrame:
    """GRA-4: the shortest path from ``src`` to ``dst`` that is first in order, as an array; no row if there is none."""
    both = stored(projection.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(projection.select(F.col("b").alias("id"), F.col("a").alias("nbr"))).distinct(), "adjacency")
    spark = projection.sparkSession
    front = spark.createDataFrame([(src, [src])], "id string, path array<string>")
    seen = front
    for level in itertools.count():
        if level == most:
            break
        if not front.where(F.col("id") == dst).isEmpty():
            return front.where(F.col("id") == dst).select("path")
        ahead = front.join(both, "id").select(F.col("nbr").alias("id"), F.concat("path", F.array("nbr")).alias("path")).groupBy("id").agg(F.min("path").alias("path"))
        front = stored(ahead.join(seen.select("id"), "id", "left_anti"), "frontier")
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front), "seen")
    return front.where(F.col("id") == dst).select("path")
