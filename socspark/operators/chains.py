"""Attack chains: components of linked events and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from socspark.functions import columns as C
from socspark.operators import entities, graph, predict, techniques
from socspark.operators.components import connected_components
from socspark.operators.correlate import connecting_totals, correlate_pairs, lateral_movement
from socspark.plans.config import CorrelationConfig
from socspark.plans.storage import stored


def _switched() -> Column:
    """Whether an event can join a chain through its movement, as a sign-in with another account's credentials."""
    return F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("credential-switch:")) & (F.length("user") > 0) & F.col("suppressed").isNull()


def chain_members(events: DataFrame, links: DataFrame, movements: DataFrame | None = None, least: int = 2, written: bool = False) -> DataFrame:
    """GRA-1: (event_id, chain_key) of components of at least ``least`` notable events that show attack behaviour.

    A sign-in with another account's credentials joins through its movement's
    supporting event. ``chain_key`` is the smallest event id. Links that are read from a
    table (``written``) are not written again.
    """
    notable = C.is_notable()
    edges = links.select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"))
    flags = events.select("event_id", (F.coalesce("suspicious", F.lit(False)) | (notable & (F.col("event_type") != "authentication"))).alias("_attack"), notable.alias("_notable"))
    if movements is not None:
        able = events.where(_switched()).select("event_id")
        moves = movements.join(able, "event_id").select(F.col("supporting_event_id").alias("src"), F.col("event_id").alias("dst"))
        edges = edges.unionByName(moves.join(flags.where("_notable").select(F.col("event_id").alias("src")), "src"))
    members = connected_components(edges if written else stored(edges, "chain-links")).withColumnsRenamed({"node": "event_id", "component": "chain_key"})
    kept = members.join(flags, "event_id").groupBy("chain_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("_attack").alias("_attack")).where((F.col("n") >= least) & F.col("_attack"))
    return members.join(kept.select("chain_key"), "chain_key")


def _first(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def chain_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events of chains with their mappings and tactic, one shuffle by event."""
    maps = techniques.mappings()
    out = events.join(members, "event_id").withColumn("maps", maps)
    return out.withColumns({"tactic": techniques.event_tactic(F.col("maps")), "_us": C.micros(), "_primary": C.primary_host(), "_order": F.struct(C.micros().alias("t"), F.col("event_id").alias("e"))})


def reached_and_targeted(rows: DataFrame) -> DataFrame:
    """AGG-5 by chain: hosts the activity got to, and hosts it only aimed at."""
    login = F.col("event_type") == "authentication"
    failed = F.coalesce(F.col("outcome") == "failure", F.lit(False))
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    reached = F.when(login, F.array(full("source_host"), F.when(~failed, full("destination_host")))).otherwise(F.array(F.col("_primary"), F.lit(None).cast("string")))
    aimed = F.when(login & failed, full("destination_host"))
    flat = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(c)))))
    out = rows.groupBy("chain_key").agg(flat(reached).alias("reached"), F.collect_set(aimed).alias("_aimed"))
    return out.select("chain_key", "reached", F.array_sort(F.array_except("_aimed", "reached")).alias("targeted"))


def stage_host() -> Column:
    """The host of an event's stage: where a failed sign-in came from, else the primary host."""
    failed_login = (F.col("event_type") == "authentication") & F.coalesce(F.col("outcome") == "failure", F.lit(False))
    host = F.when(failed_login, F.coalesce(F.nullif("source_host", F.lit("")), F.nullif("destination_host", F.lit("")))).otherwise(F.col("_primary"))
    return F.upper(F.coalesce(host, F.lit("unknown")))


def chain_stages(rows: DataFrame) -> DataFrame:
    """AGG-6: one stage for each (chain, tactic, host), in order of first time."""
    keyed = rows.withColumn("_host", stage_host())
    out = keyed.groupBy("chain_key", "tactic", "_host").agg(
        F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"),
        F.min_by("user", F.when(F.length("user") > 0, F.col("_order"))).alias("user"),
        F.count(F.lit(1)).alias("events"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.transform("maps", lambda m: m["technique"])))))).alias("technique_ids"),
        F.min("_order").alias("_first"),
    )
    w = Window.partitionBy("chain_key").orderBy("_first")
    return out.withColumn("stage", F.row_number().over(w)).select("chain_key", "stage", "tactic", F.col("_host").alias("host"), "user", "events", "first_us", "last_us", "technique_ids")


def link_totals(found: DataFrame, members: DataFrame) -> DataFrame:
    """Count and mean score of all links of each chain, from what ``connecting_totals`` found; links stay where they are found."""
    counts = found.where("link_count > 0").select(F.col("source_event_id").alias("event_id"), "link_count", "score_sum")
    sums = counts.join(members.select("event_id", "chain_key"), "event_id").groupBy("chain_key").agg(F.sum("link_count").alias("link_count"), F.sum("score_sum").alias("_sum"))
    # Whole numbers, so that the mean does not depend on the order of the links.
    return sums.select("chain_key", "link_count", (F.expr("(2 * _sum + link_count) div (2 * link_count)") / 10_000).alias("mean_score"))


def roll_up(rows: DataFrame, totals: DataFrame, movements: DataFrame, top_prediction: DataFrame | None = None) -> DataFrame:
    """AGG-4, AGG-7 and WIN-10, WIN-11: one row for each chain with counts, times, hosts, risk and rank."""
    endpoint = (F.col("event_type") == "endpoint") & F.col("_primary").isNotNull()
    arrived = (F.length("destination_host") > 0) & (F.coalesce("outcome", F.lit("")) != "failure")
    base = rows.groupBy("chain_key").agg(
        F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set(F.nullif("user", F.lit("")))).alias("users"),
        F.max_by("_primary", F.when(endpoint, F.col("_order"))).alias("_at"),
        F.max_by("destination_host", F.when(arrived, F.col("_order"))).alias("_to"),
        F.min_by("_primary", "_order").alias("initial_host"),
        F.max_by("tactic", "_order").alias("current_tactic"),
        F.bool_or(F.col("severity") == "critical").alias("_critical"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("maps", lambda m: m["tactic"])))).alias("_tactics"),
    )
    owner = rows.select("event_id", "chain_key")
    move = movements.join(owner, "event_id").groupBy("chain_key").agg(F.count(F.lit(1)).alias("lateral_count"))
    out = base.join(reached_and_targeted(rows), "chain_key").join(totals, "chain_key", "left").join(move, "chain_key", "left")
    top = F.lit(0.0)
    if top_prediction is not None:
        out = out.join(top_prediction.groupBy("chain_key").agg(F.max("score").alias("_top")), "chain_key", "left")
        top = F.coalesce("_top", F.lit(0.0))
    has = lambda t: F.array_contains("_tactics", t)
    points = lambda holds, n: F.when(holds, F.lit(float(n))).otherwise(F.lit(0.0))
    lateral = F.coalesce("lateral_count", F.lit(0))
    risk = 15.0 + F.least(F.lit(20.0), 5.0 * F.size("_tactics")) + points(has("TA0006"), 20) + points(has("TA0008") | (lateral > 0), 20) + points(has("TA0011"), 10) + points(F.coalesce("_critical", F.lit(False)), 10) + 0.15 * top
    out = out.withColumns({"risk": F.least(F.lit(100.0), F.bround(risk)).cast("int"), "current_host": F.coalesce("_at", "_to", F.try_element_at("reached", F.lit(-1))), "lateral_count": lateral.cast("long")})
    # Numbers of all chains: the place within a risk and day, and how many come before those.
    out = stored(out.withColumn("_day", F.coalesce(F.floor(F.col("last_us") / 86_400_000_000), F.lit(-1 << 40))), "chain-facts")
    before = Window.orderBy(F.desc("risk"), F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("risk", "_day").agg(F.count(F.lit(1)).alias("_n")).select("risk", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = out.join(F.broadcast(out.agg(F.max("last_us").alias("_latest")))).join(offsets, ["risk", "_day"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("risk", "_day").orderBy(F.desc("last_us"), "chain_key"))
    out = out.withColumns({"status": F.when(F.col("_latest") - F.col("last_us") > 3_600_000_000, F.lit("dormant")).otherwise(F.lit("active")), "chain_id": F.format_string("ATTACK-%03d", rank)})
    severity = F.when(F.col("risk") >= 80, "critical").when(F.col("risk") >= 60, "high").when(F.col("risk") >= 40, "medium").otherwise("low")
    return out.select("chain_id", "chain_key", "risk", severity.alias("severity"), "status", "event_count", F.coalesce("link_count", F.lit(0)).cast("long").alias("link_count"), "mean_score", C.confidence_from_score(F.coalesce("mean_score", F.lit(0.0))).alias("confidence"), "lateral_count", "first_us", "last_us", "users", "initial_host", "current_host", "current_tactic", "reached", "targeted")


def build_chains(events: DataFrame, config: CorrelationConfig = CorrelationConfig(), hosts: DataFrame | None = None, users: DataFrame | None = None, topology: DataFrame | None = None) -> dict[str, DataFrame]:
    """GRA-6: links, movements, members, chain events, stages, chains and root causes. Events are written once.

    Members come from connecting links, and counts of all links from the same shuffle; ``links`` are all links and are found
    when they are asked for, as their number grows with the square of what happens in a window.

    With an inventory of ``hosts`` and ``users`` the next ``targets`` of the
    chains are scored too, and the best one counts in the risk; ``topology`` adds
    known links to the observed ones, as entity edges.
    """
    events = stored(events, "events")
    links = correlate_pairs(events, config)
    movements = stored(lateral_movement(events, correlation=config), "movements")
    found = stored(connecting_totals(events, config), "chain-links")
    members = stored(chain_members(events, found, movements, config.min_chain_events, written=True), "members")
    # No other event is in a chain, so no other is shuffled.
    rows = stored(chain_events(events.where(C.is_notable() | F.coalesce(_switched(), F.lit(False))), members), "chain-events")
    totals = stored(link_totals(found, members), "link-totals")
    stages, chains, targets = chain_stages(rows), roll_up(rows, totals, movements), None
    if hosts is not None and users is not None:
        chains = stored(chains, "chains")
        edges = graph.entity_edges(events)
        known = hosts.select(F.concat(F.lit("host:"), F.upper("name")).alias("id")).distinct()
        projection = stored(graph.host_projection(edges if topology is None else edges.unionByName(topology), known), "projection")
        targets = stored(predict.score_targets(rows, chains, hosts, users, projection, predict.observed_access(events)), "targets")
        chains = roll_up(rows, totals, movements, targets)
    built = {"events": events, "links": links, "movements": movements, "members": members, "rows": rows, "stages": stages, "chains": chains}
    built["root_causes"] = entities.root_cause(rows, stages, chains, targets)
    return built if targets is None else built | {"targets": targets}
