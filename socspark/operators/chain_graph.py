"""The graph of attack chains: their entities with the strongest state of each, and what links them.

Events are first folded to their distinct facts, so a busy chain or host
shuffles one row for each kind of activity. Everything a chain says about an
entity is a row, and entities merge by a lattice: strongest state, earliest
stage, union of chains. Memberships are tables of their own, so no row grows
with the chains or events of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socspark.operators.chains import stage_host
from socspark.operators.graph import _at_host, _id
from socspark.operators.predict import STATES
from socspark.plans.storage import stored

#: Predictions of a lower score are not drawn, save a chain's best.
LEAST_SCORE = 60.0
NODE = ("chain_key", "id", "label", "kind", "state", "stage")
EDGE = ("chain_key", "src", "dst", "kind", "label", "first", "n_events")


def _full(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _facts(rows: DataFrame, stages: DataFrame) -> DataFrame:
    """The distinct activities of each chain with their stage, number and first event."""
    texts = [_full(c).alias(c) for c in ("user", "source_host", "destination_host", "domain", "process", "parent_process", "file_name", "outcome", "action")]
    told = rows.select("chain_key", "tactic", stage_host().alias("_host"), F.col("event_type").alias("type"), F.nullif("_primary", F.lit("")).alias("at"), F.coalesce("suspicious", F.lit(False)).alias("suspicious"), *texts, F.struct(F.col("_us").alias("t"), "event_id").alias("first"))
    keys = [c for c in told.columns if c != "first"]
    folded = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.min("first").alias("first"))
    return folded.join(stages.select("chain_key", "tactic", F.col("host").alias("_host"), "stage"), ["chain_key", "tactic", "_host"], "left")


def _claimed_hosts(chains: DataFrame, drawn: DataFrame) -> DataFrame:
    """(chain_key, host, state, shown): what a chain says about hosts; the current position alone draws none."""
    each = lambda column, state: chains.select("chain_key", F.explode(column).alias("host"), F.lit(STATES.index(state)).alias("state"), F.lit(True).alias("shown"))
    at = chains.select("chain_key", F.col("current_host").alias("host"), F.lit(STATES.index("current_position")).alias("state"), F.lit(False).alias("shown"))
    aimed = drawn.select("chain_key", "host", F.lit(STATES.index("potential_target")).alias("state"), F.lit(True).alias("shown"))
    every = each("reached", "compromised").unionByName(each("targeted", "suspicious")).unionByName(aimed).unionByName(at).where(F.length("host") > 0)
    return every.groupBy("chain_key", F.upper("host").alias("host")).agg(F.max("state").alias("state"), F.bool_or("shown").alias("shown"))


def _moved(movements: DataFrame, rows: DataFrame) -> DataFrame:
    owner = rows.select("event_id", "chain_key", "_us")
    return movements.join(owner, "event_id").select("chain_key", "source_host", "destination_host", "method", F.struct(F.col("_us").alias("t"), "event_id").alias("first"))


def _spawned(facts: DataFrame) -> DataFrame:
    """Processes at a host whose parent is itself a process of the chain."""
    ran = facts.where((F.col("type") == "endpoint") & F.col("at").isNotNull() & F.col("process").isNotNull() & F.col("parent_process").isNotNull())
    ran = ran.groupBy("chain_key", "parent_process", "process", "at").agg(F.min("stage").alias("stage"), F.sum("n_events").alias("n_events"), F.min("first").alias("first")).withColumn("_p", F.lower("parent_process"))
    known = facts.where("process is not null").select("chain_key", F.lower("process").alias("_p")).distinct()
    return ran.join(known, ["chain_key", "_p"], "left_semi")


def chain_graph(rows: DataFrame, chains: DataFrame, stages: DataFrame, movements: DataFrame, targets: DataFrame, users: DataFrame | None = None) -> dict[str, DataFrame]:
    """AGG-35: ``nodes``, ``edges`` and the chains of each, ``node_chains`` and ``edge_chains``.

    ``rows`` are chain events, ``chains`` have chain_key, users, reached,
    targeted, initial_host and current_host, ``targets`` chain_key, rank, host and
    score, ``users`` name and accessible_hosts. A node's state is the strongest
    that any chain gives it and its stage the earliest. An edge is kept where
    both ends are nodes; its label is that of its first event.
    """
    chains = stored(chains.select("chain_key", "users", "reached", "targeted", "initial_host", "current_host"), "graph-chains")
    drawn = stored(targets.where((F.col("score") >= LEAST_SCORE) | (F.col("rank") == 1)).select("chain_key", F.upper("host").alias("host"), "score"), "graph-drawn")
    facts = stored(_facts(rows, stages), "graph-facts")
    claims, moved, spawned = stored(_claimed_hosts(chains, drawn), "graph-hosts"), stored(_moved(movements, rows), "graph-moves"), stored(_spawned(facts), "graph-spawned")
    mine = stored(_nodes(facts, chains, claims, moved, spawned), "graph-nodes")
    merged = mine.groupBy("id").agg(F.min("label").alias("label"), F.first("kind").alias("kind"), F.max("state").alias("_state"), F.min("stage").alias("stage"), F.count(F.lit(1)).alias("n_chains"))
    assurance = F.when(F.col("kind") == "attack", "correlated").when((F.col("kind") == "host") & (F.col("_state") == STATES.index("potential_target")), "predicted").otherwise("observed")
    nodes = merged.select("id", "label", "kind", F.element_at(F.array(*map(F.lit, STATES)), F.col("_state") + 1).alias("state"), assurance.alias("assurance"), "stage", "n_chains")

    known, open_ended = _edges(facts, moved, spawned), _loose_edges(chains, drawn, users)
    ids = mine.select("id").distinct()
    open_ended = open_ended.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = known.unionByName(open_ended.select(*EDGE)).groupBy("src", "dst", "kind", "chain_key").agg(F.min(F.struct("first", "label")).alias("_f"), F.sum("n_events").alias("n_events"))
    links = stored(links, "graph-edges")
    edges = links.groupBy("src", "dst", "kind").agg(F.min("_f").alias("_f"), F.count(F.lit(1)).alias("n_chains"), F.sum("n_events").alias("n_events"))
    sure = F.when(F.col("kind").isin("lateral_move", "accesses"), "inferred").when(F.col("kind") == "part_of", "correlated").when(F.col("kind") == "predicted_move", "predicted").otherwise("observed")
    edges = edges.select("src", "dst", "kind", F.col("_f.label").alias("label"), sure.alias("assurance"), (F.col("kind") == "predicted_move").alias("predicted"), "n_chains", "n_events")
    return {"nodes": nodes, "edges": edges, "node_chains": mine.select("id", "chain_key"), "edge_chains": links.select("src", "dst", "kind", "chain_key", "n_events")}


def _nodes(facts: DataFrame, chains: DataFrame, claims: DataFrame, moved: DataFrame, spawned: DataFrame) -> DataFrame:
    """One row for each entity and chain."""
    node = lambda df, ident, label, kind, state, stage: df.select("chain_key", ident.alias("id"), label.alias("label"), F.lit(kind).alias("kind"), state.alias("state"), stage.alias("stage"))
    normal, none = F.lit(STATES.index("normal")), F.lit(None).cast("int")
    odd, hit = F.lit(STATES.index("suspicious")), F.lit(STATES.index("compromised"))
    watched = F.when(F.col("suspicious"), odd).otherwise(normal)
    login = F.col("type") == "authentication"
    seen = facts.select("chain_key", "stage", F.explode(F.array_compact(F.array("at", F.when(login, F.col("source_host")), F.when(login, F.col("destination_host"))))).alias("host"))
    seen = seen.groupBy("chain_key", F.upper("host").alias("host")).agg(F.min("stage").alias("stage"))
    via = moved.select("chain_key", F.explode(F.array("source_host", "destination_host")).alias("host")).select("chain_key", F.upper("host").alias("host"), none.alias("stage"))
    shown = claims.where("shown").select("chain_key", "host", none.alias("stage"))
    hosts = seen.unionByName(via).unionByName(shown).where(F.length("host") > 0).groupBy("chain_key", "host").agg(F.min("stage").alias("stage"))
    hosts = hosts.join(claims.select("chain_key", "host", "state"), ["chain_key", "host"], "left")
    endpoint = facts.where((F.col("type") == "endpoint") & F.col("at").isNotNull())
    parts = [
        node(hosts, _id("host", F.col("host")), F.col("host"), "host", F.coalesce("state", normal), F.col("stage")),
        node(chains, F.concat(F.lit("attack:"), "chain_key"), F.col("chain_key"), "attack", hit, none),
        node(chains.select("chain_key", F.explode("users").alias("user")), _id("user", F.col("user")), F.col("user"), "user", hit, none),
        node(facts.where((F.col("type") == "dns") & F.col("domain").isNotNull()), _id("domain", F.col("domain")), F.col("domain"), "domain", watched, F.col("stage")),
        node(endpoint.where("process is not null"), _at_host("process", F.col("process"), F.col("at")), F.col("process"), "process", watched, F.col("stage")),
        node(spawned, _at_host("process", F.col("parent_process"), F.col("at")), F.col("parent_process"), "process", odd, F.col("stage")),
        node(endpoint.where("file_name is not null"), _at_host("file", F.col("file_name"), F.col("at")), F.col("file_name"), "file", odd, F.col("stage")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("chain_key", "id").agg(F.min("label").alias("label"), F.first("kind").alias("kind"), F.max("state").alias("state"), F.min("stage").alias("stage")).select(*NODE)


def _edges(facts: DataFrame, moved: DataFrame, spawned: DataFrame) -> DataFrame:
    """Edges of events, whose ends are nodes."""
    login, dns, endpoint = (F.col("type") == t for t in ("authentication", "dns", "endpoint"))
    host = lambda c: _id("host", F.col(c))
    link = lambda holds, a, b, kind, label: F.when(holds & a.isNotNull() & b.isNotNull(), F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), label.alias("label")))
    action, process = F.col("action"), _at_host("process", F.col("process"), F.col("at"))
    found = F.array(
        link(login, _id("user", F.col("user")), host("destination_host"), "logged_into", F.concat(action, F.lit(" ("), F.coalesce("outcome", F.lit("success")), F.lit(")"))),
        link(login & (F.upper("source_host") != F.upper("destination_host")), host("source_host"), host("destination_host"), "connected_to", action),
        link(dns, host("at"), _id("domain", F.col("domain")), "resolved", action),
        link(endpoint & F.col("at").isNotNull(), host("at"), process, "executed", action),
        link(endpoint & F.col("at").isNotNull(), host("at"), _at_host("file", F.col("file_name"), F.col("at")), "dropped", F.lit("Dropped")),
    )
    told = facts.select("chain_key", "first", "n_events", F.explode(F.array_compact(found)).alias("e")).select("chain_key", "e.*", "first", "n_events")
    born = spawned.select("chain_key", _at_host("process", F.col("parent_process"), F.col("at")).alias("src"), process.alias("dst"), F.lit("executed").alias("kind"), F.lit("Spawned").alias("label"), "first", "n_events")
    moves = moved.select("chain_key", host("source_host").alias("src"), host("destination_host").alias("dst"), F.lit("lateral_move").alias("kind"), F.concat(F.lit("Lateral Movement ("), "method", F.lit(")")).alias("label"), "first", F.lit(1).cast("long").alias("n_events"))
    return told.select(*EDGE).unionByName(born.select(*EDGE)).unionByName(moves.select(*EDGE))


def _loose_edges(chains: DataFrame, drawn: DataFrame, users: DataFrame | None) -> DataFrame:
    """Edges without events, of which an end may be missing: origins, predicted moves and access of a chain's accounts."""
    none = F.lit(None).cast("struct<t:bigint,event_id:string>").alias("first")
    edge = lambda df, a, b, kind, label: df.select("chain_key", a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), label.alias("label"), none, F.lit(0).cast("long").alias("n_events"))
    host = lambda c: _id("host", F.col(c))
    out = edge(chains.where(F.length("initial_host") > 0), F.concat(F.lit("attack:"), "chain_key"), host("initial_host"), "part_of", F.lit("Origin"))
    aimed = drawn.join(chains.select("chain_key", "users", "current_host"), "chain_key")
    score = F.concat(F.lit("Potential target ("), F.bround("score").cast("int").cast("string"), F.lit("/100)"))
    out = out.unionByName(edge(aimed.where(F.length("current_host") > 0), host("current_host"), host("host"), "predicted_move", score))
    if users is not None:
        able = users.select(F.lower("name").alias("user"), F.explode(F.transform("accessible_hosts", F.upper)).alias("host")).distinct()
        held = aimed.select("chain_key", "host", F.explode(F.transform("users", F.lower)).alias("user")).join(able, ["user", "host"])
        out = out.unionByName(edge(held, _id("user", F.col("user")), host("host"), "accesses", F.lit("Has access")))
    return out
