"""Hosts, accounts and chains seen from one entity: inventory facts, access, neighbours, traces and what follows for a chain.

Every view is computed for all entities at once; a caller filters the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from socspark.functions import columns as C
from socspark.operators.enrich import SERVICE_ACCOUNT
from socspark.plans.schemas import TACTIC_NAMES

DAY_US = 86_400_000_000
# Actions that show execution, delivery and access to credentials.
EXECUTION_ACTIONS = ("POWERSHELL_EXEC", "SCRIPT_EXEC", "COMMAND_EXEC")
DELIVERY_ACTION, CREDENTIAL_ACTION = "MALICIOUS_ATTACHMENT", "CREDENTIAL_ACCESS"
#: Event ids and process pairs that a row quotes.
QUOTED_EVENTS, QUOTED_PAIRS = 5, 6


def _names(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.collect_set(values))))


def evidence_row(events: DataFrame) -> DataFrame:
    """FLT-11: the columns that a search shows, a summary line, and the findings of the tags."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    findings = C.extract_findings(tags)
    shown = "event_id timestamp event_type action user source_host destination_host source_ip process parent_process domain outcome severity suspicious".split()
    return events.select(*shown, C.event_summary().alias("summary"), findings.alias("findings"))


def with_host_facts(views: DataFrame, hosts: DataFrame) -> DataFrame:
    """JOIN-13: host views with inventory facts; hosts on one side only stay, those without an entry as ``unknown``."""
    facts = hosts.select(F.upper("name").alias("host"), "role", "criticality").dropDuplicates(["host"]).withColumn("known_asset", F.lit(True))
    out = views.join(facts, "host", "full")
    return out.withColumns({"known_asset": F.coalesce("known_asset", F.lit(False)), "role": F.coalesce("role", F.lit("unknown")), "criticality": F.coalesce("criticality", F.lit(0.0))})


def with_account_facts(views: DataFrame, users: DataFrame, compromised: DataFrame) -> DataFrame:
    """JOIN-13: account views with inventory facts, whether a chain holds the account (``compromised.user``), and whether it belongs to the system."""
    facts = users.select(F.lower("name").alias("user"), "privilege", "is_privileged").dropDuplicates(["user"]).withColumn("_known", F.lit(True))
    held = compromised.select(F.lower("user").alias("user")).distinct().withColumn("compromised", F.lit(True))
    out = views.join(facts, "user", "full").join(held, "user", "left")
    builtin = F.col("_known").isNull() & F.col("user").rlike(SERVICE_ACCOUNT)
    return out.withColumns({"privilege": F.coalesce("privilege", F.lit(0.0)), "is_privileged": F.coalesce("is_privileged", F.lit(False)), "compromised": F.coalesce("compromised", F.lit(False)), "builtin": builtin}).drop("_known")


def order_hosts(views: DataFrame) -> DataFrame:
    """TOP-5: the current position first, then by criticality and name."""
    return views.orderBy(~F.coalesce(F.col("state") == "current_position", F.lit(False)), F.desc("criticality"), "host")


def order_accounts(views: DataFrame) -> DataFrame:
    """TOP-5: accounts of chains first, then by privilege and name."""
    return views.orderBy(F.desc("compromised"), F.desc("privilege"), "user")


def host_profile(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """AGG-23: for each host its facts, events, flagged events and accounts."""
    each = events.select(F.explode(F.array_distinct(F.transform(C.hosts(), F.upper))).alias("host"), C.is_notable().alias("flagged"), F.nullif("user", F.lit("")).alias("user"))
    seen = each.groupBy("host").agg(F.count(F.lit(1)).alias("event_count"), F.count_if("flagged").alias("flagged_event_count"), _names(F.col("user")).alias("accounts_seen"))
    out = with_host_facts(seen, hosts)
    return out.withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "flagged_event_count": F.coalesce("flagged_event_count", F.lit(0)), "accounts_seen": F.coalesce("accounts_seen", F.array().cast("array<string>"))})


def user_access(events: DataFrame, users: DataFrame, hosts: DataFrame) -> DataFrame:
    """JOIN-14: for each entitled (user, host) whether activity was seen, whether access succeeded, and the first event ids.

    A failed logon towards a host is activity, not access. Only events of
    entitled pairs are aggregated.
    """
    entitled = users.select(F.lower("name").alias("user"), F.explode("accessible_hosts").alias("_h")).select("user", F.upper("_h").alias("host")).distinct()
    failed = (F.length("destination_host") > 0) & F.coalesce(F.col("outcome") == "failure", F.lit(False))
    mine = events.where(F.length("user") > 0).select(F.lower("user").alias("user"), F.explode(F.array_distinct(F.transform(C.hosts(), F.upper))).alias("host"), C.micros().alias("us"), "event_id", (~F.coalesce(failed, F.lit(False))).alias("ok"))
    mine = mine.join(entitled, ["user", "host"], "left_semi")
    place = F.row_number().over(Window.partitionBy("user", "host").orderBy("us", "event_id"))
    firsts = mine.withColumn("_n", place).where(F.col("_n") <= QUOTED_EVENTS).groupBy("user", "host").agg(F.array_sort(F.collect_list(F.struct("_n", "event_id")))["event_id"].alias("event_ids"))
    seen = mine.groupBy("user", "host").agg(F.bool_or("ok").alias("access_succeeded")).join(firsts, ["user", "host"])
    out = entitled.join(seen, ["user", "host"], "left").join(hosts.select(F.upper("name").alias("host"), "criticality").dropDuplicates(["host"]), "host", "left")
    return out.select("user", "host", F.col("access_succeeded").isNotNull().alias("activity_seen"), F.coalesce("access_succeeded", F.lit(False)).alias("access_succeeded"), F.coalesce("event_ids", F.array().cast("array<string>")).alias("event_ids"), F.coalesce("criticality", F.lit(0.0)).alias("criticality"))


def privileged_users(users: DataFrame, host: str | None = None) -> DataFrame:
    """JOIN-15: privileged accounts, of those that may use ``host`` if given, by falling privilege and name."""
    out = users.where("is_privileged")
    if host:
        out = out.where(F.exists("accessible_hosts", lambda h: F.upper(h) == host.upper()))
    return out.orderBy(F.desc("privilege"), "name")


def host_neighbors(projection: DataFrame, observed: DataFrame, hosts: DataFrame) -> DataFrame:
    """JOIN-16: (host, neighbor) of the host projection with the neighbour's facts, and whether the host was observed to connect (``observed.id``)."""
    both = projection.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(projection.select(F.col("b").alias("id"), F.col("a").alias("nbr"))).distinct()
    both = both.join(observed.select("id").distinct().withColumn("_seen", F.lit(True)), "id", "left")
    name = lambda c: F.expr(f"substr({c}, 6)")
    out = both.select(name("id").alias("host"), name("nbr").alias("neighbor"), F.coalesce("_seen", F.lit(False)).alias("observed"))
    facts = hosts.select(F.upper("name").alias("neighbor"), "role", "criticality").dropDuplicates(["neighbor"])
    return out.join(facts, "neighbor", "left").withColumns({"role": F.coalesce("role", F.lit("unknown")), "criticality": F.coalesce("criticality", F.lit(0.0))})


def graph_exposure(chains: DataFrame, neighbors: DataFrame, access: DataFrame, critical: float = 0.75) -> DataFrame:
    """GRA-7: for each chain the critical neighbours of its host, hosts that its account may use and has not reached, and those of them next to it.

    ``chains`` has chain_key, user and current_host.
    """
    key = chains.select("chain_key", F.lower("user").alias("user"), F.upper("current_host").alias("host"))
    near = key.join(neighbors.select("host", "neighbor", "criticality"), "host").select("chain_key", F.col("neighbor").alias("host"), F.lit(True).alias("near"), (F.col("criticality") >= critical).alias("critical"), F.lit(False).alias("open"))
    left = key.select("chain_key", "user").join(access.where("not access_succeeded").select("user", "host"), "user").select("chain_key", "host", F.lit(False).alias("near"), F.lit(False).alias("critical"), F.lit(True).alias("open"))
    each = near.unionByName(left).groupBy("chain_key", "host").agg(F.bool_or("near").alias("near"), F.bool_or("critical").alias("critical"), F.bool_or("open").alias("open"))
    pick = lambda holds: _names(F.when(holds, F.col("host")))
    exposed = F.col("near") & F.col("open")
    out = each.groupBy("chain_key").agg(pick(F.col("critical")).alias("critical_neighbors"), pick(F.col("open")).alias("unreached"), pick(exposed).alias("exposed"), F.count_if(exposed & F.col("critical")).alias("exposed_critical"))
    none = F.array().cast("array<string>")
    out = key.select("chain_key").join(out, "chain_key", "left")
    return out.select("chain_key", *[F.coalesce(c, none).alias(c) for c in ("critical_neighbors", "unreached", "exposed")], F.coalesce("exposed_critical", F.lit(0)).alias("exposed_critical"))


def account_trace(chains: DataFrame, events: DataFrame, window_seconds: int = 1800) -> DataFrame:
    """GRA-8: sign-ins of each chain's account from a window before the chain to one after it, and flagged domains of its host.

    ``chains`` has chain_key, user, host, first_us and last_us. Chain and event
    meet in (account, day), so a busy account is spread over its days; domains
    are gathered once for each host.
    """
    margin = window_seconds * 1_000_000
    day = lambda us: F.floor(us / DAY_US)
    spans = chains.where(F.length("user") > 0).select("chain_key", F.lower("user").alias("user"), (F.col("first_us") - margin).alias("_from"), (F.col("last_us") + margin).alias("_to"))
    spans = spans.withColumn("_day", F.explode(F.sequence(day(F.col("_from")), day(F.col("_to")))))
    logons = events.where((F.col("event_type") == "authentication") & (F.length("user") > 0)).select(F.lower("user").alias("user"), C.micros().alias("us"), "outcome", "source_host", "destination_host").withColumn("_day", day(F.col("us")))
    failed = F.coalesce(F.col("outcome") == "failure", F.lit(False))
    remote = ~failed & (F.length("destination_host") > 0) & ~F.col("destination_host").eqNullSafe(F.col("source_host"))
    met = spans.join(logons, ["user", "_day"]).where(F.col("us").between(F.col("_from"), F.col("_to")))
    traced = met.groupBy("chain_key").agg(F.count(F.lit(1)).alias("auth_events"), F.count_if(remote).alias("remote_successes"), F.count_if(failed).alias("failures"), _names(F.when(remote, F.col("destination_host"))).alias("remote_hosts"))
    flagged = events.where((F.col("event_type") == "dns") & (F.length("domain") > 0) & F.coalesce("suspicious", F.lit(False)))
    domains = flagged.select(F.explode(F.array_distinct(F.transform(C.hosts(), F.upper))).alias("_host"), "domain").groupBy("_host").agg(_names(F.col("domain")).alias("flagged_domains"))
    out = chains.select("chain_key", F.upper("host").alias("_host")).join(traced, "chain_key", "left").join(domains, "_host", "left")
    none = F.array().cast("array<string>")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("auth_events", "remote_successes", "failures")]
    return out.select("chain_key", *counts, F.coalesce("remote_hosts", none).alias("remote_hosts"), F.coalesce("flagged_domains", none).alias("flagged_domains"))


def chain_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """JOIN-12: the links with both ends in one chain, with its key."""
    end = lambda c: members.select(F.col("event_id").alias(c), F.col("chain_key").alias("_" + c))
    out = links.join(end("source_event_id"), "source_event_id").join(end("target_event_id"), "target_event_id")
    return out.where(F.col("_source_event_id") == F.col("_target_event_id")).withColumn("chain_key", F.col("_source_event_id")).select("chain_key", *links.columns)


def chain_anomalies(events: DataFrame, members: DataFrame) -> DataFrame:
    """FLT-16: (chain_key, event_id, anomaly) of a chain's events."""
    found = F.filter("tags", lambda t: t.startswith("anomaly:"))
    each = events.where(F.exists("tags", lambda t: t.startswith("anomaly:"))).select("event_id", F.explode(F.array_distinct(found)).alias("_t"))
    return each.join(members.select("event_id", "chain_key"), "event_id").select("chain_key", "event_id", F.expr("substr(_t, 9)").alias("anomaly"))


def chain_hypothesis(chains: DataFrame, events: DataFrame, trace: DataFrame, movements: DataFrame) -> DataFrame:
    """AGG-38: what the endpoint records of a chain's first host, its account's sign-ins and its movements support.

    ``chains`` has chain_key and host, ``trace`` comes from `account_trace`,
    ``movements`` has chain_key. ``lineage`` quotes the host's first processes.
    """
    endpoint = events.where(F.col("event_type") == "endpoint").select(F.upper(C.primary_host()).alias("_host"), "action", "process", "parent_process", C.micros().alias("us"), "event_id")
    flag = lambda *actions: F.coalesce(F.bool_or(F.col("action").isin(*actions)), F.lit(False))
    shown = endpoint.groupBy("_host").agg(flag(*EXECUTION_ACTIONS).alias("execution"), flag(DELIVERY_ACTION).alias("delivery"), flag(CREDENTIAL_ACTION).alias("credentials"))
    place = F.row_number().over(Window.partitionBy("_host").orderBy("us", "event_id"))
    pair = F.concat(F.coalesce(F.nullif("parent_process", F.lit("")), F.lit("?")), F.lit(" -> "), "process")
    first = endpoint.where(F.length("process") > 0).withColumn("_n", place).where(F.col("_n") <= QUOTED_PAIRS).groupBy("_host").agg(F.array_sort(F.collect_list(F.struct("_n", pair.alias("p"))))["p"].alias("lineage"))
    moved = movements.select("chain_key").distinct().withColumn("_moved", F.lit(True))
    out = chains.select("chain_key", F.upper("host").alias("_host")).join(shown, "_host", "left").join(first, "_host", "left")
    out = out.join(trace.select("chain_key", F.col("remote_successes").alias("_remote")), "chain_key", "left").join(moved, "chain_key", "left")
    holds = {c: F.coalesce(c, F.lit(False)) for c in ("delivery", "execution", "credentials")}
    out = out.withColumns(holds)
    ran = F.col("execution")
    label = F.when(~ran, "rejected").when(F.col("_moved").isNotNull(), "confirmed").when(F.col("_remote") > 0, "partial").otherwise("contained")
    # The confidence of each label.
    confidence = F.when(~ran, 0.3).when(F.col("_moved").isNotNull(), F.when(F.col("credentials"), 0.88).otherwise(0.74)).when(F.col("_remote") > 0, 0.6).otherwise(0.55)
    return out.select("chain_key", *holds, label.alias("label"), confidence.alias("confidence"), F.coalesce("lineage", F.array().cast("array<string>")).alias("lineage"))


def tactic_name(tactic: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TACTIC_NAMES.items() for x in kv]), tactic), tactic)


def root_cause(rows: DataFrame, stages: DataFrame, chains: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """AGG-36: where each chain began, its stages in order, where it stands and where it may go.

    ``notes`` say how far each part is known: stages are observed, the grouping
    correlated, movements inferred, the next target predicted.
    """
    first = rows.groupBy("chain_key").agg(F.min_by(F.struct("event_id", C.primary_host().alias("host"), "user", C.event_summary().alias("summary")), F.struct(C.micros().alias("t"), "event_id")).alias("f"))
    step = F.concat(tactic_name(F.col("tactic")), F.lit(" on "), F.coalesce("host", F.lit("unknown host")))
    path = stages.groupBy("chain_key").agg(F.array_sort(F.collect_list(F.struct("stage", step.alias("text"))))["text"].alias("progression"))
    out = chains.join(first, "chain_key").join(path, "chain_key", "left")
    if targets is None:
        out = out.withColumn("_next", F.lit(None).cast("string"))
    else:
        out = out.join(targets.where("rank = 1").select("chain_key", F.col("host").alias("_next")), "chain_key", "left")
    status = F.concat(tactic_name(F.col("current_tactic")), F.lit(" in progress on "), F.coalesce("current_host", F.lit("an unknown host")))
    notes = F.array_compact(F.array(F.lit("observed: stages"), F.lit("correlated: grouping"), F.when(F.col("lateral_count") > 0, F.lit("inferred: movement")), F.when(F.col("_next").isNotNull(), F.concat(F.lit("predicted: "), "_next"))))
    return out.select("chain_key", F.col("f.event_id").alias("initial_event_id"), F.col("f.host").alias("initial_host"), F.col("f.user").alias("initial_user"), F.col("f.summary").alias("initial_evidence"), F.coalesce("progression", F.array().cast("array<string>")).alias("progression"), status.alias("current_status"), F.col("_next").alias("next_target"), notes.alias("notes"))


def target_confidence(targets: DataFrame, chains: DataFrame, reachable: DataFrame, users: DataFrame) -> DataFrame:
    """AGG-37: the confidence of each chain's first target: its score, halved without a path, less where the account is not entitled.

    ``chains`` has chain_key and user, which may be null, ``reachable``
    (chain_key, host).
    """
    top = targets.where("rank = 1").select("chain_key", "host", "score")
    path = reachable.select("chain_key", F.upper("host").alias("host")).distinct().withColumn("_path", F.lit(True))
    entitled = users.select(F.lower("name").alias("user"), F.explode("accessible_hosts").alias("_h")).select("user", F.upper("_h").alias("host")).distinct().withColumn("_entitled", F.lit(True))
    out = top.join(chains.select("chain_key", F.lower("user").alias("user")), "chain_key").join(path, ["chain_key", "host"], "left").join(entitled, ["user", "host"], "left")
    no_path, not_entitled = F.col("_path").isNull(), (F.length("user") > 0) & F.col("_entitled").isNull()
    not_entitled = F.coalesce(not_entitled, F.lit(False))
    # What a failed check leaves.
    factor = F.when(no_path, 0.5).otherwise(1.0) * F.when(not_entitled, 0.7).otherwise(1.0)
    caveats = F.array_compact(F.array(F.when(no_path, F.lit("no path")), F.when(not_entitled, F.lit("account not entitled"))))
    return out.select("chain_key", "host", "score", F.round(F.col("score") / 100 * factor, 4).alias("confidence"), caveats.alias("caveats"))
