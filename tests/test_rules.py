"""Rule trees, the rule index and the search of many patterns."""

import ipaddress
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from socspark.functions import columns as C
from socspark.operators import correlate, search, sigma
from socspark.operators.components import connected_components
from socspark.plans import rule_queries
from socspark.plans.config import CorrelationConfig
from socspark.plans.schemas import EVENT_SCHEMA
from tests.test_core import event

RAW = [None, "", "not json", "[1]", '{"CommandLine":"cmd /c Foo*bar","n":-5,"x":"-"}', '{"commandline":"a -Enc \\"q\\" ü","N":3.5,"Ok":true,"o":{"p":"Deep"}}', '{"n":"12","Empty":"","ip":"10.1.2.3","Image":"C:\\\\x\\\\PowerShell.exe"}', '{"n":"x","list":[1,"two"],"nothing":null}']
DETECTIONS = [
    {"s": {"CommandLine|contains": "-enc"}, "condition": "s"},
    {"s": {"CommandLine|contains|cased": "-enc"}, "condition": "s"},
    {"s": {"CommandLine|contains|windash": " -c "}, "condition": "s"},
    {"s": {"CommandLine": "cmd*foo\\*b?r"}, "condition": "s"},
    {"s": {"Image|endswith": ["\\powershell.exe", "\\b.exe"]}, "f": {"CommandLine": None}, "condition": "s and not f"},
    {"a1": {"Image": "*\\a.exe"}, "a2": {"Image": "*\\b.exe"}, "condition": "1 of a*"},
    {"a1": {"n|lt": 0}, "a2": {"n|gte": 3.5}, "condition": "any of them"},
    {"a1": {"n|gt": -6}, "_b": {"n|lte": 3}, "condition": "all of them"},
    {"s": {"n": 12}, "condition": "s"},
    {"s": {"ok": True}, "condition": "s"},
    {"s": {"o.p": "deep"}, "condition": "s"},
    {"s": {"ip|cidr": "10.0.0.0/8"}, "condition": "s"},
    {"s": {"x|exists": True}, "condition": "s"},
    {"s": {"x|exists": False}, "t": {"Empty|exists": False}, "condition": "not (s and t)"},
    {"s": ["deep", "foo*"], "condition": "s"},
    {"s": "commandline", "condition": "s"},
    {"s": {"commandLINE|re": "^a .*q"}, "condition": "s"},
    {"s": {"commandLINE|re|cased": "enc"}, "condition": "s"},
    {"s": [{"n": "x"}, {"user": "ann", "n|exists": False}], "condition": "s"},
    {"s": {"CommandLine|contains|all": ["-enc", "q"]}, "condition": "s"},
    {"s": {"list|contains": "two"}, "condition": "s"},
    {"s": {}, "t": {"user": "ann"}, "condition": "s and not t or t and not s"},
    {"s": {"Computer": "host-a"}, "condition": "NOT s"},
    {"s": {"QueryName|startswith": ["evil", "bad"]}, "condition": "(s)"},
]


def awkward(spark):
    rows = [event(100 + i, i, "PROCESS_CREATE", event_type="endpoint", raw=raw, user=user, process=process, command_line=line, domain=domain, destination_host="HOST-A" if i % 2 else None) for i, (raw, (user, process, line, domain)) in enumerate(itertools.product(RAW, [("ann", "a.exe", "a -Enc x", None), ("bob", None, None, "evil.example"), (None, "b.exe", "run /c x", "")]))]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def test_columns_and_index_agree(spark):
    rules = [sigma.compile_sigma({"id": f"t{i:02}", "level": "high", "detection": d}) for i, d in enumerate(DETECTIONS)]
    events = awkward(spark)
    tags = lambda most: {r.event_id: [t for t in r.tags if t.startswith("sigma:")] for r in sigma.match_sigma(events, rules, most).collect()}
    columns, indexed = tags(100), tags(0)
    assert columns == indexed
    counts = [sum(f"sigma:t{i:02}" in x for x in columns.values()) for i in range(len(rules))]
    assert counts[9] > 0 and 0 < counts[0] and counts[1] < counts[0] and all(c < len(columns) for c in counts)
    assert counts[15] == 0  # a field's name is no keyword
    assert counts[6] > 0 and counts[7] > 0


@pytest.mark.parametrize(
    ("condition", "want"),
    [("a or b and c", lambda a, b, c: a or b and c), ("not a and b", lambda a, b, c: not a and b), ("not (a or b) or c", lambda a, b, c: not (a or b) or c), ("a and (b or not c)", lambda a, b, c: a and (b or not c)), ("not not a", lambda a, b, c: a), ("all of them or 1 of (b)", None)],
)
def test_conditions_bind_as_specified(condition, want):
    trees = {n: sigma.Words((n * 3,)) for n in "abc"}
    if want is None:
        with pytest.raises(sigma.UnsupportedRule):
            sigma.read_condition(condition, trees)
        return
    tree = sigma.read_condition(condition, trees)
    for holds in itertools.product([False, True], repeat=3):
        record = sigma.Record({"raw": None, "command_line": " ".join(n * 3 for n, h in zip("abc", holds, strict=True) if h)})
        assert sigma.tree_holds(tree, record) == want(*holds)


@pytest.mark.parametrize("bad", ["sel*", "a b", "a and", "(a", "a)", "or a", "a | count() > 3", "other", "1 of x*", "not", ""])
def test_conditions_that_are_refused(bad):
    with pytest.raises(sigma.UnsupportedRule):
        sigma.read_condition(bad, {"a": sigma.Words(("x",)), "sel1": sigma.Words(("y",))})


def test_the_texts_that_a_rule_needs():
    needs = lambda d: sigma.needed(sigma.compile_sigma({"detection": d}).tree)
    assert needs({"s": {"Image|endswith": "\\Power*Shell.exe", "n|gt": 1}, "condition": "s"}) == {"shell.exe"}
    assert needs({"s": {"a": ["one", "three"]}, "t": {"b": "four"}, "condition": "s and t"}) == {"four"}
    assert needs({"s": {"a": ["one", "three"]}, "t": {"b": "four"}, "condition": "s or t"}) == {"one", "three", "four"}
    assert needs({"s": {"a": ["one", "x"]}, "condition": "s"}) is None and needs({"s": {"a": "one"}, "condition": "not s"}) is None


def test_the_plan_does_not_grow_with_the_rules(spark, sf_dir):
    events = rule_queries.raw_events(spark, sf_dir)
    size = lambda n: len(sigma.match_sigma(events, [sigma.compile_sigma(r) for r in rule_queries.generated_rules(n)])._jdf.queryExecution().toString())
    assert abs(size(100) - size(3000)) < 200


def test_occurrences_against_a_plain_search(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcü") for _ in range(n))
    texts = [(i, word(rng.randrange(40))) for i in range(300)] + [(300, None), (301, ""), (301, "abc"), (301, "abc")]
    patterns = [(word(rng.randrange(1, 5)),) for _ in range(200)] + [(None,), ("",), ("abc",), ("a" * 50,)]
    want = sorted((i, p) for i, t in texts for p in {p for (p,) in patterns if p} if t and p in t)
    frames = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(patterns, "p string")
    for shard_bytes in (1 << 20, 1000):
        assert sorted(tuple(r) for r in search.occurrences(frames[0], "text", frames[1], "p", shard_bytes).collect()) == want
    assert search.occurrences(frames[0], "text", frames[1].limit(0), "p").count() == 0


def test_search_does_not_slow_down_with_the_patterns(spark):
    lines = spark.range(20_000).select("id", F.concat(F.lit("get http://host"), F.col("id").cast("string"), F.lit(".example/x and more words of a line")).alias("text"))
    seconds = {}
    for n in (10, 200_000):
        patterns = spark.range(n).select(F.concat(F.lit("http://host"), F.col("id").cast("string"), F.lit(".example/")).alias("p"))
        began = time.perf_counter()
        assert search.occurrences(lines, "text", patterns, "p").count() == min(n, 20_000)
        seconds[n] = time.perf_counter() - began
    assert seconds[200_000] < seconds[10] + 20


def test_addresses_of_both_families(spark):
    rng = random.Random(2)
    texts = ["::", "::1", ":::", "1::2::3", "fe80::1%eth0", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1:2", "", None, "10.1.2.3", "256.1.1.1", "1::1.2.3.4", "::1.2.3", "2001:DB8::A", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4"]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & (rng.getrandbits(128) if i % 2 else -1))) for i in range(200)]
    nets = ["::/0", "2000::/3", "fe80::/10", "::ffff:0:0/96", "2001:db8::/33", "::1/128", "10.0.0.0/8", "2::/15"]

    def address(text):
        try:
            return ipaddress.ip_address(text.split("%")[0])
        except (ValueError, AttributeError):
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.coalesce(C.is_ip(F.col("t")), F.lit(False)).alias("ip"), F.array(*[C.ip_in_cidr(F.col("t"), n) for n in nets]).alias("within")).collect()
    for r in rows:
        a = address(r.t)
        assert r.ip == (a is not None), r.t
        assert r.within == [a is not None and a.version == ipaddress.ip_network(n).version and a in ipaddress.ip_network(n) for n in nets], r.t


def parts_of(links):
    return {r.node: r.component for r in connected_components(links.select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"))).collect()}


def test_few_links_connect_what_all_links_connect(spark):
    rng = random.Random(3)
    rows = [event(i, rng.randrange(9000), rng.choice(["RDP_LOGIN", "POWERSHELL_EXEC", "SUSPICIOUS_DOMAIN"]), user=rng.choice([None, "ann", "bob", "cid", "dan"]), source_host=rng.choice("ABCDEFGH"), destination_host=rng.choice([None, *"ABCDEFGH"]), source_ip=rng.choice([None, "10.0.0.1", "10.0.0.2"]), process=rng.choice([None, "x.exe"]), domain=rng.choice([None, "d.example"]), suspicious=rng.random() < 0.3) for i in range(400)]
    for n in (40, 400):
        events = spark.createDataFrame(rows[:n], EVENT_SCHEMA)
        few, every = correlate.connecting_links(events), correlate.correlate_pairs(events)
        assert parts_of(few) == parts_of(every) and few.count() <= every.count()


def test_few_links_of_one_busy_host(spark):
    n = 5_000
    base = spark.createDataFrame([event(0, 0, "POWERSHELL_EXEC", event_type="endpoint", source_host="HUB", destination_host="HUB", suspicious=True)], EVENT_SCHEMA)
    number = F.col("n")
    events = base.join(spark.range(n).withColumnRenamed("id", "n")).withColumns({"event_id": F.concat(F.lit("e"), number.cast("string")), "timestamp": F.timestamp_seconds(F.unix_seconds("timestamp") + number), "user": F.concat(F.lit("u"), (number % 50).cast("string"))}).select(*EVENT_SCHEMA.fieldNames())
    links = correlate.connecting_links(events)
    assert len(set(parts_of(links).values())) == 1 and links.count() < 20 * n  # all pairs within six minutes would be 1.8 million


def test_pairs_are_scored_where_they_meet(spark, monkeypatch):
    rng = random.Random(11)
    host = lambda: rng.choice([None, "", *"ABC"])
    rows = [event(i, rng.randrange(20_000), rng.choice(["RDP_LOGIN", "POWERSHELL_EXEC"]), user=rng.choice([None, "ann", "bob"]), source_host=host(), destination_host=host(), source_ip=rng.choice([None, "10.0.0.1", "10.0.0.2"]), destination_ip=rng.choice([None, "10.0.0.1"]), process=rng.choice([None, "x.exe"]), domain=rng.choice([None, "d.example"]), suspicious=rng.random() < 0.5) for i in range(500)]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    monkeypatch.setattr(correlate._pieces, "__defaults__", (70,))
    found, few = correlate.correlate_pairs(events), correlate.connecting_links(events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1
    sides = [r.s for r in correlate._sides(events.where(C.is_notable())).select(F.struct("*").alias("s")).collect()]
    pairs = [(a, b) for a in sides for b in sides if (a._us, a.event_id) < (b._us, b.event_id) and b._us - a._us <= 1_800_000_000 and ((a.user and a.user == b.user) or (a.domain and a.domain == b.domain) or set(a.hosts) & set(b.hosts) or set(a.ips) & set(b.ips))]
    score, factors = correlate.score_pair()
    side = correlate._sides(events).schema.simpleString()
    given = spark.createDataFrame(pairs, f"a {side}, b {side}").select("a.event_id", F.col("b.event_id").alias("other"), F.round(score, 4).alias("score"), factors.alias("factors"), score.alias("raw")).where("raw >= 0.7").drop("raw")
    want = {(r[0], r[1]): (r.score, tuple(f.name for f in r.factors)) for r in given.collect()}
    rows = found.collect()
    assert {(r[0], r[1]): (r.score, tuple(f.name for f in r.factors)) for r in rows} == want and len(rows) == len(want) > 1000
    assert parts_of(few) == parts_of(found) and few.count() < len(rows) / 4


def test_counts_of_all_links_come_with_the_connecting_ones(spark, monkeypatch):
    """one shuffle for both, only of keys that can link, and of columns of which none is a copy."""
    rng = random.Random(5)
    host = lambda: rng.choice([None, *"ABC"])
    # Steps of 0.36 s give scores that end in half a ten-thousandth.
    rows = [event(i, 0, "RDP_LOGIN", user=rng.choice([None, "ann", "bob"]), source_host=host(), destination_host=host(), source_ip=rng.choice([None, "10.0.0.1", "10.0.0.2"]), domain=rng.choice([None, "a.xyz"]), suspicious=rng.random() < 0.5) for i in range(300)]
    events = spark.createDataFrame(rows, EVENT_SCHEMA).withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + F.xxhash64("event_id") % 20_000 * 360_000))
    monkeypatch.setattr(correlate._pieces, "__defaults__", (70,))
    found, every = correlate.connecting_totals(events), correlate.correlate_pairs(events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    # An address or a domain alone is no link, whatever else is shared without account and host.
    assert correlate.linking_kinds(CorrelationConfig()) == ["host", "user"] and correlate.linking_kinds(CorrelationConfig(min_score=0.5)) == ["host", "user", "ip"]
    keyed = correlate._keyed(correlate._by_key(events), ["host", "user"], CorrelationConfig())
    assert "value" not in keyed.columns and {r.slot for r in keyed.select("slot").distinct().collect()} == {0, 1, 4}
    part = parts_of(found)
    assert part == parts_of(every)
    want, got = {}, {}
    for r in every.collect():
        n, total = want.get(part[r.source_event_id], (0, 0))
        want[part[r.source_event_id]] = n + 1, total + round(r.score * 10_000)
    for r in found.where("link_count > 0").collect():
        n, total = got.get(part[r.source_event_id], (0, 0))
        got[part[r.source_event_id]] = n + r.link_count, total + r.score_sum
    assert got == want and sum(n for n, _ in got.values()) > 1000
    assert correlate._rounded(np.array([0.77345, 0.77355, 0.774449999, 1.0])).tolist() == [7735, 7736, 7744, 10_000]
    raw = spark.createDataFrame([(0.7 + i * 1e-4 + 5e-5,) for i in range(2000)], "x double").select("x", F.round("x", 4).alias("y")).collect()
    assert correlate._rounded(np.array([r.x for r in raw])).tolist() == [round(r.y * 10_000) for r in raw]


def test_rules_of_equal_fields_are_looked_up_and_equal_trees_checked_once(monkeypatch):
    held = []
    monkeypatch.setattr(sigma, "tree_holds", lambda tree, record, holds=sigma.tree_holds: held.append(tree) or holds(tree, record))
    rules = [sigma.compile_sigma({"id": f"n{i}", "detection": {"s": {"User": "USER7", "ProcessId|cased": str(i)}, "condition": "1 of s"}}) for i in range(500)]
    rules += [sigma.compile_sigma({"id": f"w{i}", "detection": {"words": ["net group"], "condition": "words"}}) for i in range(500)]
    row = dict.fromkeys(sigma.READ) | {"raw": '{"processid":42}', "user": "User7", "command_line": "NET group", "_sources": [], "_primary": None}
    assert [rules[i].id for i in sigma.RuleIndex(rules).hits(row)] == ["n42", *(f"w{i}" for i in range(500))]
    assert len([t for t in held if isinstance(t, sigma.Words)]) == 1 and len(held) < 10
