"""Event pairs: scores, exact and bounded correlation, lateral movement."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from socspark.functions import columns as C
from socspark.plans.config import CorrelationConfig, LateralConfig

_SIDE = ["event_id", "_us", "user", "hosts", "ips", "process", "domain", "suspicious", "primary", "source_host", "destination_host"]


def _sides(events: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    return events.select(*carried, "event_id", C.micros().alias("_us"), F.nullif("user", F.lit("")).alias("user"), C.hosts().alias("hosts"), C.ips().alias("ips"), F.lower(F.nullif("process", F.lit(""))).alias("process"), F.nullif("domain", F.lit("")).alias("domain"), F.coalesce("suspicious", F.lit(False)).alias("suspicious"), C.primary_host().alias("primary"), F.nullif("source_host", F.lit("")).alias("source_host"), F.nullif("destination_host", F.lit("")).alias("destination_host"))


def _has(array: Column, value: Column) -> Column:
    """Whether ``value`` is in ``array``, a set of two columns and so of two items at most."""
    return F.coalesce(F.get(array, 0) == value, F.lit(False)) | F.coalesce(F.get(array, 1) == value, F.lit(False))


def _meet(x: Column, y: Column) -> Column:
    return _has(y, F.get(x, 0)) | _has(y, F.get(x, 1))


def score_pair(config: CorrelationConfig = CorrelationConfig()) -> tuple[Column, Column]:
    """FN-20: (score before rounding or null, factors) of struct columns a and b, a being the earlier."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    same = lambda n: F.coalesce(a(n) == b(n), F.lit(False))
    shared = _meet(a("hosts"), b("hosts"))
    pivot = F.coalesce((b("source_host") == a("primary")) & (b("destination_host") != b("source_host")), F.lit(False))
    parts = [
        ("same_user", same("user"), config.same_user),
        ("same_host", shared, config.same_host),
        ("host_pivot", pivot, config.host_pivot),
        ("shared_ip", _meet(a("ips"), b("ips")), config.shared_ip),
        ("process_continuity", same("process") & shared, config.process_host),
        ("domain_overlap", same("domain"), config.domain_overlap),
        ("suspicious_coincidence", shared & a("suspicious") & b("suspicious"), config.suspicious_coincidence),
    ]
    substantive = F.lit(0.0)
    for _, holds, weight in parts:
        substantive = substantive + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    seconds = (b("_us") - a("_us")) / 1e6
    near = config.time_proximity * (1.0 - seconds / config.window_seconds)
    factors = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))) for name, holds, weight in parts]))
    return F.when(substantive > 0, F.least(F.lit(1.0), substantive + near)), factors


#: The columns under whose values events meet, with their kinds, and the numbers of the kinds.
_SLOTS = (("host", "source_host"), ("host", "destination_host"), ("ip", "ip_0"), ("ip", "ip_1"), ("user", "user"), ("domain", "domain"))
_NUMBERS = {"host": 0, "ip": 1, "user": 2, "domain": 3}


def _by_key(events: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Notable events as `_pairing` reads them, once each."""
    return _sides(events.where(C.is_notable()), carried).withColumns({"ip_0": F.get("ips", F.lit(0)), "ip_1": F.get("ips", F.lit(1))}).drop("hosts", "ips", "primary")


def _keyed(rows: DataFrame, kinds: list[str], config: CorrelationConfig) -> DataFrame:
    """A row for each event, column of a key (``slot``) and bin; a bin has eight windows and the window before."""
    width = config.window_seconds * 1_000_000
    bins = F.sequence(F.floor(F.col("_us") / (8 * width)), F.floor((F.col("_us") + width) / (8 * width)))
    other = {"destination_host": ~F.col("destination_host").eqNullSafe(F.col("source_host"))}
    slots = [F.when(F.col(c).isNotNull() & other.get(c, F.lit(True)), F.lit(slot)) for slot, (kind, c) in enumerate(_SLOTS) if kind in kinds]
    return rows.select(*rows.columns, F.explode(F.array_compact(F.array(*slots).cast("array<int>"))).alias("slot")).select("*", F.explode(bins).alias("bin"))


def _slot_key() -> dict[str, Column]:
    """The kind and value that a row of `_keyed` stands for."""
    kind, value = F, F
    for slot, (name, c) in enumerate(_SLOTS):
        kind, value = kind.when(F.col("slot") == slot, F.lit(_NUMBERS[name]).cast("long")), value.when(F.col("slot") == slot, F.col(c))
    return {"kind": kind, "value": value}


def _placed(rows: DataFrame, kinds: list[str], config: CorrelationConfig) -> DataFrame:
    """The rows of `_keyed`, dealt by key and bin and in order of time; the key, a column's value, is not shuffled beside that column."""
    key = _slot_key()
    keyed = _keyed(rows, kinds, config).repartition(key["kind"], key["value"], "bin")
    return keyed.withColumns(key).drop("slot").sortWithinPartitions("kind", "value", "bin", "_us", "event_id")


def _told(found: DataFrame, config: CorrelationConfig, carried: tuple[str, ...] = ()) -> DataFrame:
    """What `_pairing` finds, as links."""
    weights = [(name, weight, F.col("_held").bitwiseAND(1 << place) != 0) for place, (name, weight) in enumerate(_factors(config))]
    factors = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))) for name, weight, holds in weights]))
    return found.select("source_event_id", "target_event_id", F.col("_score").alias("score"), (F.col("_near") / 1e6).alias("time_delta_seconds"), factors.alias("factors"), *carried)


#: What a pair found in a task has; its score is rounded there.
_FOUND = [T.StructField(n, T.StringType()) for n in ("source_event_id", "target_event_id")] + [T.StructField("_score", T.DoubleType()), T.StructField("_near", T.LongType()), T.StructField("_held", T.LongType())]


def _met(events: DataFrame, config: CorrelationConfig, carried: tuple[str, ...] = (), nearest: int | None = None) -> DataFrame:
    """Scored pairs of notable events under each key, where they meet: each pair once, or only the ``nearest`` of each key and so perhaps more than once."""
    rows = _by_key(events, carried)
    fields = [*_FOUND, *[rows.schema[c] for c in carried]]
    placed = _placed(rows, linking_kinds(config) if nearest is None else list(_KINDS), config)
    return _told(placed.mapInArrow(_pieces(_pairing(config, carried, nearest), config), T.StructType(fields)), config, carried)


def correlate_pairs(events: DataFrame, config: CorrelationConfig = CorrelationConfig(), carried: tuple[str, ...] = ()) -> DataFrame:
    """JOIN-10: every ordered pair of notable events that share a key inside the window and score enough.

    Events meet by key in bins of time, under those kinds of keys that can make a link. A pair counts under the first key of the earlier event that
    it shares, so it is scored where it meets: events are shuffled, pairs never.
    ``carried`` columns of the earlier event go with each pair.
    """
    return _met(events, config, carried)


def _factors(config: CorrelationConfig) -> list[tuple[str, float]]:
    """Factors of ``score_pair`` in their order, in which weights add up."""
    return [("same_user", config.same_user), ("same_host", config.same_host), ("host_pivot", config.host_pivot), ("shared_ip", config.shared_ip), ("process_continuity", config.process_host), ("domain_overlap", config.domain_overlap), ("suspicious_coincidence", config.suspicious_coincidence)]


def _weighing(rows: pa.RecordBatch, config: CorrelationConfig):
    """Function that compares rows by their places (earlier, later), with the arithmetic of ``score_pair``: (score, distance, factors as bits, whether two events like them link, whether they meet first here); and a number of each row's event."""
    us, kind = rows["_us"].to_numpy(), rows["kind"].to_numpy()
    user, process, domain = (_codes(rows[n]) for n in ("user", "process", "domain"))
    (source, target, value), (ip_0, ip_1, ip_value) = _shared_codes(rows["source_host"], rows["destination_host"], rows["value"]), _shared_codes(rows["ip_0"], rows["ip_1"], rows["value"])
    odd = rows["suspicious"].to_numpy(zero_copy_only=False)
    primary, leaves = np.where(target >= 0, target, source), np.where((source >= 0) & (target >= 0) & (source != target), source, -2)
    other = lambda x: np.where(x < 0, -2, x)
    user_b, process_b, domain_b, source_b, target_b, ip_0b, ip_1b = map(other, (user, process, domain, source, target, ip_0, ip_1))
    ids = rows["event_id"]
    again = np.r_[False, (us[1:] == us[:-1]) & pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)] if len(us) > 1 else np.zeros(len(us), bool)
    event = np.cumsum(~again)

    def weigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        in_b = lambda x, y, z: (x == y[b]) | (x == z[b])
        host_0, address_0 = in_b(source[a], source_b, target_b), in_b(ip_0[a], ip_0b, ip_1b)
        host, address, account = host_0 | in_b(target[a], source_b, target_b), address_0 | in_b(ip_1[a], ip_0b, ip_1b), user[a] == user_b[b]
        holds = [account, host, leaves[b] == primary[a], address, host & (process[a] == process_b[b]), domain[a] == domain_b[b], host & odd[a] & odd[b]]
        weight, mask = np.zeros(len(a)), np.zeros(len(a), np.int64)
        for bit, (true, (_, points)) in enumerate(zip(holds, _factors(config), strict=True)):
            weight += np.where(true, points, 0.0)
            mask |= true.astype(np.int64) << bit
        near = us[b] - us[a]
        score = np.minimum(1.0, weight + config.time_proximity * (1.0 - (near / 1e6) / config.window_seconds))
        linked = (weight > 0) & (score >= config.min_score)
        # In the order of _KINDS, and of a kind with two values under the earlier event's first.
        of = kind[b]
        first = np.select([of == _NUMBERS["host"], of == _NUMBERS["user"], of == _NUMBERS["ip"]], [(value[b] == source[a]) | ~host_0, ~host, ~host & ~account & ((ip_value[b] == ip_0[a]) | ~address_0)], ~host & ~account & ~address)
        return score, near, mask, linked, first

    return weigh, event


def _spread(start: np.ndarray, count: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, number) for the ``count`` numbers from ``start`` on of each place; at most ``at_once`` and a place's at a time."""
    ends, low = np.cumsum(count), 0
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + at_once, "right")))
        n = count[low:high]
        place = np.repeat(np.arange(low, high), n)
        number = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[low:high], n)
        low = high
        if len(place):
            yield place, number


def _candidates(rows: pa.RecordBatch, group: np.ndarray, held: int, config: CorrelationConfig, nearest: int, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (earlier, later) of each row and the ``nearest`` before it inside the window in its group; at most ``at_once`` and a row's at a time."""
    width, us, place = config.window_seconds * 1_000_000, rows["_us"].to_numpy(), np.arange(rows.num_rows)
    # First row of each row's group and window: times counted from the least, so that group and time are one number.
    span = int(us.max() - us.min()) + width + 1
    line = group * span + (us - us.min())
    start = np.maximum(np.searchsorted(line, np.maximum(line - width, group * span)), place - nearest)
    for b, a in _spread(start, np.where(_mine(rows, held, config), place - start, 0), at_once):
        yield a, b


#: What scoring reads of an event beside its time.
_SCORED = ("user", "process", "domain", "source_host", "destination_host", "ip_0", "ip_1", "suspicious")


def _mine(rows: pa.RecordBatch, held: int, config: CorrelationConfig) -> np.ndarray:
    """Which rows pair here with earlier ones: those of the bin itself that were not there before."""
    return (np.arange(rows.num_rows) >= held) & (rows["_us"].to_numpy() // (8 * config.window_seconds * 1_000_000) == rows["bin"].to_numpy())


def _units(rows: pa.RecordBatch, group: np.ndarray, config: CorrelationConfig) -> tuple[np.ndarray, ...]:
    """Events that are alike, of one group and time and equal in all that scoring reads, as units.

    Each row's unit; the first row of each unit; each row's run, that is, its group and time; the first unit of each run, and
    after them the number of units; and the first unit in the window of each unit. Units come by run, and so by group and time.
    """
    width, us = config.window_seconds * 1_000_000, rows["_us"].to_numpy()
    run = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (us[1:] != us[:-1])])
    code = run
    for name in _SCORED:
        values = _codes(rows[name]) + 1
        code = code * (values.max() + 1) + values
        code = np.unique(code, return_inverse=True)[1] if code.max() > 1 << 40 else code
    _, one, unit = np.unique(code, return_index=True, return_inverse=True)
    first = np.searchsorted(run[one], np.arange(run[-1] + 2))
    span = int(us.max() - us.min()) + width + 1
    line = group[one] * span + (us[one] - us.min())
    return unit, one, run, first, np.searchsorted(line, np.maximum(line - width, group[one] * span))


def _alike(rows: pa.RecordBatch, group: np.ndarray, held: int, event: np.ndarray, config: CorrelationConfig, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As `_candidates`, but one pair (earlier, later, how many) for all pairs of events that are alike: of one time, and equal in all that scoring reads.

    So events that repeat, as copies and logs with coarse times have them, are scored once, and counted as often as they pair.
    """
    n, mine = rows.num_rows, _mine(rows, held, config)
    unit, one, run, first, start = _units(rows, group, config)
    every, fresh, of = np.bincount(unit, minlength=len(one)), np.bincount(unit[mine], minlength=len(one)), run[one]
    alone = np.r_[True, run[1:] != run[:-1]]
    if len(one) < n or len(first) <= len(one):
        # Of one time the smaller id is the earlier event, and an event does not pair with itself.
        same = np.maximum.accumulate(np.where(alone | np.r_[True, event[1:] != event[:-1]], np.arange(n), 0))
        begin = np.flatnonzero(alone)[run]
        ranks, later = unit - first[run], np.flatnonzero(mine)
        for r in range(ranks.max() + 1):
            before = np.r_[0, np.cumsum(ranks == r)]
            times = np.bincount(unit[later], before[same[later]] - before[begin[later]], len(one)).astype(np.int64)
            b = np.flatnonzero(times)
            if len(b):
                yield one[first[of[b]] + r], one[b], times[b]
    for b, a in _spread(start, np.where(fresh > 0, first[of] - start, 0), at_once):
        yield one[a], one[b], every[a] * fresh[b]


def _expanded(rows: pa.RecordBatch, group: np.ndarray, held: int, event: np.ndarray, weigh, config: CorrelationConfig, fresh: np.ndarray | None = None, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(earlier, later, score, distance, factors) of the pairs that link and meet first here: alike pairs are scored once, and then each of them is told.

    With ``fresh``, a flag for each row, only pairs of which an event is fresh.
    """
    mine, place = _mine(rows, held, config), np.arange(rows.num_rows)
    unit, one, run, first, start = _units(rows, group, config)
    members, size = np.argsort(unit, kind="stable"), np.bincount(unit, minlength=len(one))
    at = np.cumsum(size) - size
    end = first[run[one] + 1]
    new = None if fresh is None else np.bincount(unit[fresh], minlength=len(one)) > 0
    for b, a in _spread(start, np.where(np.bincount(unit[mine], minlength=len(one)) > 0, end - start, 0), at_once):
        if new is not None:
            a, b = a[new[a] | new[b]], b[new[a] | new[b]]
        score, near, mask, keep, here = weigh(one[a], one[b])
        keep &= here
        a, b, near, mask, score = a[keep], b[keep], near[keep], mask[keep], _rounded(score[keep]) / 10_000
        for pair, i in _spread(at[a], size[a], at_once):
            for which, j in _spread(at[b[pair]], size[b[pair]], at_once):
                of, earlier, later = pair[which], members[i[which]], members[j]
                # Of one time the smaller id is the earlier event.
                told = mine[later] & (place[earlier] < place[later]) & (event[earlier] != event[later])
                if fresh is not None:
                    told &= fresh[earlier] | fresh[later]
                of = of[told]
                yield earlier[told], later[told], score[of], near[of], mask[of]


def _pairing(config: CorrelationConfig, carried: tuple[str, ...], nearest: int | None):
    """Arrow step: the pairs inside the window in each group that link.

    With ``fresh``, a flag for each row, only pairs of which an event is fresh.
    """

    def work(rows: pa.RecordBatch, group: np.ndarray, held: int, fresh: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        (weigh, event), ids = _weighing(rows, config), rows["event_id"]
        found = _expanded(rows, group, held, event, weigh, config, fresh) if nearest is None else among_nearest(rows, group, held, event, weigh)
        for a, b, score, near, mask in found:
            for at in range(0, len(a), 100_000):
                part = slice(at, at + 100_000)
                told = [ids.take(pa.array(a[part])), ids.take(pa.array(b[part])), pa.array(score[part]), pa.array(near[part]), pa.array(mask[part])]
                yield pa.RecordBatch.from_arrays([*told, *[rows[c].take(pa.array(a[part])) for c in carried]], ["source_event_id", "target_event_id", "_score", "_near", "_held", *carried])

    def among_nearest(rows: pa.RecordBatch, group: np.ndarray, held: int, event: np.ndarray, weigh) -> Iterator[tuple[np.ndarray, ...]]:
        for a, b in _candidates(rows, group, held, config, nearest):
            score, near, mask, keep, _ = weigh(a, b)
            keep &= event[a] != event[b]
            yield a[keep], b[keep], _rounded(score[keep]) / 10_000, near[keep], mask[keep]

    return work


def _shared_codes(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers of the values of columns that are compared with each other, -1 for null."""
    codes = _codes(pa.concat_arrays(columns))
    return np.split(codes, len(columns))


#: What two events can share, in the order in which scores add up, and what of it counts only with a host.
_SHARES = {"user": "same_user", "host": "same_host", "pivot": "host_pivot", "ip": "shared_ip", "process": "process_host", "domain": "domain_overlap", "odd": "suspicious_coincidence"}
#: The groups in which links are sought, and what counts in each beyond it; what also shares an earlier kind is met there.
_KINDS = {"host": ("user", "pivot", "ip", "process", "domain", "odd"), "user": ("ip", "domain"), "ip": ("domain",), "domain": ()}


def _enough(weight: float, seconds, config: CorrelationConfig):
    """Whether a pair of this weight links at this distance, in the arithmetic of ``score_pair``."""
    return np.minimum(1.0, weight + config.time_proximity * (1.0 - seconds / config.window_seconds)) >= config.min_score


def _patterns(kind: str, config: CorrelationConfig) -> list[tuple[tuple[str, ...], float]]:
    """What a pair must share beyond its kind to link at all, with its weight; nothing that a part of it decides at any distance."""
    found, full = [], []
    for n in range(len(_KINDS[kind]) + 1):
        for more in itertools.combinations(_KINDS[kind], n):
            if any(set(f) <= set(more) for f in full):
                continue
            weight = 0.0
            for name, field in _SHARES.items():
                weight += getattr(config, field) if name == kind or name in more else 0.0
            if weight > 0 and _enough(weight, 0.0, config):
                found.append((more, weight))
                if _enough(weight, float(config.window_seconds), config):
                    full.append(more)
    return found


def _forest(n: int, i: np.ndarray, j: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges that connect ``n`` nodes as all edges do, without a circle, and a node of each node's tree; ``given`` edges hold and are not returned."""
    label, chosen = np.arange(n), []
    for edges in (np.flatnonzero(given), np.flatnonzero(~given)):
        while True:
            a, b = label[i[edges]], label[j[edges]]
            live = a != b
            edges, a, b = edges[live], a[live], b[live]
            if not len(edges):
                break
            best = np.full(n, len(i))
            np.minimum.at(best, a, edges)
            np.minimum.at(best, b, edges)
            nodes = np.flatnonzero(best < len(i))
            pick = best[nodes]
            up = np.arange(n)
            up[nodes] = label[i[pick]] + label[j[pick]] - nodes
            turn = nodes[(up[up[nodes]] == nodes) & (nodes < up[nodes])]
            up[turn] = turn
            while (up[up] != up).any():
                up = up[up]
            label = up[label]
            if not given[pick[0]]:
                chosen.append(np.unique(pick))
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64), label


def _codes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _near_links(rows: pa.RecordBatch, group: np.ndarray, config: CorrelationConfig) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) rows, by place: neighbours in time within each pattern of each group; rows come by group and time."""
    us = rows["_us"].to_numpy()
    kinds = rows["kind"].to_numpy(zero_copy_only=False)
    part = {n: _codes(rows[n]) for n in ("user", "process", "domain")} | {"odd": np.where(rows["suspicious"].to_numpy(zero_copy_only=False), 0, -1)}
    addresses = np.concatenate(_shared_codes(rows["ip_0"], rows["ip_1"]))
    held_ip = np.flatnonzero(addresses >= 0)
    ip_row, ip_code = held_ip % len(us), addresses[held_ip]
    value, leaves, left = rows["value"], rows["source_host"], rows["destination_host"]
    true = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    first, second = true(pc.equal(pc.coalesce(left, leaves), value)), true(pc.and_kleene(pc.equal(leaves, value), pc.not_equal(left, leaves)))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(a: np.ndarray, b: np.ndarray, weight: float) -> None:
        near = us[b] - us[a]
        keep = (near <= config.window_seconds * 1_000_000) & _enough(weight, near / 1e6, config)
        out.append((a[keep], b[keep]))

    for kind in _KINDS:
        member = kinds == _NUMBERS[kind]
        for more, weight in _patterns(kind, config) if member.any() else ():
            at, code = (ip_row, ip_code) if "ip" in more else (np.arange(len(us)), np.zeros(len(us), np.int64))
            keep = member[at]
            if "pivot" in more:
                keep = keep & (first | second)[at]
            for name in more:
                if name in part:
                    keep = keep & (part[name][at] >= 0)
            at, code = at[keep], code[keep]
            for values in [group, *[part[n] for n in more if n in part]]:
                code = np.unique(code, return_inverse=True)[1] if len(code) and code.max() > 1 << 30 else code
                code = code * (values[at].max() + 1) + values[at] if len(at) else code
            order = np.lexsort((at, code))
            at, code = at[order], code[order]
            if not len(at):
                continue
            if "pivot" not in more:
                same = code[1:] == code[:-1]
                add(at[:-1][same], at[1:][same], weight)
                continue
            # Earlier sides reach the next later side; later sides the last earlier one and the last before the later sides that precede it.
            steps, start = np.arange(len(at)), np.maximum.accumulate(np.where(np.r_[True, code[1:] != code[:-1]], np.arange(len(at)), 0))
            from_, to = first[at], second[at]
            last = np.maximum.accumulate(np.where(from_, steps, -1))
            before = np.maximum.accumulate(np.where(to, steps, -1))
            after = np.minimum.accumulate(np.where(to, steps, len(at))[::-1])[::-1]
            a = steps[from_ & (after < len(at))]
            a = a[code[after[a]] == code[a]]
            add(at[a], at[after[a]], weight)
            b = steps[to & (last >= start)]
            add(at[last[b]], at[b], weight)
            turn = before[last[b]]
            b, turn = b[turn >= start[b]], turn[turn >= start[b]]
            earlier = last[turn]
            b, earlier = b[earlier >= start[b]], earlier[earlier >= start[b]]
            add(at[earlier], at[b], weight)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(us)
    code = np.unique(np.concatenate([a for a, _ in out]) * n + np.concatenate([b for _, b in out]))
    return code // n, code % n


def _pieces(work, config: CorrelationConfig, at_once: int = 50_000):
    """Arrow function that hands rows by group and time to ``work`` in pieces, as (rows, number of each row's group, how many rows were there before).

    Of a group that goes on, the last window's rows come again with the next piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        held = size = 0

        def piece() -> Iterator[pa.RecordBatch]:
            nonlocal kept, waiting, held, size
            rows = pa.Table.from_batches(kept + waiting).combine_chunks().to_batches()[0]
            value, bin_, kind, us = _codes(rows["value"]), rows["bin"].to_numpy(), rows["kind"].to_numpy(), rows["_us"].to_numpy()
            group = np.cumsum(np.r_[False, (value[1:] != value[:-1]) | (bin_[1:] != bin_[:-1]) | (kind[1:] != kind[:-1])])
            yield from work(rows, group, held)
            rest = np.flatnonzero((group == group[-1]) & (us >= us[-1] - config.window_seconds * 1_000_000))
            kept, waiting, held, size = [rows.take(pa.array(rest))], [], len(rest), 0

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= max(at_once, 2 * held):
                yield from piece()
        if waiting:
            yield from piece()

    return run


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores in ten-thousandths, halves of their decimal text up, as SQL rounds them."""
    scaled = score * 10_000 + 0.5
    out = np.floor(scaled).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.rint(scaled)) < 1e-6):
        out[i] = int((Decimal(repr(float(score[i]))) * 10_000).to_integral_value(ROUND_HALF_UP))
    return out


def _spanning(config: CorrelationConfig, counted: bool):
    """Arrow step: links that connect each group's events; if ``counted``, after them how many pairs of each tree link and the sum of their scores, under one event of the tree."""

    def work(rows: pa.RecordBatch, group: np.ndarray, held: int) -> Iterator[pa.RecordBatch]:
        i, j = _near_links(rows, group, config)
        chosen, tree = _forest(rows.num_rows, i, j, j < held)
        (weigh, event), ids = _weighing(rows, config), rows["event_id"]
        i, j = i[chosen], j[chosen]
        score, near, mask, keep, _ = weigh(i, j)
        keep &= event[i] != event[j]
        names = [f.name for f in _SPANNING]
        links = [ids.take(pa.array(i[keep])), ids.take(pa.array(j[keep])), pa.array(_rounded(score[keep]) / 10_000), pa.array(near[keep]), pa.array(mask[keep]), *[pa.nulls(int(keep.sum()), pa.int64())] * 2]
        for start in range(0, int(keep.sum()), 10_000):
            yield pa.RecordBatch.from_arrays([c.slice(start, 10_000) for c in links], names)
        if not counted:
            return
        count, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        for a, b, times in _alike(rows, group, held, event, config):
            score, _, _, linked, first = weigh(a, b)
            linked &= first
            # All pairs like this one link, so they lie in the tree of the first of their earlier events.
            nodes, which = np.unique(tree[a[linked]], return_inverse=True)
            # Whole numbers below 2^53, so the sums are exact.
            count[nodes] += np.bincount(which, times[linked], len(nodes)).astype(np.int64)
            total[nodes] += np.bincount(which, times[linked] * _rounded(score[linked]), len(nodes)).astype(np.int64)
        nodes = np.flatnonzero(count)
        root = ids.take(pa.array(nodes))
        none = [pa.nulls(len(nodes), t) for t in (pa.float64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([root, root, *none, pa.array(count[nodes]), pa.array(total[nodes])], names)

    return work


_SPANNING = [*_FOUND, T.StructField("link_count", T.LongType()), T.StructField("score_sum", T.LongType())]


def linking_kinds(config: CorrelationConfig) -> list[str]:
    """The kinds of keys under which a pair that shares no earlier kind can link at all."""
    return [kind for kind in _KINDS if _patterns(kind, config)]


def _spanned(events: DataFrame, config: CorrelationConfig, counted: bool) -> DataFrame:
    placed = _placed(_by_key(events), linking_kinds(config), config)
    return placed.mapInArrow(_pieces(_spanning(config, counted), config), T.StructType(_SPANNING))


def connecting_links(events: DataFrame, config: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Links that connect the same events as all of ``correlate_pairs`` do, but far fewer of them: at most one for each event, host and bin, and account and bin.

    What a pair shares decides at which distance it links. So among the events
    that share such a pattern those between two linked ones are no farther apart, and neighbours
    in time connect them all. A follow-up on another's host has an earlier and a later
    side; there the nearest of each turn connect them. Events meet by host, or else by account, address or
    domain, in bins of eight windows with the window before; in each a task keeps a spanning forest. Weights must not be negative.
    """
    return _told(_spanned(events, config, False), config)


def connecting_totals(events: DataFrame, config: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """The connecting links and, from the same shuffle, counts of all links: (source_event_id, target_event_id, link_count, score_sum).

    A row with a ``link_count`` is no link. It says how many pairs link among the events that
    a task found connected, of which its event is one, and the sum of their rounded scores in ten-thousandths.
    Each pair of ``correlate_pairs`` counts once.
    """
    return _spanned(events, config, True).select("source_event_id", "target_event_id", "link_count", "score_sum")


def _factoring(config: CorrelationConfig):
    """Arrow step: how many pairs link by each set of factors, and their best score."""

    def work(rows: pa.RecordBatch, group: np.ndarray, held: int) -> Iterator[pa.RecordBatch]:
        weigh, event = _weighing(rows, config)
        count, best = np.zeros(1 << len(_factors(config)), np.int64), np.zeros(1 << len(_factors(config)))
        for a, b, times in _alike(rows, group, held, event, config):
            score, _, mask, linked, first = weigh(a, b)
            linked &= first
            count += np.bincount(mask[linked], times[linked], len(count)).astype(np.int64)
            np.maximum.at(best, mask[linked], score[linked])
        held_sets = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held_sets), pa.array(count[held_sets]), pa.array(best[held_sets])], ["held", "links", "best"])

    return work


def factor_totals(events: DataFrame, config: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """AGG-19 over all links of ``correlate_pairs``: (factor, links, best), counted where pairs meet, so that no pair leaves its task."""
    placed = _placed(_by_key(events), linking_kinds(config), config)
    sets = placed.mapInArrow(_pieces(_factoring(config), config), "held long, links long, best double").groupBy("held").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    names = [F.when(F.col("held").bitwiseAND(1 << place) != 0, F.lit(name)) for place, (name, _) in enumerate(_factors(config))]
    each = sets.select("links", "best", F.explode(F.array_compact(F.array(*names))).alias("factor"))
    return each.groupBy("factor").agg(F.sum("links").alias("links"), F.round(F.max("best"), 4).alias("best"))


def correlate_bounded(events: DataFrame, config: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """WIN-6: as `correlate_pairs`, but only the nearest earlier events of each key, and the best links of each event.

    Events meet by key in bins of time, with the window before: what is missing there is too far
    off to link, so a busy key is many groups and the links are the same. Pairs are scored
    where they meet; one met under several keys has one rank and is kept once.
    """
    best = Window.partitionBy("target_event_id").orderBy(F.desc("score"), "time_delta_seconds", F.desc("source_event_id"))
    kept = _met(events, config, nearest=config.neighbours_per_key).withColumn("_n", F.dense_rank().over(best)).where(F.col("_n") <= config.links_per_event).drop("_n")
    return kept.dropDuplicates(["source_event_id", "target_event_id"])


#: What a sign-in and a suspicious event can share beyond the host that is left.
_MOVE_SHARES = ("user", "pivot", "ip", "process", "domain")


def _supporting(window: LateralConfig, config: CorrelationConfig):
    """Arrow step: the best supporting event of each sign-in, without scoring pairs.

    Rows come by host, bin and time, suspicious events before sign-ins of their time. Among the events that share at least a
    given set of things with a sign-in the nearest one scores best, so the best score is the best over these sets; the first event that
    has it is the first one, over the sets, within the distance at which a set still scores as much.
    """
    width = window.window_seconds * 1_000_000

    def scored(weight: np.ndarray, near: np.ndarray) -> np.ndarray:
        return _rounded(np.minimum(1.0, weight + config.time_proximity * (1.0 - (near / 1e6) / config.window_seconds)))

    def work(rows: pa.RecordBatch, group: np.ndarray, held: int) -> Iterator[pa.RecordBatch]:
        us, moves, ids = rows["_us"].to_numpy(), rows["move"].to_numpy(zero_copy_only=False), rows["event_id"]
        a, b = np.flatnonzero(~moves), np.flatnonzero(moves & (np.arange(len(us)) >= held))
        if not len(a) or not len(b):
            return
        rank = _codes(ids)
        rank = np.argsort(pc.sort_indices(pc.unique(ids)).to_numpy())[rank]
        # Times count from the first of their host and bin, so that a key and a time are one number.
        start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(us)), 0))
        time = us - us[start]
        span = int(time.max()) + width + 2
        user, process, domain = (_codes(rows[n]) for n in ("user", "process", "domain"))
        ip_0, ip_1 = _shared_codes(rows["ip_0"], rows["ip_1"])
        left = pc.fill_null(pc.equal(pc.coalesce(rows["destination_host"], rows["source_host"]), rows["value"]), False).to_numpy(zero_copy_only=False)
        odd = rows["suspicious"].to_numpy(zero_copy_only=False)
        columns = {"user": user, "process": process, "domain": domain}

        searched = []
        for n in range(len(_MOVE_SHARES) + 1):
            for shares in itertools.combinations(_MOVE_SHARES, n):
                for side, other in itertools.product((ip_0, ip_1), repeat=2) if "ip" in shares else ((None, None),):
                    parts = [group, *[columns[s] for s in shares if s in columns]]
                    from_, to = a, b
                    if "pivot" in shares:
                        from_ = from_[left[from_]]
                    if side is not None:
                        from_, to = from_[side[from_] >= 0], to[other[to] >= 0]
                    for s in shares:
                        if s in columns:
                            from_, to = from_[columns[s][from_] >= 0], to[columns[s][to] >= 0]
                    if not len(from_) or not len(to):
                        continue
                    key = np.zeros(len(from_) + len(to), np.int64)
                    pairs = [np.r_[c[from_], c[to]] for c in parts] + ([] if side is None else [np.r_[side[from_], other[to]]])
                    for values in pairs:
                        key = np.unique(key * (values.max() + 1) + values, return_inverse=True)[1]
                    line = key[: len(from_)] * span + time[from_]
                    order = np.lexsort((-rank[from_], line))
                    # Weights add up in the order of ``score_pair``.
                    held_weight = [("user", config.same_user), (None, config.same_host), ("pivot", config.host_pivot), ("ip", config.shared_ip), ("process", config.process_host), ("domain", config.domain_overlap)]
                    weight = 0.0
                    for name, points in held_weight:
                        weight += points if name is None or name in shares else 0.0
                    searched.append((from_[order], line[order], to, key[len(from_) :] * span, weight + np.where(odd[to], config.suspicious_coincidence, 0.0)))

        best = np.full(len(us), -1)
        for from_, line, to, key, weight in searched:
            at = np.searchsorted(line, key + time[to], "right") - 1
            while len(own := np.flatnonzero((at >= 0) & (rank[from_[at]] == rank[to]) & (line[at] >= key))):
                at[own] -= 1
            found = (at >= 0) & (line[at] >= key + np.maximum(time[to] - width, 0)) & (weight > 0)
            score = scored(weight[found], us[to[found]] - us[from_[at[found]]])
            best[to[found]] = np.maximum(best[to[found]], score)
        best[best / 10_000 < window.min_score] = -1

        chosen = np.full(len(us), -1)
        for from_, line, to, key, weight in searched:
            can = (best[to] >= 0) & (weight > 0)
            to, key, weight = to[can], key[can], weight[can]
            if not len(to):
                continue
            # The farthest whole distance that still scores as much: estimated, and then tried.
            if config.time_proximity > 0:
                far = (1.0 - ((best[to] - 0.5) / 10_000 - weight) / config.time_proximity) * config.window_seconds * 1e6
                far = np.clip(np.floor(far), -3, width + 3).astype(np.int64)
            else:
                far = np.full(len(to), width)
            reach = np.full(len(to), -1)
            for more in range(-3, 4):
                near = np.minimum(far + more, width)
                reach = np.where((near >= 0) & (scored(weight, near) >= best[to]), np.maximum(reach, near), reach)
            can = reach >= 0
            to, key, reach = to[can], key[can], reach[can]
            at = np.searchsorted(line, key + np.maximum(time[to] - reach, 0), "left")
            while len(own := np.flatnonzero((at < len(line)) & (rank[from_[np.minimum(at, len(line) - 1)]] == rank[to]))):
                at[own] += 1
            found = at < len(line)
            to, at, key = to[found], at[found], key[found]
            found = line[at] <= key + time[to]
            to, new = to[found], from_[at[found]]
            old = chosen[to]
            sooner = (old < 0) | (us[new] < us[old]) | ((us[new] == us[old]) & (rank[new] > rank[old]))
            chosen[to[sooner]] = new[sooner]

        b = np.flatnonzero(chosen >= 0)
        a, names = chosen[b], ("event_id", "user", "source_host", "destination_host", "method", "_us")
        out = [*[rows[c].take(pa.array(b)) for c in names], ids.take(pa.array(a)), pa.array(us[a]), pa.array(best[b])]
        yield pa.RecordBatch.from_arrays(out, [*names, "support", "support_us", "points"])

    return work


def lateral_movement(events: DataFrame, config: LateralConfig = LateralConfig(), correlation: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """GRA-5: sign-ins that carry an account from a host with earlier suspicious activity to another host.

    The best supporting event wins, then the best detection of each (account,
    source, destination). Sign-ins and suspicious events meet by host in bins of time, and each sign-in looks its best event up
    there, so time grows as events do and not as their pairs. Weights must not be negative.
    """
    able = F.col("action").isin(*config.actions) & (F.coalesce("outcome", F.lit("")) != "failure") & (F.length("source_host") > 0) & (F.length("destination_host") > 0) & (F.col("source_host") != F.col("destination_host"))
    told = events.withColumns({"_able": F.coalesce(able, F.lit(False)), "method": F.col("action")}).where("event_id IS NOT NULL AND timestamp IS NOT NULL AND (_able OR suspicious)")
    sides = _sides(told, ("_able", "method")).withColumns({"ip_0": F.get("ips", F.lit(0)), "ip_1": F.get("ips", F.lit(1))}).drop("ips", "primary")
    width = config.window_seconds * 1_000_000
    bins = F.floor(F.col("_us") / (8 * width))
    after = F.floor((F.col("_us") + width) / (8 * width))
    support = F.flatten(F.transform("hosts", lambda h: F.transform(F.sequence(bins, after), lambda x: F.struct(h.alias("value"), x.alias("bin"), F.lit(False).alias("move")))))
    move = F.array(F.struct(F.col("source_host").alias("value"), bins.alias("bin"), F.lit(True).alias("move")))
    none = F.slice(move, 1, 0)
    met = sides.select(*[c for c in sides.columns if c not in ("hosts", "_able")], F.explode(F.concat(F.when(F.col("suspicious"), support).otherwise(none), F.when(F.col("_able"), move).otherwise(none))).alias("_at"))
    met = met.select("_at.*", F.lit(_NUMBERS["host"]).cast("long").alias("kind"), *[c for c in met.columns if c != "_at"])
    placed = met.repartition("value", "bin").sortWithinPartitions("value", "bin", "_us", "move", "event_id")
    fields = "event_id string, user string, source_host string, destination_host string, method string, _us long, support string, support_us long, points long"
    found = placed.mapInArrow(_pieces(_supporting(config, correlation), config), fields)
    best = found.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "event_id"]), F.struct("points", -F.col("support_us"), "support")).alias("x")).select("event_id", "x.*")
    first = F.min_by(F.struct("event_id", "support", "points", "user", "source_host", "destination_host", "method"), F.struct(-F.col("points"), "_us", "event_id"))
    kept = best.groupBy(F.coalesce("user", F.lit("")).alias("_user"), F.col("source_host").alias("_from"), F.col("destination_host").alias("_to")).agg(first.alias("x")).select("x.*")
    score = F.col("points") / 10_000
    return kept.select(F.concat(F.lit("lm-"), "event_id").alias("movement_id"), "event_id", F.col("support").alias("supporting_event_id"), "user", "source_host", "destination_host", "method", score.alias("correlation_score"), C.confidence_from_score(score).alias("confidence"))
