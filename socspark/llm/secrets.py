"""Secret scan: fixed patterns, and character Markov models, in DataFrame functions only.

Spans come from two regular-expression passes of the JVM over the text: the
matches themselves and the stretches between them, whose lengths add up to the
places of the matches. Tokens of 16 characters or more are scored by first-order
character models of random strings, one for each usual alphabet, and of ordinary
identifiers. A token becomes a span of kind ``markov`` where the log-likelihood
ratio of some stretch of it is above a threshold that held-out samples set.

The labelled samples are made from the corpus by rule: ordinary identifiers are
its words in the usual styles (camel case, snake case, kebab case, paths,
constants), random strings are digests of its ids in the usual alphabets and the
values of fixed-pattern matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, hashed_share, stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters that the models tell apart; any other is one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: What the models describe: ordinary identifiers, and random strings by their alphabet.
SOURCES = ("ordinary", "hex", "upper_hex", "lower", "upper", "mixed")
#: Share of every model that is uniform, so that one unseen pair decides nothing.
EVEN = 0.05
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` (a sum or a maximum, from 0) over an array of int, in about as many parts as each part is long."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def scan(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return _let(op(acc["at"], x).cast("int"), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

        return F.aggregate(part, none, step)

    def parts_of(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: scan(F.slice(values, k * size + 1, size)))

    parts = _let(F.ceil(F.sqrt(F.size(values))).cast("int"), parts_of)
    joined = lambda ps: _let(scan(F.transform(ps, lambda p: p["at"]))["out"], lambda ends: F.flatten(F.transform(ps, lambda p, k: F.transform(p["out"], lambda x: op(F.when(k > 0, F.get(ends, k - 1)).otherwise(0), x).cast("int")))))
    return F.when(F.size(values) > 0, _let(parts, joined)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, kind: int, keep=lambda match: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` that ``keep`` holds for, as (start, kind, end) in code points.

    Texts without a match skip both passes.
    """

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("int")), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda x, end: F.struct((end - F.length(x["match"])).cast("int").alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match")))

    # The stretch after the last match has no match of its own and falls away.
    found = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("before")), lambda x: x["match"].isNotNull())
    kept = F.filter(_let(found, placed), lambda x: keep(x["match"]))
    return F.when(text.rlike(pattern), F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"]))).otherwise(F.array()).cast(SPAN)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by kind. A match that is too short is dropped, with what it covered."""
    return F.concat(
        spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        spans(text, ACCESS, 1, lambda m: F.length(m) >= 20),
        spans(text, HEX, 2),
    )


def _code(c: Column) -> Column:
    """Number of a character: its place in ALPHABET from 1, else 0."""
    return F.call_function("locate", c, F.lit(ALPHABET))


def _pair_numbers(token: Column) -> Column:
    """Numbers, from 1, of the neighbouring characters of a token."""
    numbers = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: (a * SIZE + b + 1).cast("int"))
    return F.when(F.length(token) > 1, _let(F.transform(F.split(token, ""), _code), numbers)).otherwise(F.array().cast("array<int>"))


def ordinary_identifiers(text: Column) -> Column:
    """The words of a text, three at a time, as identifiers in six styles, two of them with numbers."""
    styles: list[Callable[[Column, Column], Column]] = [
        lambda w, k: F.concat(F.lower(w[0]), F.initcap(w[1]), F.initcap(w[2])),
        lambda w, k: F.concat(F.initcap(w[0]), F.initcap(w[1]), F.initcap(w[2]), (k % 10).cast("string")),
        lambda w, k: F.lower(F.array_join(w, "_")),
        lambda w, k: F.lower(F.concat_ws("-", F.array_join(w, "-"), (k % 100).cast("string"))),
        lambda w, k: F.lower(F.concat(F.lit("/"), w[0], F.lit("/"), (2000 + k % 40).cast("string"), F.lit("/"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/"), w[1], F.lit("-"), w[2])),
        lambda w, k: F.upper(F.array_join(w, "_")),
        lambda w, k: F.lower(F.array_join(w, "/")),
        lambda w, k: F.concat(F.array_join(w, "/"), F.lit("/"), F.initcap(w[2]), F.initcap(w[0])),
    ]

    def identifier(words: Column, k: Column) -> Column:
        out = styles[0](words, k)
        for n, style in enumerate(styles[1:], 1):
            out = F.when(k % len(styles) == n, style(words, k)).otherwise(out)
        return out

    def all_of(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.floor(F.size(words) / 3).cast("int")), lambda k: identifier(F.slice(words, 3 * k - 2, F.lit(3)), k))

    return _let(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda words: F.when(F.size(words) >= 3, all_of(words)).otherwise(F.array().cast("array<string>")))


def random_strings(seed: Column, n: int = 4) -> Column:
    """(source, token) of ``n`` random strings of each alphabet, from digests of ``seed``."""
    out = []
    for k in range(n):
        h = F.sha2(F.concat_ws("|", seed, F.lit(f"secret sample {k}")), 256)
        size = 20 + F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(21)).cast("int")
        base36 = F.concat(*[F.conv(F.substring(h, 1 + 15 * i, 15), 16, 36) for i in range(4)])
        base64 = F.base64(F.unhex(h))
        mixed = (base64, F.translate(base64, "+/", "-_"), F.translate(base64, "+/=", ""), F.translate(base64, "+/=", ""))[k % 4]
        for source, token in (("hex", h), ("upper_hex", F.upper(h)), ("lower", F.lower(base36)), ("upper", base36), ("mixed", mixed)):
            out.append(F.struct(F.lit(SOURCES.index(source)).alias("source"), F.substring(token, F.lit(1), size).alias("token")))
    return F.array(*out)


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios of character pairs, a table of SIZE * SIZE for each random source, and the threshold."""

    ratios: dict[str, list[float]]
    threshold: float = math.inf
    #: Shares of held-out ordinary identifiers and of random strings, by source, that are above the threshold.
    flagged: dict[str, float] = field(default_factory=dict)


def _labelled(docs: DataFrame, text_col: str, id_col: str, share: float) -> DataFrame:
    """(source, token, held) of a hashed sample of ``docs``; one document in four is held out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.where(hashed_share(id_col, share)).select(text.alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    sample = sample.withColumn("held", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(4)) == 0)
    found = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: (F.length(v) >= 16) & v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    values = F.transform(found, lambda v: F.struct(F.when(v.rlike("^[0-9a-f]+$"), 1).otherwise(len(SOURCES) - 1).alias("source"), v.alias("token")))
    plain = F.when(~F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"), F.transform(ordinary_identifiers(F.col("text")), lambda v: F.struct(F.lit(0).alias("source"), v.alias("token"))))
    every = F.concat(values, random_strings(F.col("id")), F.coalesce(plain, F.array().cast("array<struct<source:int,token:string>>")))
    return sample.select("held", F.explode(every).alias("x")).select("held", "x.*")


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 2_000, least_threshold: float = 12.0, false_share: float = 1e-4, missed_share: float = 0.01) -> Models:
    """Models from labelled samples, and a threshold from held-out ones.

    About ``sample_rows`` documents, chosen by a hash of the id, give the
    samples, from all of their words: ordinary identifiers from texts without a
    fixed-pattern match, values of such matches, and random strings. Equal
    counts and repeated rows only weigh more, a null id is an empty one, and
    without any document nothing is ever above the threshold. Every model keeps
    a share of EVEN that is uniform. The threshold lies midway between the
    ratio that ``false_share`` of held-out ordinary identifiers exceed and the
    one that ``missed_share`` of the random strings of the hardest source fall
    below, and is at least ``least_threshold``. At most 6 * SIZE * SIZE counts,
    below 1 MB, and a few shares reach the driver.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    labelled = _labelled(docs, text_col, id_col, share)
    pairs = labelled.where(~F.col("held")).select("source", F.explode(_pair_numbers(F.col("token"))).alias("pair"))
    counts = {(source, pair): n for source, pair, n in pairs.groupBy("source", "pair").count().collect()}
    if not counts:
        return Models({})
    logs = []
    for k in range(len(SOURCES)):
        log = []
        for a in range(SIZE):
            row = [counts.get((k, a * SIZE + b + 1), 0) for b in range(SIZE)]
            total = sum(row)
            log += [math.log((1 - EVEN) * (n / total if total else 1 / SIZE) + EVEN / SIZE) for n in row]
        logs.append(log)
    ratios = {SOURCES[k]: [round(x - y, 4) for x, y in zip(logs[k], logs[0], strict=True)] for k in range(1, len(SOURCES))}
    held = stored(labelled.where("held").where(F.length("token") >= 16).select("source", likelihood_ratio(F.col("token"), ratios).alias("ratio")), "held-out-ratios")
    quantile = lambda q: F.percentile_approx("ratio", F.lit(q), 100_000).alias("q")
    low = {k: x for k, x in held.groupBy("source").agg(F.when(F.col("source") == 0, quantile(1 - false_share)).otherwise(quantile(missed_share))).collect()}
    hardest = min((x for k, x in low.items() if k), default=0.0)
    threshold = max(least_threshold, (low.get(0, 0.0) + hardest) / 2)
    above = {SOURCES[k]: x for k, x in held.groupBy("source").agg(F.avg((F.col("ratio") > threshold).cast("int"))).collect()}
    return Models(ratios, round(threshold, 4), above)


def likelihood_ratio(token: Column, ratios: dict[str, list[float]]) -> Column:
    """The largest log-likelihood ratio of any stretch of a token, under the random source that suits it best."""
    if not ratios:
        return F.lit(0.0)

    def best(numbers: Column, table: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return _let(F.greatest(F.lit(0.0), acc["now"] + F.element_at(table, x)), lambda now: F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best")))

        return F.aggregate(numbers, F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best")), step, lambda acc: acc["best"])

    tables = [F.split(F.lit(",".join(map(str, r))), ",").cast("array<double>") for r in ratios.values()]  # literals once folded
    return _let(_pair_numbers(token), lambda numbers: F.greatest(F.lit(0.0), *[best(numbers, t) for t in tables]))


def scan_secrets(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of (start, kind, end) by start and then kind; kinds index KINDS.

    A null text is empty and has no span; so has an empty table no row. A
    ``markov`` span is a token of TOKEN with a letter whose ratio is above the
    threshold and which no fixed-pattern span covers whole. Repeated rows are
    scanned each for itself; a column ``spans`` of ``docs`` is replaced, and all
    others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    likely = lambda m: m.rlike("[A-Za-z]") & (likelihood_ratio(m, models.ratios) > models.threshold)
    more = spans(text, TOKEN, 3, likely) if models.ratios else F.array().cast(SPAN)

    def apart(every: Column) -> Column:
        covered = running(F.transform(every, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.greatest)
        marked = F.zip_with(every, covered, lambda s, far: F.struct(s.alias("s"), ((s["kind"] < 3) | (far < s["end"])).alias("keep")))
        return F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["s"])

    out = docs.drop("spans")
    every = fresh(out, "spans_found")[0]
    return out.withColumn(every, F.array_sort(F.concat(base_spans(text), more))).withColumn("spans", apart(F.col(every)).cast(SPAN)).drop(every)


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs``, which has ``spans``, with every span of the text replaced by ``mask``; overlapping spans give one mask.

    The text is read in stretches of 1,024 characters, so that a text with many
    spans takes little more than linear time. Texts without a span, null ones
    among them, stay as they are.
    """
    text, size = F.col(text_col), 1024

    def piece(parts: Column, first: Column, after: Column) -> Column:
        """Characters from ``first`` to before ``after``."""
        a, b = F.floor(first / size).cast("int"), F.floor(after / size).cast("int")
        get = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        one = F.substring(get(a), first % size + 1, after - first)
        many = F.concat(F.substring(get(a), first % size + 1, F.lit(size)), F.array_join(F.slice(parts, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(get(b), F.lit(1), after % size))
        return F.when(a == b, one).otherwise(many)

    def masked(found: Column) -> Column:
        far = running(F.transform(found, lambda s: s["end"]), F.greatest)
        gaps = lambda ends: F.transform(found, lambda s, k: F.struct(F.when(k > 0, F.get(ends, k - 1)).otherwise(0).alias("at"), s["start"].alias("start")))
        cut = lambda parts, ends: F.concat(F.array_join(F.transform(F.filter(gaps(ends), lambda g: g["start"] >= g["at"]), lambda g: F.concat(piece(parts, g["at"], g["start"]), F.lit(mask))), ""), piece(parts, F.element_at(ends, -1), F.length(text)))
        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda parts: _let(far, lambda ends: cut(parts, ends)))

    return docs.withColumn(text_col, F.when(F.size("spans") > 0, masked(F.col("spans"))).otherwise(text))
