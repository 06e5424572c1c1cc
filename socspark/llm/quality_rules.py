"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a document. The cost of a rule is timed
and the rules' rejections are counted together on a bounded sample of documents
that the base rule keeps; the next rule is always the one with the most
rejections per second among what the rules before it leave, and a document that
one rule rejects is not tested by the later ones. The order changes the work
only: the verdict is the same for every order. The measures are results of
their own and computed for every row, so a rule's cost is that of its condition.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hashed_share, set_aside, stored

SPACE = r"\x20\x09-\x0D"
#: Characters of SPACE, for trimming.
SPACES = " \t\n\x0b\f\r"
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the document's columns and the measured ones; null counts as not rejected."""

    name: str
    rejects: Column


def words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _after(values: Column, k: int) -> Column:
    return F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0)))


def _pairs(values: Column, k: int) -> Column:
    """Hash of each value with the one ``k`` places on, where there is one."""
    return F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - k, F.lit(0))), _after(values, k), lambda a, b: F.xxhash64(a, b))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def repeated_words(docs: DataFrame) -> DataFrame:
    """``docs``, which has ``_words``, with ``n_repeat_words``: words inside eight-word windows that occur twice or more.

    Three rounds of pairing give a hash of each window. Where some hash repeats,
    places are sorted by hash, neighbours with equal hashes are compared word by
    word, and the covered words are summed over the places in order. Each array
    is a column of its own, so that it is computed once a row.
    """
    w = F.col("_words")
    out = docs.withColumn("_h1", F.transform(w, lambda x: F.xxhash64(x)))
    for k in (1, 2, 4):
        out = out.withColumn(f"_h{2 * k}", _pairs(F.col(f"_h{k}"), k))
    repeats = F.size(F.array_distinct("_h8")) < F.size("_h8")
    placed = F.array_sort(F.zip_with("_h8", F.sequence(F.lit(1), F.size("_h8")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(repeats, placed).otherwise(_empty("struct<h:bigint,i:int>")))
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice(w, a["i"], REPEAT_WINDOW) == F.slice(w, b["i"], REPEAT_WINDOW))
    ahead = F.zip_with(F.slice("_placed", 1, F.greatest(F.size("_placed") - 1, F.lit(0))), _after(F.col("_placed"), 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])).otherwise(_empty("int")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("far"))
    step = lambda acc, i: F.struct((acc["n"] + i + REPEAT_WINDOW - F.greatest(acc["far"], i)).cast("int").alias("n"), (i + REPEAT_WINDOW).cast("int").alias("far"))
    count = F.aggregate(F.array_sort(F.array_distinct(F.flatten(ahead))), start, step, lambda acc: acc["n"])
    return out.withColumn("n_repeat_words", F.when(F.size("_placed") > 0, count).otherwise(F.lit(0)).cast("long")).drop("_h1", "_h2", "_h4", "_h8", "_placed")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and the array ``_words``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    out = repeated_words(docs.withColumn("_words", words(text))).withColumn("_lines", lines)
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    return out.drop("_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Thresholds that clean prose in a Latin script stays well within."""
    n = F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split(F.coalesce(text_col, F.lit("")), "\n", -1))),
        Rule("upper_case", 10 * F.size(F.filter("_words", lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}"))) > 5 * n),
        Rule("digits", 10 * F.size(F.filter("_words", lambda x: x.rlike("[0-9]"))) > 3 * n),
    ]


def estimate(sample: DataFrame, rules: list[Rule], repeat: int = 20) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of what the rules before it leave) on ``sample``, in the order to run them.

    ``sample`` must be small; its rows that the base rule rejects are left out
    once it is measured. Each rule is timed on ``repeat`` passes over the others
    in one job, less the time of the same job with no rule, the better of two
    runs.
    """
    measured = sample.withColumn("_base", base_failed()).persist()
    sample = measured.where(~F.col("_base"))

    def seconds(condition: Column) -> float:
        many = sample.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).where(F.when(F.col("_pass") > 0, F.coalesce(condition, F.lit(False))))
        found = []
        for _ in range(2):
            began = time.perf_counter()
            many.count()
            found.append(time.perf_counter() - began)
        return min(found)

    names = [f"_r{i}" for i in range(len(rules))]
    patterns = [(row[:-1], row[-1]) for row in sample.select(*[F.coalesce(r.rejects, F.lit(False)).alias(n) for r, n in zip(rules, names, strict=True)]).groupBy(*names).count().collect()]
    idle = seconds(F.col("_pass") < 0)
    cost = [max(seconds(r.rejects) - idle, 1e-4) for r in rules]
    measured.unpersist()
    order, open_rules = [], list(range(len(rules)))
    while open_rules:
        left = [(hits, n) for hits, n in patterns if not any(hits[rules.index(r)] for r, _, _ in order)]
        total = max(1, sum(n for _, n in left))
        share = {i: sum(n for hits, n in left if hits[i]) / total for i in open_rules}
        best = min(open_rules, key=lambda i: (-share[i] / cost[i], rules[i].name))
        order.append((rules[best], cost[best], share[best]))
        open_rules.remove(best)
    return order


def cascade(rules: list[Rule]) -> Column:
    """The first rule, in the given order, that rejects the row; null if none does. Later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


#: Columns that the measures use meanwhile; rules may use ``_words``.
_INNER = ("_base", "_words", "_lines", "_h1", "_h2", "_h4", "_h8", "_placed", "_pass")


def judge_quality(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 200) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``rejected_by`` and ``kept``.

    Rules are ordered on about ``sample_rows`` rows, chosen by a hash of the
    text; ``rejected_by`` names the first rule of that order and so may differ
    between runs where several reject. Null and empty texts have no words and so
    fail the base rule; repeated rows are judged each for itself; columns of
    ``docs`` with the new names are replaced, all others pass through under any
    name; an empty table gives an empty result.
    """
    rules = default_rules(text_col) if rules is None else rules
    docs, back = set_aside(docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"), *_INNER)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = stored(docs.where(hashed_share(text_col, share)), "quality-sample")
    ordered = [r for r, _, _ in estimate(measure(sample, text_col), rules)] if len(rules) > 1 else rules
    out = measure(docs, text_col).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return back(out.withColumn("kept", F.col("rejected_by").isNull()).drop("_words"))
