"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation over the counts of vote patterns estimates each
labeller's accuracy and the share of good documents; the posterior of a pattern
is the training label. A logistic scorer on hashed words, character trigrams
and surface measures learns those labels and then scores every document, also
those that no labeller voted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotate, chunks, hashed_share

GOOD, BAD, NONE = 1, -1, 0


@dataclass(frozen=True)
class Labeller:
    """A vote on each document: GOOD, BAD or NONE."""

    name: str
    vote: Column


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(NONE))


def labellers(text: Column) -> list[Labeller]:
    """Heuristics over one text column; each looks at another property."""
    n = F.greatest(F.length(text), F.lit(1))
    matches = lambda pattern: F.size(F.split(text, pattern, -1)) - 1
    symbols, upper, ends, lines = matches(r"[#*$%&|<>{}~^]"), matches(r"\p{Lu}"), matches(r"[.!?](?:\s|$)"), matches("\n") + 1
    spaces = matches(r"\s+")
    unique = F.size(F.array_distinct(F.split(text, "\n", -1)))
    runs, capitals, clean = matches(r"[^\p{L}\p{N}\s]{2,}"), matches(r"\p{Lu}{3,}"), matches(r"(?:^|\s)[\p{L}'-]+[.,;:!?]?(?=\s|$)")
    return [
        Labeller("symbols", _vote(symbols * 500 < n, symbols * 40 > n)),
        Labeller("runs", _vote(runs * 500 < n, runs * 50 > n)),
        Labeller("clean_words", _vote(clean * 10 > spaces * 9, clean * 10 < spaces * 6)),
        Labeller("upper", _vote(F.lit(False), upper * 4 > n)),
        Labeller("capitals", _vote(F.lit(False), capitals * 30 > n)),
        Labeller("length", _vote(F.lit(False), n < 60)),
        Labeller("sentences", _vote((ends * 200 > n) & (ends * 10 < n), ends * 1000 < n)),
        Labeller("lines", _vote(F.lit(False), unique * 2 < lines)),
        Labeller("words", _vote(F.lit(False), (spaces * 25 < n) | (spaces * 3 > n))),
        Labeller("repeats", _vote(F.lit(False), matches(r"(?<!\S)(\S+)\s+\1\s+\1(?!\S)") * 100 > spaces)),
        Labeller("cells", _vote(F.lit(False), matches(r"\|") * 60 > n)),
    ]


@dataclass
class WeakLabels:
    """Estimates of expectation-maximisation: the prior of good, and per labeller the chance of each vote by class."""

    prior: float
    vote: np.ndarray  # labeller, class (0 bad, 1 good), vote + 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        k = np.arange(votes.shape[1])
        bad, good = (np.log(self.vote[k, c, votes + 1]).sum(axis=1) for c in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good + np.log1p(-self.prior) - np.log(self.prior), -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Chance that a labeller's vote, when it votes, is right."""
        right = self.prior * self.vote[:, 1, 2] + (1 - self.prior) * self.vote[:, 0, 0]
        wrong = self.prior * self.vote[:, 1, 0] + (1 - self.prior) * self.vote[:, 0, 2]
        return right / np.maximum(right + wrong, 1e-12)


def estimate_accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.8) -> WeakLabels:
    """Expectation-maximisation over vote patterns and their counts; starts from labellers that are right more often than not."""
    n_labellers = votes.shape[1]
    start = np.empty((n_labellers, 2, 3))
    start[:, 1] = (0.1, 0.3, 0.6)
    start[:, 0] = (0.6, 0.3, 0.1)
    model = WeakLabels(prior, start)
    for _ in range(rounds if len(votes) else 0):
        good = model.posterior(votes)
        weight = np.stack([counts * (1 - good), counts * good])
        chance = np.empty_like(start)
        for v in range(3):
            chance[:, :, v] = ((votes == v - 1).T.astype(float) @ weight.T) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        model = WeakLabels(float(np.clip(weight[1].sum() / counts.sum(), 0.02, 0.98)), chance)
    return model


def word_features(word: str, buckets: int) -> list[int]:
    """Hashed features of a word: itself in lower case, its shape and its end."""
    low = word.lower()
    shape = ("U" if word.isupper() else "l" if word.islower() else "m") + ("a" if word.isalpha() else "p") + str(min(9, len(word)))
    return [zlib.crc32(x) % buckets for x in (low.encode("utf-8", "surrogatepass"), b"s" + shape.encode(), b"e" + low[-2:].encode("utf-8", "surrogatepass"))]


class _Words(dict):
    """Features of a word, kept for the words that come again."""

    def __init__(self, buckets: int, most: int = 200_000):
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = word_features(word, self.buckets)
        return out

    def of_text(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features, weights) of a whole text; a word that repeats the one before it is a feature of its own."""
        found = [i for w in words for i in self[w]]
        found += [zlib.crc32(b"again") % self.buckets] * sum(map(str.__eq__, words, words[1:]))
        index, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
        return index, np.sqrt(n / n.sum())


def train(rows: list[tuple[str, float]], buckets: int = 1 << 16, passes: int = 6, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Weights of a logistic scorer; a document's features are averaged and its label is a probability.

    The last weight is the bias. Rows are the bounded sample that `fit` draws.
    """
    weights = np.zeros(buckets + 1)
    squares = np.full(buckets + 1, 1e-6)
    known = _Words(buckets)
    made = [(known.of_text(t.split()), y) for t, y in rows if t and t.strip()]
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(made)):
            (index, x), y = made[i]
            z = weights[index] @ x + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grad = error * x
            squares[index] += grad**2
            squares[-1] += error**2
            weights[index] -= rate * grad / np.sqrt(squares[index])
            weights[-1] -= rate * 0.1 * error / np.sqrt(squares[-1])
    return weights


@dataclass
class Scorer:
    labels: WeakLabels
    names: list[str]
    weights: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 4000, make: Callable[[Column], list[Labeller]] = labellers) -> Scorer:
    """Accuracies from all documents' votes, and the scorer from about ``sample_rows`` of them.

    Vote patterns are counted over the whole table and only their counts, at
    most 3 to the number of labellers, reach the driver. The scorer's sample is
    chosen by a hash of the id; ``sample_rows`` is its documented bound. Without
    any document the scorer says 0.5 to every text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = make(text)
    names = [r.name for r in rules]
    votes = docs.select(*[r.vote.cast("int").alias(r.name) for r in rules])
    patterns = votes.groupBy(*names).count().collect()
    table = np.array([tuple(r)[:-1] for r in patterns], dtype=np.int64).reshape(len(patterns), len(rules))
    counts = np.array([r["count"] for r in patterns], dtype=float)
    labels = estimate_accuracies(table, counts)
    share = min(1.0, sample_rows / max(1.0, counts.sum()))
    sample = docs.where(hashed_share(id_col, share, seed=3)).select(text.alias("text"), F.array(*[r.vote.cast("int") for r in rules]).alias("votes")).limit(2 * sample_rows).collect()
    if not sample:
        return Scorer(labels, names, np.zeros((1 << 16) + 1))
    posterior = labels.posterior(np.array([r["votes"] for r in sample], dtype=np.int64))
    return Scorer(labels, names, train(list(zip([r["text"] for r in sample], posterior.tolist(), strict=True))))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", chunk_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1), the scorer's probability of good from the whole text.

    A null text, or one without a word, scores 0. Other columns pass through,
    save one with the new name; repeated rows score alike; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer.weights)
    buckets = len(scorer.weights) - 1

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        weights = shared.value
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        known, out = _Words(buckets), []
        for first, after in chunks(texts, chunk_chars):
            for text in texts[first:after]:
                words = text.split() if text else []
                if not words:
                    out.append(0.0)
                    continue
                index, x = known.of_text(words)
                z = weights[index] @ x + weights[-1]
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return {"quality_score": pa.array(out, pa.float64())}

    return annotate(docs, run, [T.StructField("quality_score", T.DoubleType())])


def classify(docs: DataFrame, scorer: Scorer | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score`` and ``keep``.

    A document is kept if the scorer gives it ``threshold`` or more. Null and
    empty texts are not kept.
    """
    scorer = scorer or fit(docs, text_col, id_col)
    out = score(docs.drop("keep"), scorer, text_col)
    return out.withColumn("keep", F.col("quality_score") >= threshold)

