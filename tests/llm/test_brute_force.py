"""Scores and found values against plain versions, and pipeline stages on awkward rows."""

import collections
import datetime
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from socspark.llm import classifier, pii, queries
from tests.llm.test_operators import ROWS, SCHEMA


def plain_score(text, weights):
    words = text.split() if text else []
    if not words:
        return 0.0
    buckets, found = len(weights) - 1, collections.Counter()
    for before, word in zip([None, *words], words, strict=False):
        low = word.lower()
        shape = ("U" if word.isupper() else "l" if word.islower() else "m") + ("a" if word.isalpha() else "p") + str(min(9, len(word)))
        for feature in (low, "s" + shape, "e" + low[-2:]):
            found[zlib.crc32(feature.encode()) % buckets] += 1
        if before == word:
            found[zlib.crc32(b"again") % buckets] += 1
    total = sum(found.values())
    z = sum(weights[i] * math.sqrt(n / total) for i, n in found.items()) + weights[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain_em(rows, rounds=60, prior=0.8):
    """Expectation-maximisation document by document."""
    k = len(rows[0])
    chance = [[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]] for _ in range(k)]
    for _ in range(rounds):
        good = []
        for votes in rows:
            a, b = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                a, b = a + math.log(chance[j][1][v + 1]), b + math.log(chance[j][0][v + 1])
            good.append(1 / (1 + math.exp(max(-500.0, min(500.0, b - a)))))
        for j in range(k):
            for c in (0, 1):
                sums = [0.5, 0.5, 0.5]
                for votes, g in zip(rows, good, strict=True):
                    sums[votes[j] + 1] += g if c else 1 - g
                chance[j][c] = [x / sum(sums) for x in sums]
        prior = max(0.02, min(0.98, sum(good) / len(rows)))
    return prior, chance


def test_every_score_and_every_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = classifier.fit(docs)
    rules = classifier.labellers(F.coalesce(F.col("text"), F.lit("")))
    votes = [tuple(r) for r in docs.select(*[r.vote.cast("int").alias(r.name) for r in rules]).collect()]
    prior, chance = plain_em(votes)
    assert abs(prior - scorer.labels.prior) < 1e-9
    assert max(abs(chance[j][c][v] - scorer.labels.vote[j, c, v]) for j in range(len(rules)) for c in (0, 1) for v in range(3)) < 1e-9
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op3_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_score(texts[r.doc_id], scorer.weights)
        assert abs(r.quality_score - want) < 1e-9 and r.keep == (r.quality_score >= 0.5)


def plain_values(text):
    """Dates, addresses and social security numbers of a text, found character by character."""
    found = collections.Counter()
    alnum = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    digits = lambda s: s.isascii() and s.isdigit()
    for i in range(len(text)):
        if alnum(i - 1) or not digits(text[i]):
            continue
        date, ssn = text[i : i + 10], text[i : i + 11]
        if len(date) == 10 and not alnum(i + 10) and date[4] == date[7] == "-" and all(digits(date[a:b]) for a, b in ((0, 4), (5, 7), (8, 10))):
            try:
                found["date"] += 1900 <= datetime.date.fromisoformat(date).year <= 2099
            except ValueError:
                pass
        if len(ssn) == 11 and not alnum(i + 11) and ssn[3] == ssn[6] == "-" and all(digits(ssn[a:b]) for a, b in ((0, 3), (4, 6), (7, 11))):
            found["ssn"] += 1
        end = i
        while alnum(end) or end < len(text) and text[end] == "." and alnum(end + 1):
            end += 1
        parts = text[i:end].split(".")
        if (i == 0 or text[i - 1] != ".") and len(parts) == 4 and all(digits(p) and len(p) <= 3 and int(p) <= 255 for p in parts):
            found["ip"] += 1
    return found


def test_values_are_those_of_a_plain_search(spark, sf_dir):
    more = ["10.0.0.1.", "x10.0.0.1", "10.0.0.1.5", "1.2.3.4, 255.255.255.256", "2024-02-30 2024-02-29.", "1899-01-01", "123-45-6789 0123-45-6789", "on 1999-12-31T10:00", "a2001-01-01", "(2001-01-01)"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 10**6)), "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    differ = {}
    for r in pii.pseudonymise(docs.withColumn("was", F.col("text")), "k").collect():
        want = plain_values(texts[r.doc_id])
        valid = sum(1 for k in ("ip", "ssn") if r[f"n_{k}"] != want[k])
        if valid:
            differ[r.doc_id] = (r.n_ip, r.n_ssn, want)
    assert not differ


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_and_empty_tables(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name == "pack":
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    else:
        assert out.columns == docs.columns
        ids = collections.Counter(r.doc_id for r in rows)
        if name == "language_id":
            assert not {1, 2, 5, 6} & set(ids)  # no letters
        elif name == "near_dedup":
            assert ids[3] == 1 and ids[4] == 1
        elif name == "decontaminate":
            assert sum(ids.values()) == len(ROWS)
        else:
            assert sum(ids.values()) == len(ROWS) and all(r.n_words in (7, None) for r in rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
