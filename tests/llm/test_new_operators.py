"""Clustering, the prefix trie and word BPE against brute-force versions and the tokenizer library."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from socspark.llm import bpe, kmeans, prefix_trie, queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_prefix_trie"])
def test_new_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    whole = lambda x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
    rows = lambda frame: sorted(tuple(map(str, map(whole, r))) for r in frame[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


# Clustering


def lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in hashed[:k]]
    for r in range(rounds + 1):
        distance = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        cluster = [d.index(min(d)) for d in distance]
        if r < rounds:
            for c in range(len(centroids)):
                if mine := [v for (_, v), x in zip(kept, cluster, strict=True) if x == c]:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [min(d) for d in distance]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, c, fits(d), fits(sum(x for x, y in zip(own, cluster, strict=True) if y == c)), fits(sum(own)), digest[c]) for (i, _), c, d in zip(kept, cluster, own, strict=True)]


def clusters(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [tuple(r) for r in kmeans.cluster_vectors(table, **options).collect()]


def test_clusters_of_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(200)]
    rows += [(1000 + i, [0.25] * 64) for i in range(100)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.5] * 64), (8, [-0.1] * 64)]  # repeated rows and ids, a null id
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [float("nan")] + [1.0] * 63), (2004, [float("inf")] * 64), (2005, [])]
    by_id = lambda x: sorted(map(str, x))
    got = clusters(spark, rows)
    assert by_id(got) == by_id(lloyd(rows)) and len(got) == 304
    assert clusters(spark, rows[-6:]) == [] and clusters(spark, []) == []
    assert by_id(clusters(spark, rows[:3])) == by_id(lloyd(rows[:3]))


def test_clusters_of_large_and_tied_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.choice([-1, 0, 1]) * 2.0**scale) for _ in range(64)]) for i, scale in enumerate([0, 20, 30, 40] * 20)]
    rows += [(100 + i, [float(i % 2)] * 64) for i in range(20)]
    assert sorted(map(str, clusters(spark, rows))) == sorted(map(str, lloyd(rows)))


def test_clusters_ignore_other_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    more = table.withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "id": F.lit(2), "v": F.lit(3), "kind": F.lit(0)})
    assert sorted(map(tuple, kmeans.cluster_vectors(more).collect())) == sorted(map(tuple, kmeans.cluster_vectors(table).collect()))


def test_planar_bound_holds_and_is_tighter_than_the_drift():
    rng, tighter = np.random.default_rng(1), 0
    for _ in range(2000):
        size = int(rng.choice([2, 3, 8]))
        old, new, centre = rng.normal(size=(3, size)) * rng.choice([0.1, 1, 5], size=(3, 1))
        radius = abs(rng.normal()) * rng.choice([0.05, 0.5, 2])
        bound, drift = kmeans.most_loosening(centre, radius, old, new), np.linalg.norm(new - old)
        points = rng.normal(size=(200, size))
        points = centre + radius * points / np.linalg.norm(points, axis=1)[:, None]
        assert (np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)).max() <= bound + 1e-9
        assert bound <= drift + 1e-12
        tighter += bound < 0.9 * drift
    assert tighter > 1000
    assert kmeans.most_loosening(np.zeros(2), 1.0, np.ones(2), np.ones(2)) == 0


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(2)
    middles = rng.integers(-400, 400, size=(8, 64))
    v = (middles[rng.integers(0, 8, size=4000)] + rng.integers(-20, 20, size=(4000, 64))).astype(np.int64)
    old = middles.astype(np.int64)
    cluster, distance, bound, scanned = kmeans.assign(v, old, None, None)
    assert scanned == 4000
    new = np.array([v[cluster == i].sum(0) // max((cluster == i).sum(), 1) for i in range(8)])
    radii = np.array([np.sqrt(float(max(distance[cluster == i], default=0))) for i in range(8)])
    fall = kmeans.loosening(old, new, radii)
    again, exact, _, scanned = kmeans.assign(v, new, cluster, bound - fall[cluster])
    want = ((v[:, None, :] - new[None]) ** 2).sum(2)
    assert (again == want.argmin(1)).all() and (exact.astype(np.int64) == want.min(1)).all() and scanned < 400


# The prefix trie


def trie(rows):
    convs, members, kids, leaves, saved = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list), {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30], (role, text)))
    own = {c: [x[2] for x in sorted(mine, key=lambda x: x[:2])] for c, mine in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = sum(leaves[x] for x in kids[prefix]) or 1
        saved[prefix] = (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0) + sum(saved[x] for x in kids[prefix])
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def nodes(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(table, **options).collect())


@pytest.mark.parametrize("width", [64, 2, 1])
def test_trie_of_awkward_turns(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(0, 500, 7), 100, 200]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "u", "a"]), rng.choice([None, "x", "\U0001f600y", "zzz", ""])) for _ in range(1500)]
    assert nodes(spark, rows, width=width) == trie(rows)


@pytest.mark.parametrize("width", [64, 7])
def test_trie_of_very_long_and_hot_conversations(spark, width):
    rng = random.Random(4)
    rows = [(c, t, "u", f"t{min(t, rng.choice([t, t, 0]))}") for c in range(150) for t in range(rng.choice([1, 3, 9]))]
    rows += [(17, t, "a", "same") for t in range(1000)] + [(18, t, "a", "same") for t in range(990)]  # two long ones that part late
    rows += [(1000 + c, t, "u", f"hot {t}") for c in range(300) for t in range(7)]  # many equal ones
    assert nodes(spark, rows, width=width) == trie(rows)


def test_trie_of_nothing(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "u", "x")]) == []


def test_trie_with_small_shards_and_without_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(200) for t in range(rng.choice([2, 5, 8]))]
    monkeypatch.setattr(prefix_trie, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert nodes(spark, rows, width=3) == trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Word BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_bpe_of_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_word_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


STRANGE = ["", " ", "don't we'll I'VE", "<|endoftext|>x<|STARTOFTEXT|> <|startoftext|>", "İstanbul ΑΣ ΌΣΟΣ ǅ ﬁ", "a\x1cb\x1db \x85c d　e​f", "é ́e Å Å 가 각", "½ ²x x² ٣ 四 Ⅷ", "\U0001f600\U0001f469‍\U0001f680 \U000e0001", "͸ \U0010ffff", "x" * 5000, "ab" * 3000 + "!?" * 500, "  \n\t a \r\n"]


def test_word_bpe_of_strange_texts(spark, library):
    rows = [(i, t) for i, t in enumerate([*STRANGE, *STRANGE[:3]])] + [(None, "no id"), (1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "7 as n_tokens", "map('a', 1) as words")
    got = bpe.encode_documents(table).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids) and r.words == {"a": 1}
    assert bpe.encode_documents(table.limit(0)).count() == 0


def test_word_bpe_of_one_character_of_each_kind(library):
    mine = bpe.encoder("word_bpe_49k.json")
    texts = [f"a{chr(c)}b{chr(c)} {chr(c)}'s" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x2100 or c % 23 == 0)]
    ids, bounds = mine.encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [w.ids for w in want]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(alphabet=st.sampled_from("abcdeinorst'EÉß .-1"), max_size=60))
def test_word_bpe_of_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = test_word_bpe_of_any_text.__dict__.setdefault("library", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    ids, _ = bpe.encoder("word_bpe_49k.json").encode([text])
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_proposals_are_checked_and_some_hold():
    mine = bpe.encoder("word_bpe_49k.json").bpe
    words = [w.encode() for w in "the training of understanding hypothetical zqxj interestingly antidisestablishmentarianism".split()]
    tokens, counts, merged = mine.encode(words)
    exact = [mine.merge([*w[:-1], w[-1] + bpe.WORD_END]) for w in words]
    assert [t for x in exact for t in x] == tokens.tolist() and counts.tolist() == [len(x) for x in exact] and merged < len(words)


def test_a_table_whose_ranks_do_not_rise_is_merged_exactly():
    vocab = {c: i for i, c in enumerate("abcd")} | {c + "</w>": 4 + i for i, c in enumerate("abcd")}
    for string in ("ab", "bc", "abc", "abcd</w>"):
        vocab[string] = len(vocab)
    one = bpe.WordBpe(vocab, [["abc", "d</w>"], ["ab", "c"], ["a", "b"], ["b", "c"]], "</w>")
    assert not one.sound[vocab["abc"]] and not one.sound[vocab["abcd</w>"]]
    tokens, counts, merged = one.encode([b"abcd", b"abca", b"bcd"])
    assert tokens.tolist() == [vocab["abcd</w>"], vocab["abc"], vocab["a</w>"], vocab["bc"], vocab["d</w>"]]


