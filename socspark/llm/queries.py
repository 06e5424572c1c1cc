"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, decontaminate, html_text, kmeans, langid, near_dup, packing, pii, prefix_trie, quality_rules, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.classify(docs.select("doc_id", "text"), classifier.fit(docs)).select("doc_id", "quality_score", "keep")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train(docs))
    count = lambda kind: F.size(secrets.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}")
    base = secrets.of_kind(F.col("spans"), "assign", "access", "hex")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.training_fold()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (~langid.training_fold()).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="registered-query").select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_match", "longest_at")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_packing, op2_html_text, op3_quality_classifier, op4_quality_rules, op5_warc, op6_secrets, op7_language_id, op8_near_duplicates, op9_pii, op10_decontamination, op11_centroid_clustering, op12_prefix_trie, op13_word_bpe)
    return {f.__name__: f for f in (*operators, pipeline)}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, len(l) - len(list_distinct(l)) AS n FROM (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)),
m AS (SELECT d.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, ln.n AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_upper, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) AS n_digit
  FROM d JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_upper > 5 * n_words OR 10 * n_digit > 3 * n_words) AS kept
FROM b"""

OP5_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS dg, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT dg, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY dg)
SELECT page_id, n AS payload_bytes, dg AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (dg)"""

ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ITEM_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, {ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT bid, item_id, p, s, array_to_string(w[p:p+s-1], ' ') AS k FROM (SELECT *, least(10, len(w)) AS s, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, s, array_to_string(w[i:i+s-1], ' ') AS k FROM (SELECT rid, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM win) WHERE len(w) >= s)),
hit AS (SELECT rid, i, win.s, bid, item_id, p FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + s)) AS q FROM hit) GROUP BY rid),
item AS (SELECT rid, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM (SELECT DISTINCT rid, item_id::VARCHAR AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY rid),
run AS (SELECT rid, min(i) - 1 AS start, max(i + s) - min(i) AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, bid, i - p ORDER BY i) AS g FROM hit) GROUP BY rid, bid, i - p, g),
best AS (SELECT rid, max(size) AS size, min(start) FILTER (WHERE size = top) AS start FROM (SELECT *, max(size) OVER (PARTITION BY rid) AS top FROM run) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(best.size, 0) AS longest_match, coalesce(best.start, -1) AS longest_at
FROM d LEFT JOIN covered USING (rid) LEFT JOIN item USING (rid) LEFT JOIN best USING (rid)"""


def clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """k-means in whole numbers, one pair of steps a round."""
    steps = [
        """v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY s, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS s, e FROM v WHERE vec_id IS NOT NULL ORDER BY s, e LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT rid, best.c AS c, best.d AS d FROM (SELECT rid, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c{r}.e[i]) * (v.e[i] - c{r}.e[i])))::BIGINT, c := c{r}.c)) AS best
  FROM v, c{r} GROUP BY rid))""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (SELECT c, coalesce(m.e, c{r}.e) AS e FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e
  FROM (SELECT c, i, sum(e[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (rid), (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (c)"""


OP12_SQL = """
WITH t AS (SELECT c, role, tx, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || tx), 30)) - 1 AS p
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS tx FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda w, i: xor(w >> 1, 3988292384 * (w & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
conv AS (SELECT own.c, h, least(h, coalesce(n, 0)) AS k FROM own LEFT JOIN (SELECT c, count(*) AS n FROM t GROUP BY c) b ON b.c = own.c - own.c % 100),
turns AS (SELECT conv.c, p AS d, role, tx FROM conv JOIN t ON t.c = conv.c - conv.c % 100 WHERE p < h
  UNION ALL SELECT c, p - h + k AS d, role, tx FROM conv JOIN t USING (c) WHERE p >= h),
seq AS (SELECT conv.c, coalesce(s, []) AS s, coalesce(z, []) AS z FROM conv LEFT JOIN (SELECT c, list(length(role) || ':' || role || tx ORDER BY d) AS s, list(length(tx) ORDER BY d) AS z FROM turns GROUP BY c) USING (c)),
node AS (SELECT d, k, min(c) AS m, count(*) AS n, max(CASE WHEN d > 0 THEN z[d] ELSE 0 END) AS size, string_agg(CASE WHEN len(s) = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM (SELECT *, s[1:d] AS k FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seq)) GROUP BY d, k),
kid AS (SELECT d - 1 AS d, k[1:d-1] AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT a AS d, k[1:a] AS k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved
  FROM (SELECT node.*, kids, unnest(range(0, node.d + 1)) AS a FROM node LEFT JOIN kid ON kid.d = node.d AND kid.k = node.k) GROUP BY 1, 2)
SELECT node.m AS conv_id, node.d AS depth, up.m AS parent_conv_id, node.n AS n_convs, coalesce(kids, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.d = node.d AND below.k = node.k LEFT JOIN kid ON kid.d = node.d AND kid.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.k[1:node.d-1]"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": clustering_sql(), "op12_prefix_trie": OP12_SQL, "op4_quality_rules": OP4_SQL, "op5_warc": OP5_SQL, "op10_decontamination": OP10_SQL}
