"""From raw documents to packed sequences: the stages of the training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socspark.llm import decontaminate, langid, near_dup, packing, secrets
from socspark.llm.shared import fresh, stored

#: A document whose language has a smaller posterior than this is rejected.
LEAST_LANGUAGE_SCORE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go; an absent ``lang`` is filled in."""
    found = langid.identify(docs, langid.fit(docs.where(langid.training_fold())))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays, once; rows with a null id all stay.

    Different texts under one id are documents of their own. Of rows that repeat
    both id and text, the one whose other columns come first in order stays.
    """
    key = fresh(docs, "text_hash")[0]
    found = near_dup.near_duplicates(docs)
    chosen = found.where(F.col("is_representative") & F.col("doc_id").isNotNull()).select("doc_id", F.col("text_hash").alias(key)).distinct()
    kept = docs.withColumn(key, F.xxhash64("text")).join(chosen, ["doc_id", key], "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.groupBy("doc_id", key).agg(F.min(F.struct("text", *rest)).alias("row"))
    return one.select("doc_id", "row.*").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked and ``n_chars`` follows the text."""
    masked = secrets.redact(secrets.scan_secrets(docs, secrets.train(docs)))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each_class),
    ("decontaminate", drop_contaminated),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]

#: SQL cannot express language models, signatures or token packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
