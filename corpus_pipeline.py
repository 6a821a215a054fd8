"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, BPE. Counted as part of subpackage llm.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontam, pii, quality, simhash
from tidewatch.llm._common import delete, fresh_path, table, working_tables
from tidewatch.llm.queries import vocab_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return simhash.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away leave the texts; n_chars follows."""
    clean = pii.sanitise(pii.find(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    coded = bpe.encode(docs, vocab_path(), decoded_col="decoded")
    ids = F.col("token_ids")
    return coded.select(
        "doc_id", "lang", "source", "n_chars", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", sanitisation),
    ("BPE encoding and decoding", tokens),
]

#: SQL expresses neither the likelihood ratio nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over all that the others kept. A stage's working tables go as soon as its result is written, and the
    result when the next one's is; what the last stage reads stays, since it is lazy."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with working_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
