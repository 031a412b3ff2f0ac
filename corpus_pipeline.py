"""A corpus from raw documents: toxic texts out, one of each near-duplicate group, no benchmark leaks, no secrets, mixed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
Nulls in any column, empty texts, repeated rows and empty tables pass through every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, factorization, mixing, odd_sketch, secrets
from loomwright.llm.common import DOCUMENT_COLUMNS, cut, document_key
from loomwright.session import configure

SHINGLE_WORDS = 5
SIMILARITY = 80

#: No SQL twin: the toxicity stage is a trained model.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the package goes to the Python workers with the first one, also where a stage is called alone."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a score of ``factorization.THRESHOLD`` or more; the machine learns from the labelled rows."""
    machine = factorization.train(factorization.training_rows(docs, _table(spark, sf_dir, "labels")))
    return factorization.score(docs.select(*DOCUMENT_COLUMNS), machine).filter(F.col("score") < factorization.THRESHOLD).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id (null first) of each group of near duplicates, and one of equal rows."""
    keyed = docs.select(document_key(docs).alias("key"), F.struct(*DOCUMENT_COLUMNS).alias("row"))
    # ids may be null or repeated, so the key stands for the document
    groups = odd_sketch.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text"), n=SHINGLE_WORDS, percent=SIMILARITY)
    linked = groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"))
    members = keyed.select("key", "row.doc_id").join(linked, "key")
    best = members.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    return keyed.join(best, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage within the edit budget of a benchmark item."""
    return decontaminate.without_items(docs.select(*DOCUMENT_COLUMNS), _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text. Documents stay."""
    found, _ = secrets.scan(docs.select(*DOCUMENT_COLUMNS))
    clean = F.when(F.size("findings") > 0, secrets.redact(F.col("text"), F.col("findings"))).otherwise(F.col("text"))
    return found.withColumn("text", clean).withColumn(
        "n_chars", F.when(F.size("findings") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with ``size, source_size, target, taken``."""
    key = document_key(docs).alias("key")
    mixed = mixing.mix_sources(docs.select(key.alias("doc_id"), "source", "text")).filter("taken > 0").withColumnRenamed("doc_id", "key").dropDuplicates(["key"])
    return docs.select(*DOCUMENT_COLUMNS, key).join(mixed, "key").drop("key")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again by the next stage."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
