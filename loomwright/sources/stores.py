"""Table stores: event and questionnaire intake, the chunk store, relational tables, recording manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import chunking as C

c = F.col


def intake_events(raw: DataFrame) -> DataFrame:
    """Posted events with defaults: missing task, session and source are '', params become JSON."""
    texts = {n: F.coalesce(c(n), F.lit("")) for n in ("task_id", "session_id", "source")}
    params = c("params") if dict(raw.dtypes)["params"] == "string" else F.to_json("params")
    return raw.withColumns(texts).withColumn("params", F.coalesce(params, F.lit("{}")))


def intake_questionnaires(raw: DataFrame) -> DataFrame:
    """Posted answers ARRAY<STRUCT<qid, value>> to the stored JSON array."""
    texts = {n: F.coalesce(c(n), F.lit("")) for n in ("task_id", "session_id", "source")}
    return raw.withColumns(texts).withColumn("answers", F.coalesce(F.to_json("answers"), F.lit("[]")))


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Relational scan; filters and columns chosen later are pushed into the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def upsert_chunks(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store with the batch added; a chunk id in the batch replaces the stored row."""
    return store.join(batch.select("chunk_id"), "chunk_id", "left_anti").unionByName(batch)


def delete_chunks(store: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true; null counts as not true."""
    return store.filter(~F.coalesce(predicate, F.lit(False)))


def deleted_count(store: DataFrame, predicate: Column) -> DataFrame:
    return store.agg(F.count_if(F.coalesce(predicate, F.lit(False))).alias("deleted"))


def reindex(store: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Chunk the given documents again and put them in place of their stored chunks.

    ``documents(doc_id, user_id, text)``; only the owner of the stored chunks may re-index, and the new chunks keep
    the former ``kb_id``.
    """
    former = store.groupBy("doc_id", "user_id").agg(F.min_by("kb_id", "chunk_index").alias("kb_id"))
    allowed = documents.join(former, ["doc_id", "user_id"])
    fresh = C.with_chunk_rows(C.chunk(allowed, "fixed", **options), "doc_id")
    kept = store.join(allowed.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(fresh.select(*store.columns))


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace only the partitions that ``rows`` touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def recording_manifest(paths: DataFrame, subjects: DataFrame) -> DataFrame:
    """Recording files ``.../SubjectNN_K...`` with the subject's age, gender and count quality."""
    rows = paths.select(
        "path", F.regexp_extract("path", "(Subject\\d+)_\\d", 1).alias("subject"), F.regexp_extract("path", "Subject\\d+_(\\d)", 1).cast("int").alias("part")).filter("subject <> ''")
    return rows.join(subjects, "subject", "left")


SUBJECT_INFO = "subject string, age int, gender string, recording_year int, subtractions double, count_quality int"


def read_subject_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SUBJECT_INFO)
