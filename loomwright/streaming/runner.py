"""Run a streaming job to the end of the available input, for backfills, queries and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="loomwright-stream-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def run_to_watermark(stream: DataFrame) -> tuple[DataFrame, str | None]:
    """Process what is there, append the result to a table in the shared folder; return that table and the last watermark.

    Windows, sessions and unanswered rows that the watermark has not passed are not in the table; ``jobs.held_sessions`` and
    ``jobs.held_fusions`` give them.
    """
    spark, folder = stream.sparkSession, _shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    mark = (progress.get("eventTime") or {}).get("watermark") if progress else None
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), mark


def run_available(stream: DataFrame) -> DataFrame:
    """The table of :func:`run_to_watermark`, for jobs that hold nothing back."""
    return run_to_watermark(stream)[0]


def run_updates(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """As ``run_available`` for jobs in update mode; ``batch`` tells the micro-batch of a row.

    With ``keys`` only the last version of each key is kept, which includes windows that are still open.
    """
    from pyspark.sql import functions as F

    spark, folder = stream.sparkSession, _shared_folder(stream.sparkSession)

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/rows/b={batch}")

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").outputMode("update")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").drop("b")
    if keys is None:
        return rows
    fields = F.struct(*[n for n in rows.columns if n != "batch"])
    return rows.groupBy(*keys).agg(F.max_by(fields, "batch").alias("_last")).select("_last.*")
