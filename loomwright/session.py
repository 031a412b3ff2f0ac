"""Session settings and lineage control shared by all jobs."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # rows of ``dealt`` come sorted as they were written
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that right results (UTC, map merge) and bounded disk need and give the package to the Python workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so their Python workers import it from any folder."""
    context = spark.sparkContext
    if getattr(context, "_loomwright_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # not so when the package itself was started from an archive, which Spark has sent already
        base = os.path.join(tempfile.mkdtemp(prefix="loomwright-package-"), "loomwright_package")
        context.addPyFile(shutil.make_archive(base, "zip", root, "loomwright"))
    context._loomwright_sent = True


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="loomwright-ckpt-")
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, which all executors reach."""
    _ensure_checkpoint_dir(spark)
    _remove_unread(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _remove_unread(spark: SparkSession) -> None:
    """Remove the folders that no plan reads any more, as Spark's cleaner does with checkpoints."""
    context, jvm = spark.sparkContext, spark._jvm
    folders, context._loomwright_folders = getattr(context, "_loomwright_folders", []), []
    if folders:
        jvm.System.gc()  # a driver with much memory would hold on to plans, and so to files, for long
    for reader, path in folders:
        if reader.get() is not None:
            context._loomwright_folders.append((reader, path))
        else:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _read_from(df: DataFrame, path: str) -> DataFrame:
    """``df``, a plain read of ``path``, noted so that the folder goes once nothing derived from ``df`` is left."""
    files = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    context = df.sparkSession.sparkContext
    context._loomwright_folders = [*getattr(context, "_loomwright_folders", []), (context._jvm.java.lang.ref.WeakReference(files), path)]
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of any executor."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: for large rows of which later steps read a few columns."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return _read_from(df.sparkSession.read.schema(df.schema).parquet(path), path)


def dealt(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """``df`` written to the shared folder as Parquet in ``tasks`` sorted buckets by ``keys`` and read back.

    Unlike a checkpoint it is compressed by column, and later groupings and joins by the keys neither move nor sort it. The
    table is dropped from the catalog at once; its files stay for the plans that read them.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "dealt")
    table = f"loomwright_{path[-32:]}"
    rows = df.repartition(tasks, *keys).write.bucketBy(tasks, *keys).sortBy(*keys)
    rows.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    try:
        return _read_from(spark.table(table), path)
    finally:
        spark.sql(f"DROP TABLE {table}")


def tasks_for(*tables: DataFrame, rows: int = 1_000_000) -> int:
    """Shuffle tasks of about ``rows`` rows of the tables each, as many as the session has at least.

    A session's number is fixed, so the rows of a task, and its memory, would grow with the input. Tables are counted by
    their footers.
    """
    counted = reduce(DataFrame.union, [x.select(F.lit(1)) for x in tables]).count()
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted // rows))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Replace columns through a one-row generator.

    Filters on the new columns would otherwise be pushed below and repeat the whole expression per use.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[n for n in df.columns if n not in columns], F.inline(F.array(row)))
