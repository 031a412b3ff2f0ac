"""Positions inside large groups, and small helpers for top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import cut_lineage


def positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Add ``position`` (1-based) and ``group_size`` per key without putting a whole key into one task.

    ``bucket`` must rise with the order (an hour, a day). Rows are numbered inside (key, bucket) and shifted by the
    number of rows in earlier buckets, so a key that holds most of the data spreads over as many tasks as it has
    buckets; the only per-key window runs over one row per bucket.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
    )
    inside = tagged.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    names = [*keys, "_bucket"]
    left, right = inside.alias("l"), offsets.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names]
    joined = left.join(right, same)
    return joined.select(
        *[F.col(f"l.{name}") for name in df.columns], (F.col("_row") + F.col("_before")).alias("position"), "group_size"
    )


def range_positions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``position`` (1-based) and ``group_size`` per key for any spread of values.

    Rows are sorted into sampled ranges of (keys, order), written, and numbered by their place in the range and the number of
    rows in the ranges before; a key begins at its least number. So one key, one day or one first letter may hold all rows:
    it lies in as many tasks as any other rows. ``order`` should tell the rows of a key apart. Null keys are one key.
    """
    sorted_rows = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    numbered = sorted_rows.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    offsets = cut_lineage(sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    placed = numbered.join(offsets, "_part").withColumn("_at", F.col("_at") + F.col("_before") + 1).drop("_part", "_before")
    if not keys:
        return placed.withColumnRenamed("_at", "position").withColumn("group_size", F.lit(sizes.agg(F.sum("_n")).scalar()))
    begins = placed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_at").alias("_first"), F.count("*").alias("group_size"))
    joined = placed.join(begins, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias("position"), "group_size")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, offset: int = 0, name: str = "rank") -> DataFrame:
    """Rows ``offset + 1`` to ``offset + n`` per key; the row-number filter is applied before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n + offset)
    return ranked.filter(F.col(name) > offset) if offset else ranked


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a fixed order, with the ``total`` number of rows before paging."""
    total = df.select(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total.scalar())
