"""Input splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITIONS = "spark.loomwright.inputPartitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows out to ``partitions`` tasks, or to the number in the setting ``spark.loomwright.inputPartitions``.

    For work that is heavy per row on a few unsplittable files. Without either number the input stays as it is; the size of
    the input plays no part.
    """
    partitions = partitions or int(df.sparkSession.conf.get(PARTITIONS, "0"))
    return df.repartition(partitions) if partitions else df
