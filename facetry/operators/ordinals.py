"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import stage


def with_ordinal(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add ``name`` = 0-based position in ``order_by`` order (which must be unique).

    One range shuffle puts the rows in order; a staged copy keeps each row's partition
    and its place there. The partition sizes, one row per partition, give the offsets.
    """
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stage(
        rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()),
        "ordinals",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    ordinal = (F.col("_place") + F.col("_shift")).alias(name)
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, ordinal)
