"""Exact train/validation split by a seeded hash, without sorting the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 3  # hex digits refined per pass: at most 4096 groups


def split_order(item_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(item_id).cast("string"), F.lit(str(seed))))


def split_threshold(df: DataFrame, item_id: str, validation_split: float, seed: int) -> str | None:
    """Hash from which on rows are validation rows; exactly ``int(n * split)`` of them.

    Each pass counts rows by the next hex digits of the hash, so only up to 4096 counts
    reach the driver, and narrows the search to one group until it holds few rows.
    """
    hashes = df.select(split_order(item_id, seed).alias("h"))
    prefix, above, wanted = "", 0, None
    while True:
        size = len(prefix) + PREFIX
        rows = hashes.filter(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, size).alias("p")).count()
        counts = sorted((r["p"], r["count"]) for r in rows.collect())
        if wanted is None:
            wanted = int(sum(n for _, n in counts) * validation_split)
            if wanted == 0:
                return None
        for p, n in reversed(counts):
            if above + n >= wanted:
                prefix, inside = p, n
                break
            above += n
        if inside <= 4096 or size >= 32:
            top = hashes.filter(F.col("h").startswith(prefix)).orderBy(F.desc("h")).limit(wanted - above)
            return top.agg(F.min("h")).first()[0]


def split_items(df: DataFrame, item_id: str = "item_id", validation_split: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: ``train`` or ``validation``."""
    threshold = split_threshold(df, item_id, validation_split, seed)
    if threshold is None:
        return df.withColumn("split", F.lit("train"))
    late = split_order(item_id, seed) >= threshold
    return df.withColumn("split", F.when(late, "validation").otherwise("train"))
