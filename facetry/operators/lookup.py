"""Joins of a large table to a table with one row per key.

The small side is broadcast only after its size was measured. Beyond the limit the
join shuffles, and keys that hold very many fact rows are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEY_ROWS = 1_000_000


def fits_broadcast(dim: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure the rows and text of ``dim`` (a small or staged table)."""
    size = F.octet_length(F.to_json(F.struct("*"))) + 64
    return (dim.agg(F.sum(size)).first()[0] or 0) <= limit


def attach(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: str | None = None,
    small: bool | None = None,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Join ``dim`` (unique on ``on``) to ``facts``.

    ``spread_by`` is a fact column with many values; it spreads the rows of a hot key.
    ``small`` is the outcome of ``fits_broadcast`` where the caller has measured already.
    """
    if fits_broadcast(dim) if small is None else small:
        return facts.join(F.broadcast(dim), on, how)
    if spread_by is None:
        return facts.join(dim, on, how)
    return salted_join(facts, dim, on, how, spread_by, hot_rows)


def salted_join(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str, spread_by: str, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Shuffle join in which each hot key is spread over several salts.

    Counting the keys is a map-side aggregate of the key columns. At most
    ``rows / hot_rows`` keys can be hot, which bounds the broadcast.
    """
    salts = F.ceil(F.count("*") / hot_rows).cast("int").alias("_salts")
    hot = facts.groupBy(*on).agg(salts).filter("_salts > 1")
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1)))
    spread = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
    copied = dim.join(F.broadcast(hot), on, "left").select(*dim.columns, copies)
    return spread.join(copied, [*on, "_salt"], how).drop("_salt")
