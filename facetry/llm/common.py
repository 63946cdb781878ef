"""Shared pieces of the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 4
_kept: dict[str, object] = {}
HELD_OUT = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(column: Column | str) -> Column:
    """A text column, the null text being empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def is_held_out(key: Column | str) -> Column:
    """Rows whose crc32 of the key as text leaves the held-out remainder; a null key counts as empty text."""
    return F.pmod(F.crc32(whole(key)), F.lit(FOLDS)) == HELD_OUT


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept(name: str, make):
    """``make()``, remembered by a Python worker between tasks; one object at a time.

    Workers outlive stages, so what one operator remembers would take the memory of the next.
    """
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]
