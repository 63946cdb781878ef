"""Sinks: one Parquet folder per table, small settings as JSON text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.operators.labels import LabelMapping
from facetry.operators.network import Network


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Vectors, negatives, metrics, augmentation: any table as Parquet."""
    df.write.mode(mode).parquet(path)
    return path


def save_json(spark: SparkSession, content: dict, path: str) -> str:
    text = json.dumps(content, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def save_labels(mapping: LabelMapping | None, path: str) -> str:
    if mapping is None:
        raise RuntimeError("labels are not fitted")
    return save_table(mapping.table, path)


def save_network(spark: SparkSession, network: Network, path: str) -> str:
    save_table(network.to_frame(spark), f"{path}/weights")
    save_json(spark, network.shape, f"{path}/shape")
    return path


def fingerprint(df: DataFrame) -> dict:
    """Row count and an order-free checksum of a table."""
    row = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(*))").alias("x")).first()
    return {"rows": row.n, "checksum": row.x}
