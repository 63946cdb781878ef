"""Readers for items, vectors and the tables the package writes."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.operators.labels import LabelMapping
from facetry.operators.network import Network

# Cell contents that count as missing in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop_path(spark, path)
    return fs.exists(where)


#: What the text of a whole, a broken, a boolean and a date cell looks like.
WHOLE = r"^[+-]?[0-9]{1,19}$"
BROKEN = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]{1,3})?$"
BOOLEAN = r"^(?i)(true|false)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def infer_types(raw: DataFrame) -> dict[str, str]:
    """The narrowest type that every value of a column of strings has.

    Whole numbers, then numbers; truth values; dates; else strings. Mixed kinds are strings, as are whole
    numbers beyond 64 bits and columns without a value. One map-side aggregate for all columns.
    """
    kinds = {
        "n": lambda c: c.isNotNull(),
        "whole": lambda c: c.rlike(WHOLE) & c.try_cast("bigint").isNotNull(),
        "broken": lambda c: c.rlike(BROKEN),
        "boolean": lambda c: c.rlike(BOOLEAN),
        "date": lambda c: c.rlike(DATE) & c.try_cast("date").isNotNull(),
    }
    counts = [F.struct(*[F.count_if(F.coalesce(is_kind(F.col(f"`{c}`")), F.lit(False))).alias(k) for k, is_kind in kinds.items()]).alias(f"c{i}")
              for i, c in enumerate(raw.columns)]
    row, out = raw.agg(*counts).first(), {}
    for i, c in enumerate(raw.columns):
        found = row[f"c{i}"]
        whole, broken, n = found["whole"], found["broken"], found["n"]
        fits = [(whole == n, "bigint"), (whole + broken == n, "double"), (found["boolean"] == n, "boolean"), (found["date"] == n, "date")]
        out[c] = next((kind for ok, kind in fits if ok and n), "string")
    return out


def load_items(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = False, multi_line: bool = True
) -> DataFrame:
    """Read ``.parquet``, ``.csv`` or ``.gz`` (taken as CSV) items.

    CSV cells may hold quoted line breaks, which makes a file unsplittable: convert
    large inputs to Parquet once, or say ``multi_line=False`` where no cell has one. Missing-value
    tokens become null. Without a schema columns are strings, or with ``infer`` of the narrowest
    type that all their values have, which reads the file once more.
    """
    path = os.path.expanduser(path)
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix not in (".parquet", ".csv", ".gz"):
        raise ValueError(f"unsupported file format: {suffix}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if suffix == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    if schema is None:
        raw = reader.csv(path)
    else:
        target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in target])
        raw = reader.schema(text).csv(path)
    cleaned = [F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    df = raw.select(*cleaned)
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in target])
    elif infer:
        df = df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in infer_types(df).items()])
    return df


def load_vectors(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """Read vectors and require one width for all that are present."""
    df = spark.read.parquet(path)
    widths = df.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if widths.low != widths.high:
        raise ValueError(f"vectors of {widths.low} to {widths.high} entries in {path}")
    return df


def complete(spark: SparkSession, path: str) -> bool:
    """A table that its writer finished, not one half written."""
    return exists(spark, f"{path}/_SUCCESS")


def load_negatives(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not {"item_id", "pos", "neg_id"} <= set(df.columns):
        raise ValueError(f"{path} is no (item_id, pos, neg_id) table")
    return df


def load_labels(spark: SparkSession, path: str) -> LabelMapping:
    table = spark.read.parquet(path)
    if not {"attribute", "label", "idx"} <= set(table.columns):
        raise ValueError(f"{path} is no (attribute, label, idx) table")
    return LabelMapping(table)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_augmentation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_network(spark: SparkSession, path: str, shape: dict | None = None) -> Network:
    """Read weights; the hyperparameters come from beside them unless given."""
    if shape is None:
        if not exists(spark, f"{path}/shape"):
            raise ValueError(f"no hyperparameters at {path}; pass shape=")
        shape = read_json(spark, f"{path}/shape")
    # One row per row of a weight matrix, so the size is that of the network.
    return Network.from_rows(shape, spark.read.parquet(f"{path}/weights").collect())
