"""Vectors of the labels alone, as a comparison to vectors of the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import vectors
from facetry.functions.text import normalise_label, plain_label
from facetry.operators.encode import Encoder, encode_texts
from facetry.operators.lookup import attach
from facetry.session import stage, unpivot


def label_vectors(
    df: DataFrame,
    composite_col: str,
    plain_col: str,
    make_encoder: Callable[[], Encoder],
    width: int,
    item_id: str = "item_id",
) -> DataFrame:
    """``(item_id, region, varietal, combined)``: the label vectors of each item.

    Each distinct label is encoded once and joined back. Empty labels get zeros. The
    composite label has its separator turned into a blank first.
    """
    labels = {"region": normalise_label(F.col(composite_col)), "varietal": plain_label(F.col(plain_col))}
    rows = df.select(item_id, *[c.alias(f"_{n}") for n, c in labels.items()])
    distinct = unpivot(rows, [], {n: F.col(f"_{n}") for n in labels}, "kind", "label").select("label").distinct()
    filled = distinct.filter(F.col("label") != "")
    encoded = encode_texts(filled.withColumn("key", F.col("label")), "key", "label", make_encoder, "local", width=width)
    known = stage(encoded.filter("status = 'ok'").select("key", "embedding"), "label-vectors")
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    for name in labels:
        dim = known.select(F.col("key").alias(f"_{name}"), F.col("embedding").alias(name))
        rows = attach(rows, dim, [f"_{name}"], spread_by=item_id)
        rows = rows.withColumn(name, F.when(F.col(f"_{name}") == "", zero).otherwise(F.col(name)))
    return rows.select(item_id, *labels, F.concat(*[F.col(n) for n in labels]).alias("combined"))


def zero_counts(df: DataFrame, names: tuple[str, ...] = ("region", "varietal")) -> DataFrame:
    """Per label kind the number of items whose vector is zero."""
    row = df.agg(F.count("*").alias("n_items"), *[F.count_if(vectors.all_near_zero(F.col(n))).alias(n) for n in names])
    return unpivot(row, ["n_items"], {n: F.col(n) for n in names}, "kind", "n_zero")


def baselines(df: DataFrame, composite_col: str, plain_col: str, encoders: dict[str, tuple[Callable[[], Encoder], int]],
              item_id: str = "item_id") -> dict[str, DataFrame]:
    """One label-vector table per named encoder, given as ``(make_encoder, width)``."""
    return {name: label_vectors(df, composite_col, plain_col, make, width, item_id) for name, (make, width) in encoders.items()}
