"""Cleaning of the item table: filters, exact duplicates, identifiers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import composite
from facetry.operators.lookup import attach
from facetry.operators.ordinals import with_ordinal
from facetry.session import stage, unpivot

# Names of index columns left over from earlier exports, with the name
# Spark gives to an empty CSV header.
STRAY_COLUMNS = ["X", "Unnamed: 0", "_c0"]


def drop_stray_columns(df: DataFrame) -> DataFrame:
    return df.drop(*STRAY_COLUMNS)


def drop_missing_text(df: DataFrame, text_col: str) -> DataFrame:
    return df.na.drop(subset=[text_col]) if text_col in df.columns else df


def drop_missing_attributes(df: DataFrame, attribute_cols: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=attribute_cols)


def _digest(text_col: str) -> Column:
    return F.sha2(F.col(text_col), 256)


def _first_of_text(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """The order value of the first row of each distinct text.

    Only (digest, order) pairs are aggregated, map-side first, so a text held by a third
    of the rows costs one partial row per task.
    """
    return df.groupBy(_digest(text_col).alias("_digest")).agg(F.min(order_col).alias(order_col)).select(order_col)


def keep_first(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """One row per distinct text, the lowest ``order_col`` (which must be unique).

    The rows join by their unique order value and never meet in a group.
    """
    return df.join(_first_of_text(df, text_col, order_col), order_col, "left_semi")


def _attach_ids(df: DataFrame, kept: DataFrame, order_col: str, prefix: str, name: str) -> DataFrame:
    """Rows whose order value is in ``kept``, numbered in that order."""
    ids = with_ordinal(kept, [order_col], "_ordinal")
    label = F.concat(F.lit(prefix), (F.col("_ordinal") + 1).cast("string")).alias(name)
    return df.join(ids, order_col).select(*[c for c in df.columns if c != name], label)


def assign_ids(df: DataFrame, order_col: str, prefix: str = "W", name: str = "id") -> DataFrame:
    """``prefix`` + 1-based position in input order.

    Only the order values are sorted; the rows are shuffled once, to meet their number.
    """
    return _attach_ids(df, df.select(order_col), order_col, prefix, name)


def clean_items(
    df: DataFrame,
    order_col: str,
    text_col: str = "description",
    attribute_cols: list[str] | None = None,
    remove_duplicates: bool = True,
    drop_missing: bool = True,
    create_id: bool = True,
    id_prefix: str = "W",
) -> DataFrame:
    """Stray columns, missing text, missing attributes, duplicates, ids, in this order."""
    df = drop_stray_columns(df)
    if drop_missing:
        df = drop_missing_text(df, text_col)
        if attribute_cols:
            df = drop_missing_attributes(df, attribute_cols)
    distinct = remove_duplicates and text_col in df.columns
    if distinct and create_id:
        # One shuffle of the rows drops the duplicates and brings the numbers.
        return _attach_ids(df, _first_of_text(df, text_col, order_col), order_col, id_prefix, "id")
    if distinct:
        return keep_first(df, text_col, order_col)
    return assign_ids(df, order_col, id_prefix) if create_id else df


def clean_report(df: DataFrame, text_col: str, attribute_cols: list[str] | None = None) -> DataFrame:
    """Rows left after each cleaning step, from a single aggregate."""
    has_text = F.col(text_col).isNotNull()
    complete = has_text
    for c in attribute_cols or []:
        complete = complete & F.col(c).isNotNull()
    counts = df.agg(
        F.count("*").alias("initial"),
        F.count_if(has_text).alias("with_text"),
        F.count_if(complete).alias("complete"),
        F.countDistinct(F.when(complete, _digest(text_col))).alias("distinct_text"),
    )
    return unpivot(counts, [], {c: F.col(c) for c in counts.columns}, "step", "n_rows")


def filter_frequent(df: DataFrame, column: str, min_count: int = 100, spread_by: str | None = None) -> DataFrame:
    """Rows whose value of ``column`` occurs at least ``min_count`` times; nulls never do.

    The counts are a map-side aggregate of one column, kept as a small table; with it
    broadcast, the rows are filtered where they are read.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    frequent = stage(counts.filter(F.col("count") >= min_count).select(column), "frequent")
    return attach(df, frequent, [column], "left_semi", spread_by=spread_by)


def add_composite(df: DataFrame, columns: list[str], new_col: str, separator: str = " ") -> DataFrame:
    return df.withColumn(new_col, composite([F.col(c) for c in columns], separator))


def summarise(df: DataFrame, attribute_cols: list[str]) -> DataFrame:
    """Per attribute: distinct values and nulls, with the table's size. Absent columns are skipped."""
    present = [c for c in attribute_cols if c in df.columns]
    aggregates = [F.count("*").alias("_rows")]
    for c in present:
        aggregates += [F.countDistinct(c).alias(f"_d_{c}"), F.count_if(F.col(c).isNull()).alias(f"_m_{c}")]
    row = df.agg(*aggregates).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))
    stats = {c: F.struct(F.col(f"_d_{c}").alias("d"), F.col(f"_m_{c}").alias("m")) for c in present}
    return unpivot(row, ["_rows", "n_columns"], stats, "attribute", "s").select(
        "attribute",
        F.col("_rows").alias("n_rows"),
        "n_columns",
        F.col("s.d").alias("n_unique"),
        F.col("s.m").alias("n_missing"),
    )


def sketch_attributes(df: DataFrame, attribute_cols: list[str], precision: int = 12) -> DataFrame:
    """``attribute, n_rows, n_missing, sketch``: what ``summarise`` says, in a form that can be added to.

    Distinct values are kept as a HyperLogLog sketch of ``2^precision`` registers, so one pass serves any number
    of attributes, and sketches of parts of a table make that of the whole.
    """
    aggregates = []
    for c in attribute_cols:
        sketch = F.hll_sketch_agg(F.col(c).cast("string"), precision)
        aggregates.append(F.struct(F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_missing"), sketch.alias("sketch")).alias(f"_{c}"))
    return unpivot(df.agg(*aggregates), [], {c: F.col(f"_{c}") for c in attribute_cols}, "attribute", "s").select("attribute", "s.*")


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of tables laid one after the other."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("attribute").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.hll_union_agg("sketch").alias("sketch"))


def summarise_sketches(sketches: DataFrame) -> DataFrame:
    """``attribute, n_rows, n_unique, n_missing``; ``n_unique`` is off by about ``1.04 / 2^(precision / 2)`` of its value."""
    return sketches.select("attribute", "n_rows", F.hll_sketch_estimate("sketch").alias("n_unique"), "n_missing")


def select_attributes(df: DataFrame, specs: list[str], keep: list[str]) -> DataFrame:
    """``name:column`` or ``name``: the columns of ``keep`` and each attribute under its name."""
    chosen = [F.col(column).alias(name) for name, column in parse_attributes(specs).items()]
    return df.select(*keep, *chosen)


def parse_attributes(specs: list[str]) -> dict[str, str]:
    pairs = (spec.partition(":") for spec in specs)
    return {name: column or name for name, _, column in pairs}


def align(items: DataFrame, vectors: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Items with their vectors, by id. Both sides are unique on the id, so nothing skews."""
    return items.join(vectors, item_id)


