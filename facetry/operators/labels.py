"""Label strings to class numbers and back."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.lookup import attach, fits_broadcast
from facetry.operators.ordinals import with_ordinal
from facetry.session import stage, unpivot


class LabelMapping:
    """A fitted table ``(attribute, label, idx)``; idx is 0-based in label order."""

    def __init__(self, table: DataFrame):
        self.table = table

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Classes per attribute; one row per attribute reaches the driver."""
        rows = self.table.groupBy("attribute").count().collect()
        return {r["attribute"]: r["count"] for r in sorted(rows)}

    @cached_property
    def small(self) -> bool:
        """Whether all labels together may be broadcast; measured once."""
        return fits_broadcast(self.table)

    def of(self, attribute: str) -> DataFrame:
        return self.table.filter(F.col("attribute") == attribute).select("label", "idx")

    def transform(
        self,
        df: DataFrame,
        columns: dict[str, str],
        null_label: str = "",
        on_unknown: str = "error",
        spread_by: str | None = None,
    ) -> DataFrame:
        """Add ``<attribute>_idx`` for each attribute -> column pair.

        A label that was not seen at fit time fails the job with the label in the
        message, or becomes null with ``on_unknown="null"``.
        """
        for attribute, column in columns.items():
            key, idx = f"_label_{attribute}", f"{attribute}_idx"
            known = self.of(attribute).select(F.col("label").alias(key), F.col("idx").alias(idx))
            keyed = df.withColumn(key, F.coalesce(F.col(column).cast("string"), F.lit(null_label)))
            df = attach(keyed, known, [key], spread_by=spread_by, small=self.small)
            if on_unknown == "error":
                message = F.concat(F.lit(f"unseen {attribute} label: "), F.col(key))
                checked = F.when(F.col(idx).isNull(), F.raise_error(message)).otherwise(F.col(idx))
                df = df.withColumn(idx, checked.cast("int"))
            df = df.drop(key)
        return df

    def class_names(self, df: DataFrame, columns: dict[str, str], spread_by: str | None = None) -> DataFrame:
        """Add ``<attribute>_name`` for each attribute -> class number column pair."""
        for attribute, column in columns.items():
            known = self.of(attribute).select(F.col("label").alias(f"{attribute}_name"), F.col("idx").alias(column))
            df = attach(df, known, [column], spread_by=spread_by, small=self.small)
        return df


def fit_labels(df: DataFrame, columns: dict[str, str], null_label: str = "") -> LabelMapping:
    """Number the distinct labels of each attribute -> column pair.

    Only the distinct labels are sorted, by a range shuffle over all attributes at once.
    """
    labels = {a: F.coalesce(F.col(c).cast("string"), F.lit(null_label)) for a, c in columns.items()}
    distinct = unpivot(df, [], labels, "attribute", "label").distinct()
    numbered = with_ordinal(distinct, ["attribute", "label"], "_ordinal")
    starts = numbered.groupBy("attribute").agg(F.min("_ordinal").alias("_start"))  # one row per attribute
    idx = (F.col("_ordinal") - F.col("_start")).cast("int").alias("idx")
    return LabelMapping(stage(numbered.join(F.broadcast(starts), "attribute").select("attribute", "label", idx), "labels"))


def count_classes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct labels per attribute, nulls counting as one empty label."""
    labels = {a: F.coalesce(F.col(c).cast("string"), F.lit("")) for a, c in columns.items()}
    row = df.agg(*[F.countDistinct(c).alias(a) for a, c in labels.items()])
    return unpivot(row, [], {a: F.col(a) for a in columns}, "attribute", "n_classes")
