"""Classification metrics from logits, through confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import vectors
from facetry.session import stage

TOP_K = 5
AVERAGED = ["accuracy", "macro_f1", "weighted_f1", "top_5_accuracy"]


def ranked_predictions(df: DataFrame, attribute: str, truth: str, logits: str) -> DataFrame:
    """``(attribute, truth, predicted, in_top_5, num_classes)`` per row; ties go to the lower class."""
    best = vectors.best_classes(F.col(logits), TOP_K)
    return df.select(
        F.lit(attribute).alias("attribute"),
        F.col(truth).cast("int").alias("truth"),
        best.alias("_best"),
        F.size(logits).alias("num_classes"),
    ).select(
        "attribute", "truth", F.element_at("_best", 1).alias("predicted"),
        F.array_contains("_best", F.col("truth")).alias("in_top_5"), "num_classes")


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows per (attribute, true class, predicted class): one map-side aggregate."""
    return predictions.groupBy("attribute", "truth", "predicted").agg(
        F.count("*").alias("n"), F.count_if("in_top_5").alias("n_top_5"), F.max("num_classes").alias("num_classes"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Per attribute and class: tp, fp, fn, support, precision, recall, f1. 0/0 counts as 0."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("h")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )
    sums = counts.select("attribute", F.inline(sides)).groupBy("attribute", "class").agg(
        F.sum("h").alias("tp"), F.sum("p").alias("_predicted"), F.sum("t").alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("_predicted")), ratio(F.col("tp"), F.col("support"))
    scored = sums.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return scored.select(
        "attribute", "class", "tp", (F.col("_predicted") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"), "support", "precision", "recall",
        ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"))


def attribute_metrics(predictions: DataFrame) -> DataFrame:
    """One row per attribute. Macro F1 averages the classes that occur in the truth."""
    counts = stage(confusion(predictions), "confusion")
    overall = counts.groupBy("attribute").agg(
        (F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        (F.sum("n_top_5") / F.sum("n")).alias("_top_5"),
        F.max("num_classes").alias("num_classes"),
        F.sum("n").alias("num_samples"),
    )
    by_class = class_scores(counts).groupBy("attribute").agg(
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.count_if(F.col("support") > 0).cast("int").alias("num_classes_in_data"),
    )
    top_5 = F.when(F.col("num_classes") > TOP_K, F.col("_top_5")).otherwise(F.col("accuracy"))
    return overall.join(by_class, "attribute").select(
        "attribute", "accuracy", "macro_f1", "weighted_f1", top_5.alias("top_5_accuracy"),
        "num_classes", "num_classes_in_data", "num_samples")


def average_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in AVERAGED])
