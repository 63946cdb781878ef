import math

from pyspark.sql import functions as F

from facetry.functions import vectors
from facetry.operators import metrics


def test_ties_and_absent_classes(spark):
    rows = [(0, [1.0, 1.0, 0.0]), (1, [1.0, 1.0, 0.0]), (1, [0.0, 2.0, 0.0]), (0, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "t int, logits array<double>")
    pred = metrics.ranked_predictions(df, "x", "t", "logits")
    assert [r.predicted for r in pred.collect()] == [0, 0, 1, 1]
    m = metrics.attribute_metrics(pred).first()
    assert (m.accuracy, m.top_5_accuracy, m.num_classes, m.num_classes_in_data, m.num_samples) == (0.5, 0.5, 3, 2, 4)
    assert math.isclose(m.macro_f1, 0.5) and math.isclose(m.weighted_f1, 0.5)


def test_top_five_with_six_classes_and_never_predicted(spark):
    rows = [(5, [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]), (4, [6.0, 5.0, 4.0, 3.0, 2.0, 2.0]), (5, [6.0, 5.0, 4.0, 3.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "t int, logits array<double>")
    m = metrics.attribute_metrics(metrics.ranked_predictions(df, "x", "t", "logits")).first()
    assert m.accuracy == 0 and m.macro_f1 == 0 and math.isclose(m.top_5_accuracy, 1 / 3)


def test_vector_functions(spark):
    nan = float("nan")
    rows = [([1.0, 2.0],), ([nan, 1.0],), (None,), ([1.0],), ([0.0, 0.0],), ([float("inf"), 1.0],), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(vectors.valid(F.col("v"), 2)).collect()] == [True, False, False, False, True, True, False]
    assert [r[0] for r in df.select(vectors.nonzero(F.col("v"))).limit(5).collect()] == [True, True, False, True, False]
    assert df.limit(1).select(vectors.normalise(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]
    value = df.limit(1).select(vectors.contrastive_term(F.array(F.lit(1.0), F.lit(-1.0)), 0.001)).first()[0]
    assert math.isclose(value, 1000.0)
    try:
        vectors.blocks(F.col("v"), ["a", "b"], 3)
    except ValueError:
        return
    raise AssertionError("an uneven split must fail")
