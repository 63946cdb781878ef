import pytest
from pyspark.sql import functions as F

from facetry.operators import clean
from facetry.operators.lookup import attach, salted_join
from facetry.operators.ordinals import with_ordinal
from facetry.operators.split import split_items

SCHEMA = "pos long, description string, region string, X long"


def rows(spark, partitions=3):
    data = [(0, None, "a", 1), (1, "same", "a", 1), (2, "", "b", 1), (3, "same", "b", 1), (4, "line\nbreak", None, 1), (5, "last", "é", 1), (6, "", "b", 1)]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions, "description")


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_clean_order_and_ids(spark, partitions):
    out = clean.clean_items(rows(spark, partitions), "pos", attribute_cols=["region"])
    found = [(r.id, r.pos, r.description) for r in out.orderBy("pos").collect()]
    assert found == [("W1", 1, "same"), ("W2", 2, ""), ("W3", 5, "last")]
    assert "X" not in out.columns


def test_steps_can_be_switched_off(spark):
    kept = clean.clean_items(rows(spark), "pos", remove_duplicates=False, drop_missing=False, create_id=False)
    assert kept.count() == 7
    numbered = clean.clean_items(rows(spark), "pos", remove_duplicates=False, id_prefix="N")
    assert sorted(r.id for r in numbered.collect()) == [f"N{i}" for i in range(1, 7)]


def test_missing_text_column_is_skipped_and_missing_attribute_fails(spark):
    df = rows(spark).drop("description")
    assert clean.drop_missing_text(df, "description").count() == 7
    with pytest.raises(Exception):
        clean.drop_missing_attributes(df, ["nowhere"]).count()


def test_empty_table(spark):
    empty = rows(spark).filter("false")
    assert clean.clean_items(empty, "pos", attribute_cols=["region"]).count() == 0
    assert {r.n_rows for r in clean.clean_report(empty, "description", ["region"]).collect()} == {0}
    assert split_items(empty, "pos").count() == 0


def test_frequency_filter_never_keeps_nulls(spark):
    df = spark.createDataFrame([(None,)] * 5 + [("a",)] * 3 + [("b",)] * 2, "v string")
    assert [r.v for r in clean.filter_frequent(df, "v", 3).collect()] == ["a"] * 3


def test_composite_keeps_separator(spark):
    df = spark.createDataFrame([("France", None), (None, None)], "a string, b string")
    assert [r.c for r in clean.add_composite(df, ["a", "b"], "c", "#####").collect()] == ["France#####", "#####"]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(5, 30).select(F.col("id").alias("k"), *([F.lit(1).alias("v")] if how in ("left", "inner") else []))
    plain = sorted(map(tuple, facts.join(dim, "k", how).collect()), key=repr)
    assert sorted(map(tuple, salted_join(facts, dim, ["k"], how, "id", hot_rows=20).collect()), key=repr) == plain
    assert sorted(map(tuple, attach(facts, dim, ["k"], how, "id", small=False, hot_rows=20).collect()), key=repr) == plain
    assert sorted(map(tuple, attach(facts, dim, ["k"], how).collect()), key=repr) == plain


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_ordinals(spark, partitions):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v")).repartition(partitions)
    assert all(r.v == r.n for r in with_ordinal(df, ["v"], "n").collect())


@pytest.mark.parametrize("n, fraction", [(1000, 0.1), (1003, 0.25), (7, 0.1), (10, 1.0)])
def test_split_is_exact_and_stable(spark, n, fraction):
    df = spark.range(n).withColumnRenamed("id", "item_id")
    first = {r.item_id: r.split for r in split_items(df, validation_split=fraction).collect()}
    again = {r.item_id: r.split for r in split_items(df.repartition(13), validation_split=fraction).collect()}
    assert first == again and sum(v == "validation" for v in first.values()) == int(n * fraction)


def test_large_split_narrows_by_prefix(spark):
    df = spark.range(30_000_0).withColumnRenamed("id", "item_id")
    assert split_items(df, validation_split=0.3, seed=7).filter("split = 'validation'").count() == 90_000
