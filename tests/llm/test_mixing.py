import math

from facetry.llm import mixing
from pyspark.sql import functions as F


def test_distribution(spark):
    for rate in (0.0001, 0.7, 30.0, 256.0):
        cdf = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("c")).first().c
        total = 0.0
        for k, c in enumerate(cdf):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert abs(c - total) < 1e-9
        assert abs(cdf[-1] - 1) < 1e-12


def test_means(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    wanted = spark.createDataFrame([("small", 1.0), ("large", 1.0)], "source string, weight double")
    got = {r.source: r.n for r in mixing.mix(df, weights=wanted).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for n in got.values():
        assert abs(n - 20_000) < 5 * 20_000**0.5
    wide = spark.createDataFrame([("small", 999.0), ("large", 1.0)], "source string, weight double")
    few = df.filter("doc_id < 2000")  # a rate of 10 * 0.999 and one of 1 / 900
    counts = mixing.mix(few, weights=wide).filter("source = 'small'").groupBy("doc_id").count()
    mean = counts.agg(F.sum("count")).first()[0] / 200
    assert abs(mean - 9.99) < 1


def test_large_rates_are_split(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(2000)], "doc_id long, source string")
    wanted = spark.createDataFrame([("b", 1.0)], "source string, weight double")
    got = mixing.mix(df, weights=wanted)
    assert abs(got.count() - 2000) < 5 * 2000**0.5 and got.select("source").distinct().count() == 1


def test_order_and_odd_rows(spark, odd, none):
    got = mixing.mix(odd, partitions=5)
    assert [c for c in odd.columns if c != "copy"] + ["copy", "shuffle_key"] == got.columns
    rows = got.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    again = mixing.mix(odd.repartition(3), partitions=2).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix(none).count() == 0


def test_rows_without_a_key_draw_on_their_own(spark):
    """1,999 different rows and 2,001 equal ones, none with a key, and 4,000 rows with one."""
    bare = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.least("id", F.lit(1999)).cast("string").alias("text"), F.lit("a").alias("source"))
    keyed = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("b").alias("source"))
    df = bare.union(keyed)
    got = mixing.mix(df, partitions=4).collect()
    equal = [r for r in got if r.doc_id is None and r.text == "1999"]
    other = [r for r in got if r.doc_id is None and r.text != "1999"]
    assert abs(len(equal) - 2001) < 5 * 2001**0.5 and abs(len(other) - 1999) < 5 * 1999**0.5
    assert abs(len({r.text for r in other}) - 1999 * (1 - math.exp(-1))) < 100
    assert len({r.shuffle_key for r in equal + other}) == len(equal) + len(other)
    assert sum(r.copy == 1 for r in equal) < 1500 and max(r.copy for r in equal) > 2
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7), partitions=3).collect()))
    assert {repr(r) for r in mixing.mix(keyed).collect()} == {repr(r) for r in got if r.doc_id is not None}
