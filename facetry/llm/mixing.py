"""Mixing sources to target weights by Poisson replication.

A row of a source is repeated ``N`` times, ``N`` Poisson with the source's rate: its
share of the target over its share of the rows. ``N`` inverts the distribution at a
draw hashed from the seed and the row's key, so the copies of a row are the same on
every run, partitioning and retry. Rows without a key are told apart by a digest of all
their columns and a number among equal ones. The copies then go through one global shuffle: each
has a hashed order value, partition ``p`` of ``n`` takes the ``p``-th n-th part of its
range, and rows are sorted within partitions, so the whole output is in order of that
value. Nothing is keyed by source but one count per source, so a hot source does not
make a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import table, task_count
from facetry.operators.lookup import attach

#: Rates above this are drawn as a sum of that many Poisson draws of equal rates.
PART_RATE = 256.0
DIGITS = 12
ORDER_BITS = 4 * DIGITS
#: Equal rows without a key that one task numbers at a time.
CHUNK = 1000


def _hashed(*parts: Column | str | int) -> Column:
    """48 hashed bits as a bigint."""
    texts = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, DIGITS), 16, 10).cast("bigint")


def distribution(rate: Column) -> Column:
    """``P(N <= k)`` for k = 0, 1, .. as far as doubles tell it from 1; the rate is at most ``PART_RATE``."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, source_col: str = "source", alpha: float = 0.5, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: ``source, rate, parts, cdf``.

    Target weights are ``rows ** alpha`` or come from ``weights`` (source, weight); the
    target has as many rows as the input. A source without a positive weight has rate 0.
    A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        known = sizes.withColumn("weight", F.pow("n", F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("_of")).agg(F.sum("weight").alias("weight"))
        known = sizes.join(given, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    known = known.withColumn("weight", weight)
    total = known.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    rows, mass = float(total["n"] or 0), float(total["weight"] or 0)
    rate = F.col("weight") / F.lit(mass or 1.0) * F.lit(rows) / F.col("n")
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    found = known.withColumn("rate", rate).withColumn("parts", parts)
    return found.select("source", "rate", "parts", distribution(F.col("rate") / F.col("parts")).alias("cdf"))


def _told_apart(rows: DataFrame, n: int) -> DataFrame:
    """``_id`` added to (_row, _key): the key as text; where it is null, a digest of the row and its number among equal rows.

    Equal rows are interchangeable, so they are counted and numbered anew, in chunks dealt
    over all tasks: many equal rows make no hot task.
    """
    keyed = rows.filter("_key IS NOT NULL").withColumn("_id", F.col("_key").cast("string"))
    bare = rows.filter("_key IS NULL")
    if bare.isEmpty():
        return keyed
    counted = bare.groupBy(F.md5(F.to_json("_row")).alias("_digest")).agg(F.any_value("_row").alias("_row"), F.count("*").alias("_m"))
    chunks = counted.select("_row", "_digest", "_m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"), F.lit(CHUNK).cast("long"))).alias("_from"))
    last = F.least(F.col("_from") + CHUNK - 1, F.col("_m"))
    numbered = chunks.repartition(n, "_digest", "_from").select("_row", "_digest", F.explode(F.sequence("_from", last)).alias("_number"))
    told = F.concat_ws(":", F.lit("row"), "_digest", "_number")
    return keyed.unionByName(numbered.select("_row", F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"), told.alias("_id")))


def mix(
    docs: DataFrame, key: str = "doc_id", source_col: str = "source", alpha: float = 0.5,
    weights: DataFrame | None = None, seed: int = 0, partitions: int | None = None, names: tuple[str, str] = ("copy", "shuffle_key"),
) -> DataFrame:
    """The columns of ``docs``, the copy's number (1, 2, ..) and its order value under ``names``, in order of that value.

    Each row with a null key draws on its own, also among equal ones; rows that share a key
    draw alike and so are repeated alike; an empty table gives an empty result. Columns of
    ``docs`` under those names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    plan = rates(docs, source_col, alpha, weights).select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "parts", "cdf"
    )
    n = partitions or task_count(spark)
    rows = _told_apart(docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key")), n)
    source = F.col("_row").getField(source_col)
    rows = rows.select("_row", "_id", F.coalesce(source.cast("string"), F.lit("")).alias("_source"), source.isNull().alias("_none"))
    rows = attach(rows, plan, ["_source", "_none"], spread_by="_id")
    draw = lambda part: _hashed(seed, F.col("_id"), part) / float(2**ORDER_BITS)
    one = lambda part: F.size(F.filter("cdf", lambda c: c <= draw(part)))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), one), F.lit(0), lambda a, b: a + b)
    copies = rows.select("_row", "_id", count.alias("_n")).filter("_n > 0")
    copies = copies.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    copies = copies.withColumn("_order", _hashed(seed, "order", F.col("_id"), F.col("_copy")))
    place = F.floor(F.col("_order") / float(2**ORDER_BITS) * n).cast("int")
    shuffled = copies.repartitionById(n, place).sortWithinPartitions("_order", "_id", "_copy")
    return shuffled.select("_row.*", F.col("_copy").alias(names[0]), F.col("_order").alias(names[1]))


def op3_mix_sources(spark, folder):
    """Every document repeated towards square-root source weights, in a global random order."""
    return mix(table(spark, folder, "documents"))


SQL = {
    "op3_mix_sources": f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n)::DOUBLE AS n, sum(n ** 0.5) AS w FROM sizes),
rates AS (SELECT source, (sizes.n ** 0.5) / whole.w * whole.n / sizes.n AS rate FROM sizes, whole),
parted AS (SELECT source, greatest(ceil(rate / {PART_RATE}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART_RATE}), 1) AS r FROM rates),
steps AS (
  SELECT source, parts, r, 0 AS k, -r AS log_p, exp(-r) AS cdf FROM parted
  UNION ALL
  SELECT source, parts, r, k + 1, log_p + ln(r) - ln((k + 1)::DOUBLE), cdf + exp(log_p + ln(r) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(r + 12 * sqrt(r) + 30)),
tables AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source, parts),
drawn AS (
  SELECT d.*, list_sum([len([c FOR c IN t.cdf IF c <= ('0x' || md5('0:' || doc_id || ':' || p)[1:{DIGITS}])::BIGINT / {float(2**ORDER_BITS)}])
                        FOR p IN range(1, t.parts + 1)])::INT AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1))::INT AS copy FROM drawn)
SELECT *, ('0x' || md5('0:order:' || doc_id || ':' || copy)[1:{DIGITS}])::BIGINT AS shuffle_key FROM copies
""",
}
