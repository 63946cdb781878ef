import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from facetry.operators import negatives as neg


def items(spark, rows, attributes=("a", "b")):
    fields = ", ".join(f"{x} string" for x in attributes)
    return spark.createDataFrame([(i, *r, [1.0, 2.0]) for i, r in enumerate(rows)], f"item_id long, {fields}, embedding array<float>")


def check(df, found, attributes, k):
    """Exactly k slots per item, all allowed, distinct whenever the pool has k."""
    rows = {r.item_id: tuple(r[x] for x in attributes) for r in df.collect()}
    got = defaultdict(dict)
    for r in found.collect():
        assert r.pos not in got[r.item_id]
        got[r.item_id][r.pos] = r.neg_id
    assert set(got) == set(rows)
    for item, slots in got.items():
        pool = {i for i, key in rows.items() if all(x != y for x, y in zip(key, rows[item]))}
        assert sorted(slots) == list(range(k + 1)) and slots[0] == item
        drawn = [slots[p] for p in range(1, k + 1)]
        if not pool:
            assert drawn == [item] * k
        else:
            assert set(drawn) <= pool
            if len(pool) >= k:
                assert len(set(drawn)) == k
    return got


def mixed(n):
    return [(str(i * 7 % 5), str(i * 11 % 6)) for i in range(n)]


def test_pool_sizes_equal_brute_force(spark):
    df = items(spark, mixed(60))
    pools = {(r.a, r.b): r.pool for r in neg.pool_sizes(df, ["a", "b"]).collect()}
    for anchor in (0, 17, 59):
        row = df.filter(F.col("item_id") == anchor).first()
        assert neg.brute_force_pool(df, "item_id", anchor, ["a", "b"]).count() == pools[row.a, row.b]


@pytest.mark.parametrize("attributes", [("a",), ("a", "b"), ("a", "b", "c")])
def test_draws_for_one_to_three_attributes(spark, attributes):
    rows = [tuple(str((i * p) % m) for p, m in zip((7, 11, 13), (4, 5, 6)))[: len(attributes)] for i in range(120)]
    df = items(spark, rows, attributes)
    check(df, neg.sample_negatives(df, list(attributes), mini_batch_size=6), attributes, 5)


def test_empty_small_and_large_pools(spark):
    # "all" keys cover everything (pool 0), rare keys leave pools below and just above k.
    rows = [("x", "y")] * 40 + [("x", "z")] * 5 + [("w", "y")] * 4 + [("v", "u")] * 3
    df = items(spark, rows)
    got = check(df, neg.sample_negatives(df, ["a", "b"], mini_batch_size=10), ("a", "b"), 9)
    assert all(n in (49, 50, 51) for p, n in got[0].items() if p)
    # The pool of ("x", "y") is empty although neither value covers all rows.
    crossed = items(spark, [("x", "y")] * 3 + [("x", "z")] * 2 + [("w", "y")] * 2)
    check(crossed, neg.sample_negatives(crossed, ["a", "b"], mini_batch_size=3), ("a", "b"), 2)
    alone = items(spark, [("x", "y")] * 6)
    check(alone, neg.sample_negatives(alone, ["a", "b"]), ("a", "b"), 9)


def test_dominant_value_and_hidden_pool(spark):
    # 97 % share one value; of the rest nearly all share the other attribute's value.
    rows = [("hot", "p")] * 970 + [("cold", "p")] * 28 + [("cold", "q")] * 2 + [("hot", "q")] * 300
    df = items(spark, rows)
    check(df, neg.sample_negatives(df, ["a", "b"], mini_batch_size=4), ("a", "b"), 3)


def test_more_levels_give_the_same_table(spark, monkeypatch):
    df = items(spark, mixed(200))
    plain = sorted(neg.sample_negatives(df, ["a", "b"]).collect())
    monkeypatch.setattr(neg, "FAN_OUT", 2)
    assert sorted(neg.sample_negatives(df.repartition(7), ["a", "b"]).collect()) == plain
    monkeypatch.setattr(neg, "HOT_KEY_ROWS", 0)
    assert sorted(neg.sample_negatives(df, ["a", "b"]).collect()) == plain


def test_a_whole_pool_is_drawn(spark):
    """With as many slots as each pool has rows, every row of it is drawn once."""
    rows = [(str(i % 3), str(i // 3 % 4), str(i // 12)) for i in range(60)]
    df = items(spark, rows, ("a", "b", "c"))
    got = check(df, neg.sample_negatives(df, ["a", "b", "c"], mini_batch_size=25), ("a", "b", "c"), 24)
    assert all(len({n for p, n in slots.items() if p}) == 24 for slots in got.values())


def test_two_common_values_and_many_others(spark):
    """Two attributes are nearly always the same, the third has very many values."""
    n = 20_000
    rows = [("x" if i % 100 else f"x{i % 7}", "y" if i % 101 else f"y{i % 5}", str(i // 2)) for i in range(n)]
    df = items(spark, rows, ("a", "b", "c")).drop("embedding")
    found = neg.sample_negatives(df, ["a", "b", "c"], vector=None, mini_batch_size=4).persist()
    own = df.select("item_id", "a", "b", "c")
    other = df.select(F.col("item_id").alias("neg_id"), *[F.col(x).alias(f"_{x}") for x in "abc"])
    pairs = found.filter("pos > 0").join(own, "item_id").join(other, "neg_id")
    assert found.count() == 4 * n
    empty = found.filter("pos > 0 AND neg_id = item_id").select("item_id").distinct()
    pools = neg.pool_sizes(df, ["a", "b", "c"]).join(own, ["a", "b", "c"])
    assert empty.count() == pools.filter("pool = 0").count()
    assert pairs.filter("neg_id <> item_id AND (a = _a OR b = _b OR c = _c)").count() == 0
    enough = pools.filter("pool >= 3").select("item_id")
    assert found.filter("pos > 0").join(enough, "item_id").groupBy("item_id").agg(F.countDistinct("neg_id").alias("d")).filter("d < 3").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 2**40 + 12345])
def test_permutation(size):
    import numpy as np

    n = min(size, 1000)
    x = np.arange(n)
    keys = np.random.default_rng(size).integers(0, 2**32, 4)
    out = neg.permuted(x, np.full(n, size), np.tile(keys, (n, 1)))
    assert len(set(out.tolist())) == n and 0 <= out.min() and out.max() < size
    assert size > 1000 or sorted(out.tolist()) == list(range(n))


def test_first_two_ranks_are_even_over_all_pairs():
    import numpy as np

    for size in (5, 9, 23):
        keys = np.random.default_rng(size).integers(0, 2**32, (60_000, 4))
        both = [neg.permuted(np.full(len(keys), j), np.full(len(keys), size), keys) for j in (0, 1)]
        counts = np.bincount(both[0] * size + both[1], minlength=size * size).reshape(size, size)
        assert (np.diag(counts) == 0).all()
        off = counts[~np.eye(size, dtype=bool)]
        expected = len(keys) / len(off)
        chi = ((off - expected) ** 2 / expected).sum()
        assert abs(chi - len(off)) < 6 * (2 * len(off)) ** 0.5


def test_null_attributes_are_values_of_their_own(spark):
    from datetime import date, datetime

    day = [None, date(1970, 1, 1), date(2000, 1, 1)]
    time = [None, datetime(2000, 1, 1, 0, 0, 0, 1), datetime(2000, 1, 1, 0, 0, 0, 2)]
    for kind, values in [("int", [None, -1, 2]), ("boolean", [None, True, False]), ("date", day), ("timestamp", time), ("string", [None, "", "null"]), ("double", [None, -1.0, 0.5])]:
        df = spark.createDataFrame([(i, values[i % 3], "b" if i % 2 else None) for i in range(60)], f"item_id long, a {kind}, b string")
        assert {(r.n, r.pool) for r in neg.pool_sizes(df, ["a"]).collect()} == {(20, 40)}
        assert {(r.n, r.pool) for r in neg.pool_sizes(df, ["a", "b"]).collect()} == {(10, 20)}
        check(df, neg.sample_negatives(df, ["a", "b"], vector=None, mini_batch_size=6), ("a", "b"), 5)
        assert neg.brute_force_pool(df, "item_id", 0, ["a", "b"]).count() == 20


def test_invalid_anchors(spark):
    df = items(spark, mixed(30)).withColumn(
        "embedding", F.when(F.col("item_id") == 3, None).when(F.col("item_id") == 4, F.array(F.lit(float("nan")))).otherwise(F.col("embedding")))
    found = neg.sample_negatives(df, ["a", "b"], mini_batch_size=4)
    bad = found.filter("item_id IN (3, 4)")
    assert bad.count() == 8 and bad.filter("neg_id IS NULL").count() == 8
    assert found.filter("neg_id IN (3, 4)").count() == 0
    stats = neg.check_negatives(found, 2).first()
    assert (stats.n_items, stats.slots, stats.valid_anchors, stats.zero_anchors) == (30, 4, 28, 2)
    assert math.isclose(stats.memory_mb, 30 * 4 * 2 * 4 / 2**20)


def test_draws_are_uniform(spark):
    df = items(spark, mixed(300))
    counts = defaultdict(int)
    expected = defaultdict(float)
    rows = {r.item_id: (r.a, r.b) for r in df.collect()}
    for seed in range(2):
        for r in neg.sample_negatives(df, ["a", "b"], seed=seed).filter("pos > 0").collect():
            counts[r.neg_id] += 1
    for own in rows.values():
        pool = [i for i, key in rows.items() if key[0] != own[0] and key[1] != own[1]]
        for i in pool:
            expected[i] += 18 / len(pool)
    chi = sum((counts[i] - e) ** 2 / e for i, e in expected.items()) / len(expected)
    assert 0.7 < chi < 1.3


def test_empty_table(spark):
    df = items(spark, mixed(5)).filter("false")
    assert neg.sample_negatives(df, ["a", "b"]).count() == 0
