import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import augment as aug
from facetry.operators import encode
from facetry.operators.labelvectors import label_vectors, zero_counts


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "item_id long, text string").repartition(3)


def test_encodes_distinct_texts_once_and_joins_back(spark):
    df = texts(spark, ["a b", "a b", " a b\n", None, "c"])
    rows = {r.item_id: r for r in encode.encode_texts(df, "item_id", "text", encode.HashingEncoder).collect()}
    assert len(rows) == 5 and rows[0].embedding == rows[1].embedding == rows[2].embedding
    assert all(r.status == "ok" and len(r.embedding) == 64 for r in rows.values())
    want = encode.HashingEncoder()(["a b"])[0]
    assert np.allclose(rows[0].embedding, want)


def test_retries_then_succeeds_or_gives_up():
    calls = []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise TimeoutError
        return np.ones((len(batch), 2))

    assert encode.encode_batch(flaky, ["x"], delay=0)[1] == "ok" and len(calls) == 3

    def never(batch):
        calls.append(0)
        raise ConnectionError

    calls.clear()
    assert encode.encode_batch(never, ["x"], delay=0) == (None, "retries_exhausted") and len(calls) == 4
    assert encode.encode_batch(lambda b: np.ones((3, 2)), ["x"])[1] == "count_mismatch"
    assert encode.encode_batch(lambda b: 1 / 0, ["x"])[1] == "failed"


def test_encoder_remembers_a_bounded_number_of_tokens():
    encoder, many = encode.HashingEncoder(8), [f"word{i} word{i + 1} same" for i in range(2**16 + 5000)]
    found = np.vstack([encoder(many[at : at + 10_000]) for at in range(0, len(many), 10_000)])
    assert len(encoder.seen) <= 2**16
    assert np.array_equal(found[-100:], encode.HashingEncoder(8)(many[-100:])) and np.array_equal(found[:100], encoder(many[:100]))


# Lambdas travel to the workers by value, this module does not.
uneven = lambda: lambda batch: [[1.0] * (3 if t == "odd" else 2) if t != "none" else [] for t in batch]
broken = lambda: lambda batch: {}["missing"]
hashing = lambda: encode.HashingEncoder(8)


def test_wrong_length_and_empty_vectors(spark):
    df = texts(spark, ["p", "q", "r", "odd", "none"])
    rows = {r.item_id: (r.status, r.embedding is None) for r in encode.encode_texts(df, "item_id", "text", uneven).collect()}
    assert rows == {0: ("ok", False), 1: ("ok", False), 2: ("ok", False), 3: ("wrong_length", True), 4: ("empty", True)}
    with pytest.raises(ValueError, match="no text"):
        encode.encode_texts(df, "item_id", "text", broken)
    with pytest.raises(ValueError, match="mode"):
        encode.encode_texts(df, "item_id", "text", uneven, mode="cloud")


def test_label_vectors(spark):
    df = spark.createDataFrame([(0, "France#####Bordeaux", "Merlot"), (1, "#####", " "), (2, None, "Merlot")], "item_id long, r string, v string")
    rows = {r.item_id: r for r in label_vectors(df, "r", "v", hashing, 8).collect()}
    assert len(rows[0].combined) == 16 and rows[0].varietal == rows[2].varietal
    assert rows[1].combined == [0.0] * 16 and rows[2].region == [0.0] * 8
    assert np.allclose(rows[0].region, hashing()(["France Bordeaux"])[0])
    counts = {r.kind: r.n_zero for r in zero_counts(label_vectors(df, "r", "v", hashing, 8)).collect()}
    assert counts == {"region": 2, "varietal": 1}


def test_attempts():
    answers = iter(["", "I'm sorry, I will not", "A fine red wine"])
    assert aug.generate_one(lambda: next(answers), (), (TimeoutError,), 5, 0) == ("A fine red wine", "ok", 3)
    assert aug.generate_one(lambda: "no", (), (TimeoutError,), 2, 0) == (None, "unusable", 2)
    assert aug.generate_one(lambda: 1 / 0, (), (TimeoutError,), 5, 0) == (None, "failed", 1)

    def late():
        raise TimeoutError

    assert aug.generate_one(late, (), (TimeoutError,), 3, 0) == (None, "retries_exhausted", 3)


def test_augment_counts_and_cache(spark, tmp_path):
    df = texts(spark, ["first base text", "I apologize for this", "third base text"])
    path = str(tmp_path / "cache")
    out = aug.augment(df, "item_id", "text", aug.TemplateGenerator, num_variations=3, cache_path=path, retry_delay=0)
    assert out.count() == 2 * 2 * 3 and {r.base_id for r in out.collect()} == {0, 2}
    again = aug.augment(df, "item_id", "text", broken, num_variations=9, cache_path=path)
    assert sorted(again.collect()) == sorted(out.collect())


def test_waves_and_outcomes(spark, monkeypatch):
    """More waves give the same answers, failures among them; a cache is for the items it was made for."""
    df = texts(spark, [f"base text number {i}" for i in range(40)])
    one = aug.answers(df, "item_id", "text", aug.MoodyGenerator, num_variations=2, retry_delay=0)
    assert one.count() == 40 * 2 * 2
    counts = {r.status: (r.texts, r.attempts) for r in aug.outcome(one).collect()}
    assert set(counts) == {"ok", "failed", "retries_exhausted", "unusable"} and sum(n for n, _ in counts.values()) == 160
    assert counts["failed"][0] == counts["failed"][1] and counts["unusable"][1] == 5 * counts["unusable"][0]
    monkeypatch.setattr(aug, "PROMPTS_PER_TASK", 20)
    many = aug.answers(df, "item_id", "text", aug.MoodyGenerator, num_variations=2, concurrent_limit=2, retry_delay=0)
    assert len(many.inputFiles()) > len(one.inputFiles()) / 8 and sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_waves_make_one_table(spark, monkeypatch):
    """All waves are read as one table, and items that share an id, or have none, are dealt to all waves."""
    monkeypatch.setattr(aug, "PROMPTS_PER_TASK", 20)
    for same in (7, None):
        df = spark.createDataFrame([(same, f"base text number {i}") for i in range(80)], "item_id long, text string").repartition(3)
        found = aug.answers(df, "item_id", "text", aug.TemplateGenerator, num_variations=2, concurrent_limit=2)
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        assert found.count() == 80 * 2 * 2 and found.select("text").distinct().count() == 80 * 2
        shares = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
        assert max(shares) <= 2 * 20


def test_answers_of_no_items(spark):
    df = spark.createDataFrame([], "item_id long, text string")
    found = aug.answers(df, "item_id", "text", aug.TemplateGenerator)
    assert found.count() == 0 and found.columns == ["base_id", "strategy", "variation", "text", "status", "attempts"]


def test_cache_is_for_its_items(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = texts(spark, ["first base text", "second base text"])
    aug.augment(df, "item_id", "text", aug.TemplateGenerator, num_variations=1, cache_path=path)
    more = texts(spark, ["first base text", "second base text", "third base text"])
    with pytest.warns(UserWarning, match="other items"):
        out = aug.augment(more, "item_id", "text", aug.TemplateGenerator, num_variations=1, cache_path=path)
    assert {r.base_id for r in out.collect()} == {0, 1, 2}
    again = aug.augment(more, "item_id", "text", broken, num_variations=1, cache_path=path)
    assert sorted(again.collect()) == sorted(out.collect())


def test_strategy_limits(spark):
    with pytest.raises(ValueError):
        aug.Strategy("x", "y", temperature=2.1)
    with pytest.raises(ValueError):
        aug.Strategy("x", "y", max_tokens=0)
    assert aug.strategies_frame(spark, aug.DEFAULT_STRATEGIES).count() == 2
