import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import odd_rows

from facetry.llm import language
from facetry.llm.common import is_held_out
from pyspark.sql import functions as F

ROWS = [(i, *(("the cat sat on the mat", "en") if i % 2 else ("die katze und der hund", "de"))) for i in range(80)]


def coder(texts, order):
    """Bits of a word straight from the definition: counts of every context in dictionaries."""
    trees = defaultdict(Counter)
    for text in texts:
        for word in text.lower().split():
            data = b" " + word.encode() + b" "
            for i in range(1, len(data)):
                for n in range(min(order, i) + 1):
                    trees[data[i - n : i]][data[i]] += 1

    def bits(word):
        data, total = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(data)):
            for n in range(min(order, i), -1, -1):
                after = trees.get(data[i - n : i])
                if after is None:
                    continue
                size = sum(after.values()) + len(after)
                if data[i] in after:
                    total -= math.log2(after[data[i]] / size)
                    break
                total -= math.log2(len(after) / size)
            else:
                total += 8
        return total

    return bits


def lengths(model, *texts):
    return language.Scorer(model).lengths(list(texts))


def test_code_lengths_by_hand(spark):
    model = language.fit(spark.createDataFrame([(1, "ab ab ac", "x")], "doc_id long, text string, lang string"), order=2)
    # " a" always: 3 of 4 with escape; "b" after " a": 2 of 5; " " after "ab": 2 of 3.
    assert abs(lengths(model, "ab")[0] - (-math.log2(3 / 4) - math.log2(2 / 5) - math.log2(2 / 3))) < 1e-5
    # "z" after " ": escapes from " " (1 of 4), from the empty context (4 of 13), then one of 256; the end in the empty context.
    empty = 9 + 4
    assert abs(lengths(model, "z")[0] - (-math.log2(1 / 4) - math.log2(4 / empty) + 8 - math.log2(3 / empty))) < 1e-5


@pytest.mark.parametrize("order", [0, 1, 4, 6])
def test_brute_force_coder(spark, order):
    rng = random.Random(order)

    def words(n, letters):
        return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]

    texts = {"a": [" ".join(words(50, "abcé日")) for _ in range(4)], "b": [" ".join(words(50, "abcxyz")) for _ in range(3)]}
    rows = [(1, t, lang) for lang, some in texts.items() for t in some]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), order=order)
    tests = words(40, "abcé日xyz\x00") + ["", "a", "日" * 30, "ab" * 40]
    found = lengths(model, *tests)
    for i, lang in enumerate(model.languages):
        bits = coder(texts[lang], order)
        assert np.allclose(found[:, i], [sum(map(bits, t.lower().split())) for t in tests], rtol=1e-5)


def test_predictions(spark, odd, none):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in ROWS)
    found = language.identify(odd, model).collect()
    assert len(found) == len(odd_rows())
    by_key = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert all(by_key[k] == ("und", 0.0) for k in (4, 5, 6, 8)) and by_key[7][0] in ("de", "en")
    assert language.identify(none, model).count() == 0
    empty = language.fit(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(is_held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert language.fit(other).languages == ["de", "en"]
    for a, b in zip(language.fit(other).bits, language.fit(docs).bits):
        assert a.tolist() == b.tolist()


def test_rows_without_an_id_teach_too(spark):
    """4,000 documents of a language, none with an id: about as many as asked for are learned."""
    rows = [(None, f"w{i} common", "en") for i in range(4000)] + [(i, "die katze", "de") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=5, per_language=1000)
    numbers = {w for w in (f"w{i}" for i in range(4000)) if lengths(model, w)[0, 1] < 14.5}
    assert 500 < len(numbers)


def test_memory_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = language.fit(docs)
    text = " ".join(f"word{i} the der" for i in range(300)) + " " + "long" * 100
    whole = lengths(model, text)
    monkeypatch.setattr(language, "CACHE", 300)
    small = language.Scorer(model)
    for _ in range(3):
        assert abs(small.lengths([text]) - whole).max() < 1e-2
        small.lengths([" ".join(f"other{i}" for i in range(1400))])
        assert small.table.size <= 1702
