import random

import numpy as np

from facetry.llm import toxicity
from facetry.llm.common import is_held_out


def test_interactions_are_learned():
    """Label 1 needs an insult and a group; either alone is fine, which additive weights can't tell."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        insult, group = (rng.random(2) < 0.4).tolist()
        words = [f"w{i}" for i in rng.integers(0, 50, 8)] + ["insult"] * insult + ["group"] * group
        rows.append(sorted({h for w in words for h in toxicity.terms_of(w)}))
        labels.append(float(insult and group))
    counted, seen = np.unique(np.concatenate(rows[:2500]), return_counts=True)
    hits = {t: 0 for t in counted.tolist()}
    for row, label in zip(rows[:2500], labels):
        for t in row:
            hits[t] += label
    terms = toxicity.informative(counted, seen, np.array(list(hits.values())), 2500, int(sum(labels[:2500])), 100)
    assert set(toxicity.terms_of("insult") + toxicity.terms_of("group")) <= set(terms.tolist()) and len(terms) < 20
    place = {int(t): i for i, t in enumerate(terms)}
    placed = [sorted(place[h] for h in r if h in place) for r in rows]
    model = toxicity.train(terms, 1, *lists(placed[:2500]), np.array(labels[:2500]), epochs=40)
    scores = model.score(*lists(placed[2500:]))
    assert ((scores > 0.5) == (np.array(labels[2500:]) > 0)).mean() > 0.98


def lists(rows):
    return np.array([i for r in rows for i in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    model = toxicity.FactorizationMachine(np.arange(3), 7, 0.3, rng.normal(size=10), rng.normal(size=(10, 4)), "x")
    rows = [[], [2], [0, 9], [1, 3, 4, 8], list(range(10))]
    for row, found in zip(rows, model.score(*lists(rows))):
        line = 0.3 + sum(model.weights[i] for i in row)
        line += sum(model.factors[i] @ model.factors[j] for i in row for j in row if i < j)
        assert abs(found - 1 / (1 + np.exp(-line))) < 1e-12


def test_gradient_step():
    """The first step of training goes along the gradient of the loss, as differences show it."""
    rows, labels = [[0, 1], [1, 2], [0, 2, 3], [3]], np.array([1.0, 0.0, 1.0, 0.0])
    none = np.zeros(0, np.int64)
    before = toxicity.train(none, 4, *lists(rows), labels, epochs=0)
    after = toxicity.train(none, 4, *lists(rows), labels, epochs=1, rate=0.1, decay=0.0)

    def loss(model):
        p = model.score(*lists(rows))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    base = loss(before)
    for name in ("weights", "factors"):
        values, moved = getattr(before, name), getattr(after, name)
        for at in np.ndindex(values.shape):
            old = values[at]
            values[at] = old + 1e-6
            slope = (loss(before) - base) / 1e-6
            values[at] = old
            assert abs(moved[at] - (old - 0.1 * slope / np.sqrt(1e-4 + slope**2))) < 1e-4


def test_words_without_a_meaning_of_their_own(spark):
    """Label 1 exactly if two words occur both or neither: no word tells anything by itself."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randint(0, 300)}" for _ in range(10)] + ["salt"] * one + ["pepper"] * two
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(one == two)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    found = toxicity.score(docs, model).filter(is_held_out("doc_id")).collect()
    right = [(r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in found]
    assert sum(right) / len(right) > 0.95


def test_positions():
    import zlib

    terms = toxicity.Terms(np.array(sorted(toxicity.terms_of("shouting")[2:3])), 50)
    flat, starts = terms.positions(["Shouts, shouting SHOUTING", "", "a_b é", "x" * 40])
    bucket = lambda w: 1 + zlib.crc32(w.encode()) % 50
    assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:])] == [
        sorted({0, bucket("shouts"), bucket("shouting")}), [], sorted({bucket("a_b"), bucket("é")}), [bucket("x" * 40)]]


def test_held_out_and_odd_rows(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "sea"]) for _ in range(9)) + (" nasty" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in got)
    found = toxicity.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(none, model).count() == 0
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("1 - toxic"))
    same = flipped.filter(is_held_out("doc_id")).union(labels.filter(~is_held_out("doc_id")))
    other = toxicity.score(docs, toxicity.fit(docs, same)).collect()
    assert {r.doc_id: r.score for r in other} == {r.doc_id: r.score for r in got}


def test_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()}) == 1
