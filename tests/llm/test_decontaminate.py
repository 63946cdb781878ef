import random

from facetry.llm import decontaminate as dc


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, n):
    letters = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(letters)), rng.random()
        if kind < 0.4:
            letters[at] = rng.choice("abcd")
        elif kind < 0.7 and len(letters) > 1:
            letters.pop(at)
        else:
            letters.insert(at, rng.choice("abcd"))
    return "".join(letters)


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        item = dc.plain("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 70))))
        text = dc.plain("".join(rng.choice("abcd") for _ in range(40)) + edited(rng, item or "a", rng.randint(0, 7)) + " tail")
        found = dc.Matcher([(5, item)], 0.08).find(text)
        best = distance(item, text) if item else 1
        assert bool(found) == (bool(item) and best <= dc.budget(len(item), 0.08))
        if found:
            assert found[0]["distance"] == best


def test_odd_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame(
        [(1, "some  TEXT with\nno id at all"), (2, None), (3, ""), (4, "nowhere to be found in it"), (None, "one"), (6, "Some text with no id at al")], "item_id long, text string")
    for block in (dc.BLOCK_CHARS, 10):  # all items at once, and one pass for each
        monkeypatch.setattr(dc, "BLOCK_CHARS", block)
        got = dc.find_items(odd, items)
        assert got.columns == [*odd.columns, "matches"] and got.count() == odd.count()
        found = {r.doc_id: [(m.item_id, m.distance) for m in r.matches] for r in got.collect() if r.matches}
        assert {k: [m for m in v if m[0] > 0] for k, v in found.items()} == {None: [(1, 0), (6, 0)], 10: [], 11: []}
        unnamed = {m for v in found.values() for m in v if m[0] < 0}  # the item without an id
        assert len(unnamed) == 1 and found[10] == found[11] == [*unnamed]
    assert dc.find_items(none, items).count() == 0
    assert dc.find_items(odd, items.filter("item_id = 2")).filter("size(matches) > 0").count() == 0
