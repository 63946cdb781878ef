import random
import re
from collections import Counter

import pytest

from facetry.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, longest=3, least=10, inside=50, top=2000):
    """The definition, with every phrase in a dictionary."""
    counts, words = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            longer = [b for q, b in chosen.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Aa", "b", "cé", "d", "É", "f", "g", "x\x00y", "日本"]
    fixed = ["new york city hall", "in spite of", "q w e r"]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        yield "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ","]) for p in parts), rng.choice(["en", "en", "en", "de", None, ""])


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("longest, top", [(3, 2000), (2, 3), (4, 50)])
def test_brute_force(spark, longest, top):
    rows = list(texts(longest, 300))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = rows_of(collocations.collocations(df, longest=longest, least=4, top=top))
    assert found == expected(rows, longest, 4, top=top) and found


def test_flushes_and_ranges(spark, monkeypatch):
    """Counts handed on often, a stream dealt over many tasks."""
    rows = list(texts("parts", 200))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(collocations.collocations(df, longest=4, least=3)) == expected(rows, 4, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_of_a_text_keep_its_words_together(monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_CHARS", 7)
    data = b"some words, and  a very_long_word_without_a_break\tend."
    assert b"".join(collocations._cuts(data)) == data
    words = collocations.Words()
    words.add("en", [data])
    assert len(words.numbers) == 7


def test_a_full_bitmap_changes_nothing(spark):
    rows = list(texts("map", 200))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(collocations.collocations(df, least=5, map_bits=64)) == expected(rows, 3, 5)


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert rows_of(collocations.collocations(odd, least=2)) == expected(rows, 3, 2)
    assert rows_of(collocations.collocations(none)) == []


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**12 + 7, 10**12 + 9, 10**13 + 1)], "a long, l long, r long")
    found = df.select(collocations._score(df.a, df.l, df.r)).first()[0]
    assert found == 10**6 * (10**12 + 7) ** 2 // ((10**12 + 9) * (10**13 + 1))
