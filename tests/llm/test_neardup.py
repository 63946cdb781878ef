import random
from collections import defaultdict

import pytest
from conftest_llm import odd_rows, sentence

from facetry.llm import components, neardup


def brute(rows, sketch):
    sets, group = {}, {}
    for key, text in rows:
        if key is None:
            continue
        words = (text or "").encode().lower().split()
        n = min(sketch.words, len(words))
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
        group[key] = key

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= sketch.percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def copies(n, edits, seed=0):
    rng = random.Random(seed)
    base = sentence("long", 150).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = sentence(rng.random(), 1)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("sketch", [neardup.Sketch(3, 85, 11, 6), neardup.Sketch()])
def test_against_brute_force(spark, odd, sketch):
    want = brute([(r[0], r[1]) for r in odd_rows()], sketch)
    got = neardup.near_duplicates(odd, sketch).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_large_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = copies(160, 9) + [(1000 + i, sentence(i, 30)) for i in range(40)]
    sketch = neardup.Sketch(3, 85, 11, 6)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketch).collect()
    want = brute(rows, sketch)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 190


def test_pigeonhole_guarantee():
    """Signatures that differ in at most 2 * chunks - 1 symbols share a key."""
    import numpy as np

    sketch, rng = neardup.Sketch(3, 85, 11, 6), np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, (500, 66)).astype(np.uint64)
    other = base.copy()
    for row in other:
        row[rng.choice(66, 21, replace=False)] ^= np.uint64(1)
    keys, others = neardup.chunk_keys(base, sketch), neardup.chunk_keys(other, sketch)
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(keys, others))
    assert not set(keys[0].tolist()) & set(keys[1].tolist())


def test_empty(spark, none):
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, None), (9, 9)]
    group = {i: {i} for i in range(500)}
    for a, b in edges:
        if b is not None and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[a]:
                group[x] = group[a]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = defaultdict(int, {i: min(g) for i, g in group.items() if len(g) > 1})
    assert got == dict(want)
