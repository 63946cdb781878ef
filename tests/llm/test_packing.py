import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from facetry.llm import packing
from facetry.llm.tokenids import default_tokenizer


def placed(counts, capacity):
    """Lengths of each sequence by offset, as a plan lays all pieces."""
    found = packing.plan(counts, capacity)
    bins = {}
    for length, n in counts.items():
        sequence, offset = found.places(np.full(n, length, np.int64), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            bins.setdefault(s, []).append((o, length))
    assert sorted(bins) == list(range(found.sequences))
    for items in bins.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= capacity
    return bins


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    best = [len(lengths)]

    def go(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(gaps)
            return
        for g in {g for g in gaps if g >= lengths[i]}:
            rest = list(gaps)
            rest[rest.index(g)] -= lengths[i]
            go(i + 1, rest)
        go(i + 1, [*gaps, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_small_cases_are_near_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = [rng.randint(1, capacity) for _ in range(9)]
    counts = {n: lengths.count(n) for n in lengths}
    least = fewest(lengths, capacity)
    assert least <= len(placed(counts, capacity)) <= -(-11 * least // 9) + 1


@pytest.mark.parametrize("seed", range(10))
def test_large_pieces_alone_are_packed_as_few_as_can_be(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(11, 30) for _ in range(10)]
    assert len(placed({n: lengths.count(n) for n in lengths}, 30)) == fewest(lengths, 30)


def test_many_pieces():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 500) for n in rng.sample(range(1, 4097), 3000)}
    bins = placed(counts, 4096)
    assert max(sum(3 * n > 4096 for _, n in b) for b in bins.values()) <= 2
    large = placed({n: c for n, c in counts.items() if 3 * n > 4096}, 4096)
    assert len(bins) <= 1.01 * max(sum(n * c for n, c in counts.items()) / 4096, len(large))
    assert packing.plan({}, 5).sequences == 0
    with pytest.raises(ValueError):
        packing.plan({6: 1}, 5)


def check(df, found, end=1, capacity=4096):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    expected = {}
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, end]
        for i in range(0, len(ids), capacity):
            some = ids[i : i + capacity]
            row = (r.doc_id, i // capacity, i, len(some), zlib.crc32(np.array(some, "<u4").tobytes()))
            expected[row] = expected.get(row, 0) + 1
    rows = found.collect()
    got = {}
    for r in rows:
        row = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[row] = got.get(row, 0) + 1
    assert got == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    return ends


def test_odd_rows(spark, odd, none):
    found = packing.pack(odd, default_tokenizer(), capacity=64)
    check(odd, found, capacity=64)
    assert check(none, packing.pack(none, default_tokenizer())) == {}
    # Without an end id, empty texts make no piece.
    bare = packing.pack(odd, default_tokenizer(), end_id=None)
    assert {r.doc_id for r in bare.collect()} == {r.doc_id for r in odd.collect() if r.text and r.text.strip()}


def test_sequences_hold_the_ids(spark, odd):
    found = packing.pack(odd.repartition(3), default_tokenizer(), capacity=64).persist()
    pieces = {(r.sequence_id, r.offset): bytes(r.ids) for r in found.collect()}
    for r in packing.sequences(found).collect():
        assert bytes(r.ids) == b"".join(pieces[r.sequence_id, p.offset] for p in r.parts)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = packing.op12_packing(spark, folder)
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    ends = check(spark.read.parquet(f"{folder}/documents.parquet"), found)
    assert len(ends) <= sum(ends.values()) / 4096 * 1.02 + 1
