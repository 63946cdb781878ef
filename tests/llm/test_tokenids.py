import zlib

import numpy as np
import pytest
from conftest_llm import odd_rows
from tokenizers import Tokenizer

from facetry.llm import tokenids
from facetry.llm.huffman import BLOCK, Code, code_lengths, limit_for
from facetry.session import scratch_path


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    counts = np.maximum((1e6 / np.arange(1, n + 1) ** 1.5).astype(int), 1)
    lengths = code_lengths(counts, limit_for(n))
    assert lengths.max() <= limit_for(n) and (n == 1 or (2.0**-lengths).sum() == 1)
    code = Code(lengths)
    runs = [rng.integers(0, n, size) for size in (0, 1, BLOCK, BLOCK + 1, 3 * BLOCK - 1, 5000)]
    coded = [code.encode(r) for r in runs]
    assert np.array_equal(code.decode([c[0] for c in coded], [c[1] for c in coded], [len(r) for r in runs]), np.concatenate(runs))
    data, marks = coded[-1]
    bits = np.unpackbits(np.frombuffer(data, np.uint8))  # a block decodes from its checkpoint alone
    at, block = int(marks[3]), runs[-1][3 * BLOCK : 3 * BLOCK + 5]
    for i in block:
        size = int(lengths[i])
        assert int("".join(map(str, bits[at : at + size])), 2) == int(code.codes[i])
        at += size


def test_lengths_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    import heapq

    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    assert (code_lengths(counts, 12) * counts).sum() == total
    assert code_lengths(counts, 4).max() == 4


def test_files(spark, odd, none):
    tokenizer = Tokenizer.from_file(tokenids.default_tokenizer())
    want, n = [], 0
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((key, n, len(ids), zlib.crc32(ids.tobytes())))
        n += len(ids)
    got = tokenids.token_table(odd.repartition(4), tokenids.default_tokenizer()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenids.token_table(none, tokenids.default_tokenizer()).count() == 0


def test_pages_decode_alone(spark, odd):
    path = scratch_path(spark, "tokens")
    tokenids.store(odd, path, tokenids.default_tokenizer())
    assert spark.read.parquet(f"{path}/pages").columns == ["part", "page", "before", "keys", "sizes", "data", "offsets"]
    one = tokenids.read_ids(spark, path).filter("doc_id = 10").first()
    assert np.frombuffer(one.ids, "<u4").tolist() == [*Tokenizer.from_file(tokenids.default_tokenizer()).encode("one").ids, 2]


def test_piece_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE", 50)
    encoder = tokenids.PieceEncoder(tokenids.default_tokenizer(), "<u2")
    tokenizer = Tokenizer.from_file(tokenids.default_tokenizer())
    for start in range(0, 400, 40):
        text = " ".join(f"word{chr(97 + i % 26)}x{'yz' * (i % 7)}." for i in range(start, start + 40))
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
