"""The pipeline against brute-force versions of its stages."""

import zlib

import corpus_pipeline as cp
import numpy as np
from conftest_llm import COLUMNS
from pyspark.sql import functions as F
from test_neardup import brute
from tokenizers import Tokenizer

from facetry.llm import decontaminate, mixing, neardup, tokenids

FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    groups = brute(list(rows.items()), neardup.Sketch())
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {k for k, (_, c) in groups.items() if k == c}
    clean = {k for k in kept if not any(i in decontaminate.plain(rows[k]) for i in items)}
    mixed = mixing.mix(docs.filter(F.col("doc_id").isin(sorted(clean)))).select("doc_id").collect()
    tokenizer, want, n = Tokenizer.from_file(tokenids.default_tokenizer()), [], 0
    for key in sorted(r.doc_id for r in mixed):
        ids = np.array([*tokenizer.encode(rows[key], add_special_tokens=False).ids, 2], "<u4")
        want.append((key, n, len(ids), zlib.crc32(ids.tobytes())))
        n += len(ids)
    assert sorted(map(tuple, cp.run(spark, FOLDER).collect()), key=lambda r: r[1]) == want
    assert 0 < len(clean) < len(kept) < len(rows)


def test_stages_on_odd_rows(spark, odd, none):
    assert [name for name, _ in cp.STAGES] == ["language", "near-duplicates", "decontamination", "mixing", "token-files"]
    for docs in (odd, none):
        for _, step in cp.STAGES[:-1]:
            out = step(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert cp.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
    stay = cp.one_of_each_group(spark, odd, FOLDER)
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 9, 10, 12]
    assert stay.filter("doc_id IS NULL").count() == 1
    assert COLUMNS.split()[0] == stay.columns[0]


def test_rows_that_share_an_id_or_have_none(spark):
    """Two texts under one id both stay, their copies go; copies without an id are copies all the same."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (1, one), (7, two), (8, one + " end"), (None, two), (None, "alone"), (None, "alone"), (9, "alone too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = sorted((r.doc_id or 0, r.text) for r in cp.one_of_each_group(spark, docs, FOLDER).collect())
    # The first text of id 1 has its name; the other text's group is named by its smallest name, that of document 7.
    assert sum(t == one for _, t in stay) + sum(t == one + " end" for _, t in stay) == 1
    assert sum(t == two for _, t in stay) == 1
    assert sum(t == "alone" for _, t in stay) == 1 and (9, "alone too") in stay and len(stay) == 4
