import hashlib

from conftest_llm import odd_rows

from facetry.llm import fingerprints as fp
from pyspark.sql import functions as F


def paragraphs(text):
    return {p for p in (text or "").split("\n") if p.strip(" ")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_sets(spark, odd):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fp.compare_with_edited(odd).collect()
    assert len(got) == len(rows)
    want = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(paragraphs(text), paragraphs(edited)), jaccard(paragraphs(text), paragraphs(after))))
    order = lambda r: (str(r[0]), r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=order) == sorted(want, key=order)
    by_key = {r.doc_id: r.fingerprint for r in got}
    assert by_key[1] == by_key[2] != by_key[3]


def test_peeling_recovers_the_digests(spark):
    left, right = list(range(1, 400)), list(range(300, 900))
    df = spark.createDataFrame([(left, right), ([], right[:3]), (left, left), ([], [])], "a array<long>, b array<long>")
    for row in df.select("a", "b", fp.difference(F.col("a"), F.col("b")).alias("d")).collect():
        assert {(d.key, d.sign) for d in row.d} == {(k, 1) for k in set(row.a) - set(row.b)} | {(k, -1) for k in set(row.b) - set(row.a)}


def test_narrow_tables_get_stuck(spark):
    df = spark.createDataFrame([(list(range(40)), [])], "a array<long>, b array<long>")
    tight = fp.peel(fp.subtract(fp.cells(F.col("a"), 3), fp.cells(F.col("b"), 3)), 3)
    assert df.select(tight.alias("d")).first().d is None
    assert len(df.select(fp.lane_difference(F.col("a"), F.col("b")).alias("d")).first().d) == 40


def test_one_row_and_no_row(spark, odd, none):
    one = fp.compare_with_edited(odd.filter("doc_id = 7")).first()
    assert one.near_next == 1.0
    assert fp.compare_with_edited(none).count() == 0


def test_next_row_over_many_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    got = fp.with_next(df.withColumn("v", F.col("k") * 2), "k", ["v"], buckets=23).collect()
    assert {r.k: r.next.v for r in got} == {k: (k + 1) % 500 * 2 for k in range(500)}
