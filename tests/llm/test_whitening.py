import numpy as np
import pytest

from facetry.llm import whitening
from facetry.llm.eigen import Spectrum, rank_one, secular_roots


@pytest.mark.parametrize("seed", range(40))
def test_rank_one_equals_a_full_decomposition(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 40))
    d = np.sort(rng.choice([0.0, 1.0, 1.0 + 1e-15, 2.0, rng.random(), 1e-9, 1e6], k))
    v = np.linalg.qr(rng.normal(size=(k, k)))[0]
    x = rng.normal(size=k) * rng.choice([1.0, 1e-8, 1e4, 0.0], k)
    rho = float(rng.choice([0.0, 1e-9, 0.5, 1.0, 1e3]))
    values, vectors = rank_one(d, v, x, rho)
    full = (v * d) @ v.T + rho * np.outer(x, x)
    size = max(np.abs(full).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(full)).max() <= 1e-12 * size * k
    assert np.abs((vectors * values) @ vectors.T - full).max() <= 1e-12 * size * k
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert (np.diff(values) >= 0).all()


def test_roots_interlace():
    rng = np.random.default_rng(5)
    for k in (2, 3, 50):
        d = np.cumsum(10.0 ** rng.uniform(-9, 3, k))
        w = 10.0 ** rng.uniform(-12, 3, k)
        gap = secular_roots(d, w)
        assert (gap[np.arange(k), np.arange(k)] < 0).all() and (gap[np.arange(1, k), np.arange(k - 1)] > 0).all()
        assert (np.abs(1 + (w[:, None] / gap).sum(0)) <= 1e-11 * (1 + np.abs(w[:, None] / gap).sum(0))).all()


def test_spectra_of_parts_equal_that_of_the_whole():
    rng = np.random.default_rng(2)
    rows = rng.integers(-30, 30, (300, 12)) @ np.diag([1, 1, 1, 5, 0, 2, 1, 1, 1, 3, 1, 1])
    total = Spectrum.empty(12)
    for part in np.array_split(rows, 7):
        one = Spectrum.empty(12)
        one.add_rows(part)
        total.merge(one)
    centred = rows - rows.mean(0)
    assert total.n == 300 and total.sums.tolist() == rows.sum(0).tolist()
    assert np.allclose((total.vectors * total.values) @ total.vectors.T, centred.T @ centred, atol=1e-8)


def expected(rows, k):
    """Definitions, with exact integers and one decomposition."""
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in r] for r in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * v - s) ** 2 for v, s in zip(r, sums))) for r in x]
    away = np.array([[float(n * v - s) / n for v, s in zip(r, sums)] for r in x])
    cov = away.T @ away / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    with np.errstate(all="ignore"):
        return n, deviation, away @ v / np.sqrt(e), e / np.trace(cov)


def check(found, keys, rows, k):
    n, deviation, whitened, explained = expected(rows, k)
    got = {}
    for r in found.collect():
        assert r.n == n
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(keys)
    values = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in keys], float)
    signs = np.sign((values * whitened).sum(0))
    assert np.abs(values * signs - whitened).max() < 1e-6
    for i, d in zip(keys, deviation):
        assert {int(r.deviation) for r in got[i].values()} == {d}
        assert np.allclose([got[i][c].explained for c in range(1, k + 1)], explained, rtol=1e-9)
    errors = {r.identity_error for rows in got.values() for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    found = whitening.op11_whitening(spark, folder)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


SCHEMA = "vec_id long, embedding array<float>, component int, n string, whitened binary, _vector int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 1, "n", b"w", 3) for i, v in rows], SCHEMA).repartition(parts)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(50)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [1.0, float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf")] * 5), (105, [None])]
    for parts in (1, 7, 90):
        check(whitening.whiten(table(spark, good + bad, parts)), [i for i, _ in good], [v for _, v in good], 5)
    assert whitening.whiten(table(spark, bad)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0


def test_no_variance(spark):
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(1, None, 0.0, 0, None), (2, None, 0.0, 0, None)]
    # Repeated rows, a null key, one direction only.
    rows = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 6.0])])).collect()
    assert len(rows) == 6 and all((r.whitened is None) == (r.component == 2) for r in rows)
    assert all(r.identity_error < 1e-12 for r in rows)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(np.float32(v)), 1.0]) for i, v in enumerate((3e15, -7e15, 1.5e15))]
    _, deviation, _, _ = expected([v for _, v in rows], 2)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(table(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == deviation and deviation[0] > 1 << 63
    with pytest.raises(Exception, match="outside the range"):
        whitening.whiten(table(spark, [(1, [3e38, 1.0])])).collect()
    with pytest.raises(Exception, match="different widths"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()
