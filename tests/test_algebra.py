import numpy as np
import pyarrow as pa
import pytest

from facetry.operators import lexicon, projection, ridge


def table(spark, x, y, partitions=5):
    rows = [(i, None if a is None else a.tolist(), None if b is None else b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "item_id long, x array<double>, y array<double>").repartition(partitions)


def vectors_of(df, column, n, width):
    out = np.full((n, width), np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r.item_id] = r[column]
    return out


@pytest.mark.parametrize("deficient", [False, True])
@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_residuals_and_nuisance_against_numpy(spark, deficient, partitions):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 4)), rng.normal(size=(80, 12))
    if deficient:
        x[:, 3] = x[:, 0] + x[:, 1]
    xs, ys = list(x), list(y)
    xs[5], ys[7] = None, None
    ys[9] = np.where(np.arange(12) == 3, np.nan, y[9])
    ys[11] = y[11][:5]
    df = table(spark, xs, ys, partitions)
    ok = np.ones(80, bool)
    ok[[5, 7, 9, 11]] = False
    want = y[ok] - x[ok] @ np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
    got = vectors_of(projection.projection_residuals(df, "x", "y", 4, 12), "residual", 80, 12)
    assert np.allclose(got[ok], want, atol=1e-9) and np.isnan(got[~ok]).all()
    assert np.allclose(x[ok].T @ got[ok], 0, atol=1e-8)

    fit = projection.fit_nuisance(df, "x", "y", 4, 12, num_nuisance_dims=3)
    s = np.linalg.svd(want, compute_uv=False)
    assert np.allclose(fit.spectrum.values, s[:11], atol=1e-6)
    scores = vectors_of(fit.score(df, "x", "y"), "nuisance", 80, 3)[ok]
    assert np.allclose(scores.T @ scores, np.diag(s[:3] ** 2), atol=1e-6)
    assert fit.diagnostics["num_dims"] == 3 and not fit.diagnostics["using_default"]


@pytest.mark.parametrize("parts", [1, 40])
def test_condition_is_not_squared(spark, parts):
    """Columns of condition 1e9: as exact as least squares and the SVD on the rows."""
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.normal(size=(200, 6)))[0]
    x = turn @ np.diag(10.0 ** -np.arange(0, 10.8, 1.8)) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    y = x @ rng.normal(size=(6, 9)) * 1e3 + rng.normal(size=(200, 9)) @ np.diag(10.0 ** -np.arange(9.0))
    df = table(spark, list(x), list(y), parts)
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    fit = projection.fit_nuisance(df, "x", "y", 6, 9, num_nuisance_dims=8)
    values, vecs = np.linalg.svd(want)[1:]
    assert np.allclose(fit.spectrum.values, values[:8], rtol=1e-6, atol=1e-10)
    assert np.allclose(np.abs((fit.spectrum.loadings * vecs[:8].T).sum(0)), 1, atol=1e-6)
    assert np.isclose(fit.projection.residual_ratio, np.linalg.norm(want) / np.linalg.norm(y), rtol=1e-9)
    got = vectors_of(projection.projection_residuals(df, "x", "y", 6, 9), "residual", 200, 9)
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


def test_a_fit_on_two_tables_is_the_fit_on_both(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(90, 3)), rng.normal(size=(90, 7))
    df = table(spark, list(x), list(y), 4)
    whole = projection.fit_nuisance(df, "x", "y", 3, 7, num_nuisance_dims=4)
    part = None
    for some in ("item_id < 5", "item_id >= 5 AND item_id < 60", "item_id >= 60", "false"):
        part = projection.fit_nuisance(df.filter(some), "x", "y", 3, 7, num_nuisance_dims=4, known=part)
    assert part.projection.n == 90 and np.allclose(part.projection.coefficients, whole.projection.coefficients)
    assert np.allclose(part.spectrum.values, whole.spectrum.values) and np.allclose(part.spectrum.loadings, whole.spectrum.loadings)
    assert np.isclose(part.projection.residual_ratio, whole.projection.residual_ratio)
    part.projection.root = None
    with pytest.raises(ValueError, match="extended"):
        projection.fit_nuisance(df, "x", "y", 3, 7, known=part)


def test_nuisance_errors_and_default(spark):
    rng = np.random.default_rng(2)
    df = table(spark, rng.normal(size=(3, 4)), rng.normal(size=(3, 6)))
    with pytest.raises(ValueError, match="too few"):
        projection.fit_nuisance(df, "x", "y", 4, 6)
    with pytest.raises(ValueError, match="method"):
        projection.fit_nuisance(df, "x", "y", 4, 6, method="umap")
    more = table(spark, rng.normal(size=(30, 2)), rng.normal(size=(30, 4)))
    with pytest.warns(UserWarning):
        fit = projection.fit_nuisance(more, "x", "y", 2, 4)
    assert fit.dims == 3 and fit.diagnostics["num_dims"] == 5  # the request is reported


def test_gram_of_nothing_and_width(spark):
    df = table(spark, np.ones((3, 2)), np.ones((3, 2))).filter("false")
    assert projection.gram(df, "x", 2).n == 0
    with pytest.raises(ValueError):
        projection.vector_width(df, "x")


def test_elbow(spark):
    rows = projection.elbow_table(spark, np.array([3.0, 2.0, 1.0])).orderBy("dim").collect()
    assert [r.diff for r in rows] == [0.0, 1.0, 1.0]
    assert np.allclose([r.cumulative_pct for r in rows], [900 / 14, 1300 / 14, 100])


def test_ridge_against_dense(spark):
    rng = np.random.default_rng(3)
    n, d = 120, 9
    a, b, y = rng.integers(0, 4, n), rng.integers(0, 6, n), rng.normal(size=(n, d)) + 1
    df = spark.createDataFrame([(i, str(a[i]), str(b[i]), y[i].tolist()) for i in range(n)], "item_id long, a string, b string, v array<double>")
    fit = ridge.fit_ridge(df.repartition(7), {"a": "a", "b": "b"}, "v", d, alpha=2.0, n_nuisance_dims=3)
    design = np.hstack([np.eye(4)[a], np.eye(6)[b]])
    centred, target = design - design.mean(0), y - y.mean(0)
    w = np.linalg.solve(centred.T @ centred + 2.0 * np.eye(10), centred.T @ target)
    fitted = y.mean(0) + centred @ w
    assert np.allclose(fit.coefficients, w) and np.allclose(fit.intercept, y.mean(0) - design.mean(0) @ w)
    scored = fit.score(df, {"a": "a", "b": "b"}, "v").collect()
    residual = y - fitted
    assert np.allclose([r.fitted for r in sorted(scored, key=lambda r: r.item_id)], fitted)
    assert np.isclose(fit.residual_norm, np.linalg.norm(residual)) and np.isclose(fit.vector_norm, np.linalg.norm(y))
    assert np.isclose(fit.residual_variance_ratio, residual.var() / y.var())
    s = np.linalg.svd(residual, compute_uv=False)[:3]
    assert np.allclose(fit.spectrum.values, s)
    scores = np.array([r.nuisance for r in sorted(scored, key=lambda r: r.item_id)])
    assert np.allclose(fit.explained_variance_ratio, scores.var(0) / residual.var(0).sum())
    odd = spark.createDataFrame([(0, "0", "0", None), (1, "new", "0", y[0].tolist())], "item_id long, a string, b string, v array<double>")
    assert all(r.fitted is None and r.nuisance is None for r in fit.score(odd, {"a": "a", "b": "b"}, "v").collect())
    assert fit.sizes == {"a": 4, "b": 6} and fit.coefficient_frame(spark).count() == 10


def lexicon_tables(spark):
    texts = ["Red apples and red wine", "", None, "cold SNOW; snow.wine", "nothing here", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    terms = [("food", "apples"), ("food", "wine"), ("drink", "wine"), ("winter", "snow"), ("winter", "cold"), ("unused", "zebra")]
    return df, spark.createDataFrame(terms, "category string, term string")


def test_lexicon_scores_small_and_large_paths(spark, monkeypatch):
    df, terms = lexicon_tables(spark)
    want = {(0, "food"): 2 / 5, (0, "drink"): 1 / 5, (3, "winter"): 3 / 4, (3, "food"): 1 / 4, (3, "drink"): 1 / 4}
    found = lambda: {(r.item_id, r.category): r.score for r in lexicon.category_scores(df, "item_id", "text", terms).collect()}
    assert found() == want
    monkeypatch.setattr(lexicon, "fits_broadcast", lambda dim: False)
    assert found() == want


def test_lexicon_counts_a_bounded_number_of_tokens_at_once(spark, monkeypatch):
    """A batch is cut by its tokens, not only by its rows; a longer text is counted alone."""
    rows = [(i, " ".join(f"w{(i + j) % 7}" for j in range(1 + i % 23))) for i in range(300)] + [(300, "w1 " * 200), (301, ""), (302, None)]
    df = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
    terms = spark.createDataFrame([(f"c{i % 3}", f"w{i}") for i in range(7)], "category string, term string")
    want = sorted(lexicon.category_scores(df, "item_id", "text", terms).collect())

    class Bounded(lexicon.Terms):
        def hits(self, texts):
            if len(texts) > 1 and len(texts.flatten()) > 64:
                raise ValueError(f"{len(texts.flatten())} tokens at once")
            return super().hits(texts)

    monkeypatch.setattr(lexicon, "TOKENS_AT_ONCE", 64, raising=False)
    monkeypatch.setattr(lexicon, "Terms", Bounded)
    assert sorted(lexicon.category_scores(df, "item_id", "text", terms).collect()) == want and len(want) > 300


def test_lexicon_controls_hold_a_bounded_number_of_cells(spark, monkeypatch):
    """Batches of scores are cut before a row of numbers is held for each score; the controls are the same."""
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(1 + i % 9))) for i in range(400)], "item_id long, text string").coalesce(1)
    terms = spark.createDataFrame([(f"c{i}", f"w{i}") for i in range(11)], "category string, term string")
    one, fit = lexicon.lexicon_controls(df, "item_id", "text", terms, 3)
    want, times, fill = sorted(one.collect()), lexicon._times, lexicon._fill

    def bounded_times(batch, matrix):
        if batch.num_rows > 1 and len(batch.column("cols").flatten()) * matrix.shape[1] > 120:
            raise ValueError("too many cells at once")
        return times(batch, matrix)

    def bounded_fill(batch, width):
        if batch.num_rows * width > 120:
            raise ValueError("too many cells at once")
        return fill(batch, width)

    monkeypatch.setattr(lexicon, "CELLS_AT_ONCE", 120, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(i % 11)) for i in range(99)], pa.list_(pa.int32()))], names=["cols"])
    parts = list(lexicon._parts(iter([batch]), 11, 3))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows * 11 <= 120 and len(p.column("cols").flatten()) * 3 <= 120 for p in parts)
    monkeypatch.setattr(lexicon, "_times", bounded_times)
    monkeypatch.setattr(lexicon, "_fill", bounded_fill)
    # The function that cuts travels by value here, so that it sees the smaller bound.
    monkeypatch.setattr(lexicon, "_parts", lambda batches, width, columns: (
        part for batch in batches for part in lexicon.shares(batch, batch.column("cols"), 120 // columns, 120 // width)), raising=False)
    again, other = lexicon.lexicon_controls(df, "item_id", "text", terms, 3)
    assert np.allclose(fit.spectrum.values, other.spectrum.values, rtol=1e-12)
    found = sorted(again.collect())
    assert [r.item_id for r in found] == [r.item_id for r in want]
    assert np.allclose(np.abs([r.controls for r in found]), np.abs([r.controls for r in want]), atol=1e-9)


def test_lexicon_controls_against_numpy(spark):
    df, terms = lexicon_tables(spark)
    out, fit = lexicon.lexicon_controls(df, "item_id", "text", terms, 2)
    assert fit.categories == ["drink", "food", "unused", "winter"] and fit.n_empty == 3
    dense = np.zeros((6, 4))
    dense[0, :2], dense[3] = [0.2, 0.4], [0.25, 0.25, 0, 0.75]
    s = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(fit.spectrum.values, s[:2])
    scores = vectors_of(out, "controls", 6, 2)
    assert np.allclose(scores.T @ scores, np.diag(s[:2] ** 2)) and (scores[[1, 2, 4, 5]] == 0).all()
    assert np.allclose(fit.explained_variance_ratio, scores.var(0) / dense.var(0).sum())
    assert np.allclose(fit.means, dense.mean(0)) and np.allclose(fit.stds, dense.std(0))
    with pytest.raises(ValueError):
        lexicon.lexicon_controls(df, "item_id", "text", terms, 5)


def test_many_categories(spark, monkeypatch):
    """More categories than the dense solve takes: same controls by subspace iteration, and plain scores at any number."""
    df, terms = lexicon_tables(spark)
    out, fit = lexicon.lexicon_controls(df, "item_id", "text", terms, 2)
    monkeypatch.setattr(lexicon, "DENSE_CATEGORIES", 1)
    wide, other = lexicon.lexicon_controls(df, "item_id", "text", terms, 2)
    assert np.allclose(fit.spectrum.values, other.spectrum.values) and np.allclose(fit.explained_variance_ratio, other.explained_variance_ratio)
    dense = {r.item_id: r.controls for r in out.collect()}
    assert all(np.allclose(dense[r.item_id], r.controls, atol=1e-6) for r in wide.collect())
    rows = [(f"c{i:05}", f"term{i}") for i in range(5000)]
    many = spark.createDataFrame(rows, "category string, term string")
    texts = spark.createDataFrame([(i, f"term{i} term{i + 1} other") for i in range(40)], "item_id long, text string")
    assert lexicon.category_summary(texts, "item_id", "text", many).count() == 5000
    controls, fit = lexicon.lexicon_controls(texts, "item_id", "text", many, 3)
    x = np.zeros((40, 41))
    x[range(40), range(40)] = x[range(40), range(1, 41)] = 1 / 3
    assert np.allclose(fit.spectrum.values, np.linalg.svd(x)[1][:3], rtol=1e-4) and controls.count() == 40


def test_ridge_with_many_labels(spark, monkeypatch):
    """Conjugate gradients on tables give what elimination gives; coefficients in a table what those in memory give."""
    rng = np.random.default_rng(4)
    rows = [(i, f"a{rng.integers(30)}", f"b{rng.integers(6) ** 2}", rng.normal(size=3).tolist()) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, "a1", "b0", None)], "item_id long, a string, b string, v array<double>")
    columns = {"a": "a", "b": "b"}
    dense = ridge.fit_ridge(df, columns, "v", 3, alpha=0.7, n_nuisance_dims=2)
    monkeypatch.setattr(ridge, "DENSE_REST", 3)
    wide = ridge.fit_ridge(df, columns, "v", 3, alpha=0.7, n_nuisance_dims=2)
    monkeypatch.undo()
    monkeypatch.setattr(ridge, "SMALL_BYTES", 0)
    monkeypatch.setattr(ridge, "BLOCK_ROWS", 7)
    same_ridge(spark, df, columns, dense, ridge.fit_ridge(df, columns, "v", 3, alpha=0.7, n_nuisance_dims=2))
    same_ridge(spark, df, columns, dense, wide)


def same_ridge(spark, df, columns, dense, wide):
    assert wide.coefficients is None and np.allclose(wide.intercept, dense.intercept)
    frame = lambda fit: {(r.attribute, r.idx): r.coefficients for r in fit.coefficient_frame(spark).collect()}
    assert frame(wide).keys() == frame(dense).keys() and all(np.allclose(v, frame(dense)[k]) for k, v in frame(wide).items())
    assert np.allclose(wide.spectrum.values, dense.spectrum.values) and np.allclose(wide.residual_variance_ratio, dense.residual_variance_ratio)
    scored = {r.item_id: r for r in wide.score(df, columns, "v", spread_by="item_id").collect()}
    for r in dense.score(df, columns, "v").collect():
        for name in ("fitted", "residual", "nuisance"):
            assert (scored[r.item_id][name] is None) == (r[name] is None)
            assert r[name] is None or np.allclose(scored[r.item_id][name], r[name])


@pytest.mark.parametrize("many, parts", [(10, 3), (11_000, 8)])
def test_ridge_normal_equations(spark, many, parts):
    """Few labels or many: the same way, and the normal equations hold."""
    rng = np.random.default_rng(5)
    rows = [(i, f"a{i % many}", f"b{rng.integers(4)}", f"c{rng.integers(3)}", (rng.normal(size=2) + 100).tolist()) for i in range(15_000)]
    df = spark.createDataFrame(rows, "item_id long, a string, b string, c string, v array<double>").repartition(parts)
    columns = {x: x for x in "abc"}
    fit = ridge.fit_ridge(df, columns, "v", 2, alpha=1.0, n_nuisance_dims=1)
    assert sum(fit.sizes.values()) == many + 7
    scored = fit.mapping.transform(fit.score(df, columns, "v", spread_by="item_id"), columns).toPandas()
    residual = np.stack(scored.residual)
    assert np.allclose(residual.sum(0), 0, atol=1e-6)  # the intercept is free
    assert np.isclose(np.sqrt((residual**2).sum()), fit.residual_norm)
    for name in "abc":  # residuals of a label add up to alpha times its coefficients
        sums = np.zeros((fit.sizes[name], 2))
        np.add.at(sums, scored[f"{name}_idx"].to_numpy(), residual)
        w = {r.idx: r.coefficients for r in fit.coefficient_frame(spark).filter(f"attribute = '{name}'").collect()}
        assert np.allclose(sums, [w[i] for i in range(len(w))], atol=1e-6)


def test_flat_spectra_converge_or_raise(spark, monkeypatch):
    """Singular values 0.1 % apart: vectors as exact as the dense ones; running out of steps is an error."""
    width = 300
    values = (1 - 0.001 * np.arange(width)) ** 2
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(width, width)))[0]
    cross = (turn * values) @ turn.T
    found, vecs = lexicon._leading(lambda block: cross @ block, width, 10)
    assert np.allclose(found, values[:10], atol=1e-10) and np.allclose(np.abs(vecs.T @ turn[:, :10]), np.eye(10), atol=1e-7)
    rows = [([i], [float(np.sqrt(v))]) for i, v in enumerate(values[:40])]
    sparse = spark.createDataFrame(rows, "cols array<int>, vals array<double>")
    got, sums, squares = lexicon._wide_spectrum(sparse, 40, 3)
    assert np.allclose(got.loadings, np.eye(40)[:, :3], atol=1e-7) and np.allclose(squares, values[:40]) and np.allclose(sums**2, values[:40])
    monkeypatch.setattr(lexicon, "STEPS", 2)
    with pytest.raises(ArithmeticError):
        lexicon._leading(lambda block: cross @ block, width, 10)


def test_ridge_without_convergence_raises(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, f"a{rng.integers(30)}", f"b{rng.integers(6)}", rng.normal(size=2).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id long, a string, b string, v array<double>")
    monkeypatch.setattr(ridge, "DENSE_REST", 3)
    monkeypatch.setattr(ridge, "STEPS", 2)
    with pytest.raises(ArithmeticError):
        ridge.fit_ridge(df, {"a": "a", "b": "b"}, "v", 2, alpha=0.01, n_nuisance_dims=1)
