"""Lexicon scores per text and their SVD.

The lexicon is a table ``(category, term)``. Texts are lower-cased and split on
non-word characters; a category's score is its term hits over the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.text import strip
from facetry.operators.arrow import list_array, matrix, shares
from facetry.operators.blocks import sum_over
from facetry.operators.lookup import attach, fits_broadcast, salted_join
from facetry.operators.projection import Gram, Spectrum, spectrum
from facetry.session import stage

#: Up to this width the crossproduct of the scores is summed and solved at once, beyond it by block Lanczos.
DENSE_CATEGORIES = 4_000
#: Tokens and dense cells that a task counts at once, whatever the rows of its batches.
TOKENS_AT_ONCE, CELLS_AT_ONCE = 500_000, 2_000_000
#: Columns of a block beside the wanted ones, products at most, blocks kept before a restart, and the residual wanted.
OVERSAMPLE, STEPS, BLOCKS, TOLERANCE = 8, 3000, 8, 1e-11


def tokens(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


class Terms:
    """A small lexicon as arrays: each term with the columns of its categories."""

    def __init__(self, categories: list, rows: list):
        column = {c: i for i, c in enumerate(categories)}
        self.width = len(categories)
        self.terms = pa.array([r["term"] for r in rows], pa.string())
        lists = [[column[c] for c in r["categories"]] for r in rows]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.columns = np.array([c for x in lists for c in x], dtype=np.int64)

    def hits(self, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Hit counts of a batch of token lists as a dense matrix, and the list lengths."""
        lengths = np.diff(texts.offsets.to_numpy())
        found = pc.index_in(texts.flatten(), value_set=self.terms).fill_null(-1).to_numpy()
        known = found >= 0
        rows = np.repeat(np.arange(len(texts)), lengths)[known]
        # Count each distinct term of a text once, then spread the count over its categories.
        pairs, counts = np.unique(rows * len(self.terms) + found[known], return_counts=True)
        row, term = np.divmod(pairs, max(len(self.terms), 1))
        fan = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(fan)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - fan, fan)
        column = self.columns[np.repeat(self.starts[term], fan) + place]
        cells = np.repeat(row, fan) * self.width + column
        dense = np.bincount(cells, weights=np.repeat(counts, fan), minlength=len(texts) * self.width)
        return dense.reshape(len(texts), self.width), lengths


def _sparse_small(df: DataFrame, item_id: str, text: str, terms: Terms) -> DataFrame:
    """One row per item with its hit columns and scores. Items do not meet, nothing is shuffled."""
    step = max(1, CELLS_AT_ONCE // max(terms.width, 1))

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        dense, lengths = terms.hits(part.column(1))
        row, column = np.nonzero(dense)
        scores = dense[row, column] / lengths[row]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dense)))]), pa.int32())
        return pa.RecordBatch.from_arrays([
            part.column(0), pa.ListArray.from_arrays(offsets, pa.array(column, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float64()))], names=[item_id, "cols", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shares(batch, batch.column(1), TOKENS_AT_ONCE, step):
                yield scored(part)

    schema = T.StructType([df.schema[item_id], T.StructField("cols", T.ArrayType(T.IntegerType())),
                           T.StructField("vals", T.ArrayType(T.DoubleType()))])
    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    return df.select(item_id, words.alias("_tokens")).mapInArrow(run, schema)


def _long_scores(df: DataFrame, item_id: str, text: str, by_term: DataFrame) -> DataFrame:
    """``(item_id, category, score)`` by joins, for a lexicon too large to travel; frequent terms are salted."""
    # The count is taken below the explode: above it, every token would carry the whole text.
    split = df.select(item_id, tokens(F.col(text)).alias("_tokens")).withColumn("n_tokens", F.size("_tokens"))
    words = split.select(item_id, "n_tokens", F.explode("_tokens").alias("term"))
    counted = stage(words.groupBy(item_id, "n_tokens", "term").agg(F.count("*").alias("n")), "term-counts")
    known = salted_join(counted, by_term, ["term"], "inner", item_id)
    hits = known.select(item_id, "n_tokens", "n", F.explode("categories").alias("category"))
    return hits.groupBy(item_id, "n_tokens", "category").agg((F.sum("n") / F.col("n_tokens")).alias("score")).select(item_id, "category", "score")


def _sparse_large(df: DataFrame, item_id: str, text: str, by_term: DataFrame, columns: DataFrame) -> DataFrame:
    placed = attach(_long_scores(df, item_id, text, by_term), columns, ["category"], "inner", spread_by=item_id)
    grouped = placed.groupBy(item_id).agg(F.collect_list(F.struct("column", "score")).alias("hits"))
    filled = df.select(item_id).join(grouped, item_id, "left")
    cells = F.coalesce("hits", F.array().cast("array<struct<column:int,score:double>>"))
    return filled.select(item_id, F.transform(cells, lambda h: h["column"]).alias("cols"), F.transform(cells, lambda h: h["score"]).alias("vals"))


def _categories(lexicon: DataFrame) -> tuple[list, DataFrame]:
    """Sorted category names, and the table ``(category, column)``."""
    names = sorted(r["category"] for r in lexicon.select("category").distinct().collect())  # which the diagnostics list
    schema = T.StructType([T.StructField("category", lexicon.schema["category"].dataType), T.StructField("column", T.IntegerType())])
    return names, lexicon.sparkSession.createDataFrame(list(zip(names, range(len(names)))), schema)


def sparse_scores(df: DataFrame, item_id: str, text: str, lexicon: DataFrame) -> tuple[DataFrame, list, DataFrame]:
    """``(item_id, cols, vals)`` for every item, the category names and their table.

    With a lexicon of measured small size this is a single pass over the texts.
    """
    names, columns = _categories(lexicon)
    by_term = _by_term(lexicon)
    if fits_broadcast(by_term):
        return _sparse_small(df, item_id, text, Terms(names, by_term.collect())), names, columns
    return _sparse_large(df, item_id, text, by_term, columns), names, columns


def _by_term(lexicon: DataFrame) -> DataFrame:
    pairs = lexicon.select("category", F.lower("term").alias("term")).distinct()
    return stage(pairs.groupBy("term").agg(F.collect_set("category").alias("categories")), "lexicon")


def category_scores(df: DataFrame, item_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Non-zero scores ``(item_id, category, score)``, of any number of categories."""
    by_term = _by_term(lexicon)
    if not fits_broadcast(by_term):
        return _long_scores(df, item_id, text, by_term)
    names, columns = _categories(lexicon)
    sparse = _sparse_small(df, item_id, text, Terms(names, by_term.collect()))
    cells = sparse.select(item_id, F.explode(F.arrays_zip("cols", "vals")).alias("c"))
    flat = cells.select(item_id, F.col("c.cols").alias("column"), F.col("c.vals").alias("score"))
    return flat.join(F.broadcast(columns), "column").select(item_id, "category", "score")  # as many rows as the lexicon that fits


def category_summary(df: DataFrame, item_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Per category the mean and population deviation of the score over all items."""
    scores = category_scores(df, item_id, text, lexicon)
    # The hits' own mean and deviation, and then the zeros of the other items: no difference of large squares.
    sums = scores.groupBy("category").agg(F.count("*").alias("k"), F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    n = df.agg(F.nullif(F.count("*"), F.lit(0)).alias("n_items"))  # one row
    all_categories = lexicon.select("category").distinct()
    share = F.coalesce("k", F.lit(0)) / F.col("n_items")
    hit_mean = F.coalesce("m", F.lit(0.0))
    variance = share * F.coalesce("v", F.lit(0.0)) + share * (1 - share) * hit_mean * hit_mean
    return all_categories.join(sums, "category", "left").join(F.broadcast(n)).select(
        "category", (share * hit_mean).alias("mean"), F.sqrt(variance).alias("std"))


def count_empty(df: DataFrame, text: str) -> DataFrame:
    blank = F.coalesce(strip(F.col(text)), F.lit("")) == ""
    return df.agg(F.count("*").alias("n_items"), F.count_if(blank).alias("n_empty"))


@dataclass
class LexiconControls:
    categories: list
    spectrum: Spectrum
    explained_variance_ratio: np.ndarray
    means: np.ndarray
    stds: np.ndarray
    n_items: int
    n_empty: int

    @property
    def diagnostics(self) -> dict:
        return {
            "categories": self.categories,
            "n_categories": len(self.categories),
            "n_components": len(self.spectrum.values),
            "explained_variance_ratio": self.explained_variance_ratio.tolist(),
            "total_explained_variance": float(self.explained_variance_ratio.sum()),
            "n_empty": self.n_empty,
            "category_scores_mean": self.means.tolist(),
            "category_scores_std": self.stds.tolist(),
        }


def _fill(batch: pa.RecordBatch, width: int) -> np.ndarray:
    cols, vals = batch.column(batch.schema.get_field_index("cols")), batch.column(batch.schema.get_field_index("vals"))
    dense = np.zeros((batch.num_rows, width))
    rows = np.repeat(np.arange(batch.num_rows), np.diff(cols.offsets.to_numpy()))
    dense[rows, cols.flatten().to_numpy()] = vals.flatten().to_numpy()
    return dense


def _moments(sparse: DataFrame, width: int) -> Gram:
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        n, sums, cross = 0, np.zeros(width), np.zeros((width, width))
        for batch in _parts(batches, width, 1):
            dense = _fill(batch, width)
            n, sums, cross = n + len(dense), sums + dense.sum(axis=0), cross + dense.T @ dense
        return np.concatenate([[n], sums, cross[upper]]) if n else None

    return Gram.from_flat(sum_over(sparse.select("cols", "vals"), partial), width)


def _parts(batches: Iterator[pa.RecordBatch], width: int, columns: int) -> Iterator[pa.RecordBatch]:
    """Batches of scores, cut so that ``columns`` numbers for each score, or ``width`` for each row, are few enough to hold."""
    for batch in batches:
        cols = batch.column(batch.schema.get_field_index("cols"))
        yield from shares(batch, cols, max(1, CELLS_AT_ONCE // columns), max(1, CELLS_AT_ONCE // max(width, 1)))


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every score in a batch."""
    cols, vals = batch.column(batch.schema.get_field_index("cols")), batch.column(batch.schema.get_field_index("vals"))
    rows = np.repeat(np.arange(batch.num_rows), np.diff(cols.offsets.to_numpy()))
    return rows, cols.flatten().to_numpy(), vals.flatten().to_numpy()


def _add_rows(places: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by place."""
    out = np.zeros((size, rows.shape[1]))
    if len(places):
        order = np.argsort(places, kind="stable")
        at = np.flatnonzero(np.diff(places[order], prepend=-1))
        out[places[order][at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def _times(batch: pa.RecordBatch, matrix_: np.ndarray) -> np.ndarray:
    row, column, value = _cells(batch)
    return _add_rows(row, value[:, None] * matrix_[column], batch.num_rows)


def _leading(times, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues and eigenvectors of the symmetric non-negative map ``times``, by restarted block Lanczos.

    Ends when the residual of each wanted vector is within ``TOLERANCE`` of the largest
    eigenvalue, however close the eigenvalues are; raises ``ArithmeticError`` if it is not after ``STEPS`` products.
    """
    m = min(width, k + OVERSAMPLE)
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.normal(size=(width, m)))[0]
    image = times(basis)
    for _ in range(STEPS):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vecs = basis @ turn[:, :m]
        rest = image @ turn[:, :m] - vecs * values[:m]
        error = np.linalg.norm(rest[:, :k], axis=0).max() / max(values[0], 1e-300)
        if error <= TOLERANCE:
            return values[:k], vecs[:, :k]
        if basis.shape[1] + m > BLOCKS * m:
            keep = turn[:, : BLOCKS // 2 * m]
            basis, image = basis @ keep, image @ keep
        more = min(m, width - basis.shape[1])
        norms = np.linalg.norm(rest, axis=0)
        rest = np.where(norms > 0, rest / np.where(norms > 0, norms, 1), rng.normal(size=rest.shape))[:, :more]
        for _ in range(3):
            rest = np.linalg.qr(rest - basis @ (basis.T @ rest))[0]
        if more:
            basis, image = np.hstack([basis, rest]), np.hstack([image, times(rest)])
    raise ArithmeticError(f"singular vectors reached a residual of {error:.1e} of the largest eigenvalue in {STEPS} steps, {TOLERANCE:.0e} is wanted")


def _wide_spectrum(sparse: DataFrame, width: int, k: int) -> tuple[Spectrum, np.ndarray, np.ndarray]:
    """The leading singular vectors, and sums and sums of squares per category.

    A step is one pass over the stored scores. Tasks hold ``width * (k + 8)`` numbers, the driver ``2 * BLOCKS`` times as many.
    """

    def times(block: np.ndarray) -> np.ndarray:
        m = block.shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total, seen = np.zeros((width, m)), False
            for batch in _parts(batches, m, m):
                row, column, value = _cells(batch)
                scores = _add_rows(row, value[:, None] * block[column], batch.num_rows)
                total += _add_rows(column, value[:, None] * scores[row], width)
                seen = True
            return total.ravel() if seen else None

        return sum_over(sparse.select("cols", "vals"), partial).reshape(width, m)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, seen = np.zeros((width, 2)), False
        for batch in batches:
            _, column, value = _cells(batch)
            total += _add_rows(column, np.column_stack([value, value**2]), width)
            seen = True
        return total.ravel() if seen else None

    sums = sum_over(sparse.select("cols", "vals"), moments).reshape(width, 2)
    values, loadings = _leading(times, width, k)
    largest = np.abs(loadings).argmax(axis=0)
    loadings = loadings * np.where(loadings[largest, np.arange(k)] < 0, -1.0, 1.0)
    return Spectrum(loadings, np.sqrt(np.clip(values, 0, None))), sums[:, 0], sums[:, 1]


def lexicon_controls(
    df: DataFrame, item_id: str, text: str, lexicon: DataFrame, n_components: int = 10
) -> tuple[DataFrame, LexiconControls]:
    """Scores reduced to ``n_components`` by an uncentred SVD: ``(item_id, controls)`` and diagnostics.

    Items without a hit, empty texts included, have an all-zero row and so zero controls.
    """
    sparse, names, _ = sparse_scores(df, item_id, text, lexicon)
    width = len(names)
    if n_components > width:
        raise ValueError(f"n_components ({n_components}) exceeds the number of categories ({width})")
    sparse = stage(sparse, "lexicon-scores")
    counts = count_empty(df, text).first()
    n = counts.n_items
    if width <= DENSE_CATEGORIES:
        g = _moments(sparse, width)
        spec, sums, squares = spectrum(g.cross, n_components), g.sums, np.diag(g.cross)
    else:
        spec, sums, squares = _wide_spectrum(sparse, width, n_components)
    means = sums / n
    variances = np.clip(squares / n - means**2, 0, None)
    score_means = means @ spec.loadings
    ratios = (spec.values**2 / n - score_means**2) / variances.sum()
    fit = LexiconControls(names, spec, ratios, means, np.sqrt(variances), n, counts.n_empty)

    shared = df.sparkSession.sparkContext.broadcast(spec.loadings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, shared.value.shape[1], shared.value.shape[1]):
            scores = _times(batch, shared.value)
            present = np.ones(batch.num_rows, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(scores, present, pa.float64())], names=[item_id, "controls"])

    id_type = df.schema[item_id].dataType
    schema = T.StructType([T.StructField(item_id, id_type), T.StructField("controls", T.ArrayType(T.DoubleType()))])
    return sparse.select(item_id, "cols", "vals").mapInArrow(run, schema), fit
