"""Projection residuals, SVD scores and nuisance controls from one triangular factor."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions import vectors
from facetry.operators.arrow import list_array, matrix
from facetry.operators.blocks import sum_over
from facetry.operators.qr import reduced, triangle

DEFAULT_NUISANCE_DIMS = 5
# Singular values of the representations below this share of the largest count as zero.
RANK_TOLERANCE = 1e-12


@dataclass
class Gram:
    """Sums over rows of a vector column: count, column sums and crossproduct."""

    n: int
    sums: np.ndarray
    cross: np.ndarray

    @classmethod
    def from_flat(cls, flat: np.ndarray | None, width: int) -> Gram:
        """From count, sums and upper triangle laid end to end; None counts as no rows."""
        cross = np.zeros((width, width))
        if flat is None:
            return cls(0, np.zeros(width), cross)
        cross[np.triu_indices(width)] = flat[1 + width :]
        return cls(int(flat[0]), flat[1 : 1 + width], cross + np.triu(cross, 1).T)


def gram(df: DataFrame, vector: Column | str, width: int) -> Gram:
    """One pass; each task adds up its rows batch by batch, in double. Null rows are skipped."""
    column = F.col(vector) if isinstance(vector, str) else vector
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        n, sums, cross = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            rows, _ = matrix(batch.column(0))
            if len(rows):
                n += len(rows)
                sums += rows.sum(axis=0)
                cross += rows.T @ rows
        return np.concatenate([[n], sums, cross[upper]]) if n else None

    return Gram.from_flat(sum_over(df.select(column.alias("v")), partial), width)


def gram_frame(spark: SparkSession, g: Gram) -> DataFrame:
    """The crossproduct as ``(i, j, value)`` rows, upper triangle, 1-based."""
    i, j = np.triu_indices(len(g.cross))
    rows = list(zip((i + 1).tolist(), (j + 1).tolist(), g.cross[i, j].tolist()))
    return spark.createDataFrame(rows, "i int, j int, value double")


def vector_width(df: DataFrame, vector: str) -> int:
    """Entries of the vectors; the most frequent width where they differ."""
    row = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("w")).count().orderBy(
        F.desc("count"), F.desc("w")).first()
    if row is None:
        raise ValueError(f"no vector in column {vector}")
    return row["w"]


@dataclass
class Spectrum:
    """Right singular vectors (columns) and singular values, largest first, of an uncentred matrix."""

    loadings: np.ndarray
    values: np.ndarray


def spectrum(cross: np.ndarray, k: int) -> Spectrum:
    """From a crossproduct. Signs are fixed: the largest loading of each vector is positive."""
    eigenvalues, vecs = np.linalg.eigh((cross + cross.T) / 2)
    order = np.argsort(eigenvalues)[::-1][:k]
    return Spectrum(_signed(vecs[:, order]), np.sqrt(np.clip(eigenvalues[order], 0, None)))


def spectrum_of_root(root: np.ndarray, k: int) -> Spectrum:
    """From a matrix whose crossproduct is that of the rows; its condition is not squared."""
    _, values, vecs = np.linalg.svd(root)
    values = np.concatenate([values, np.zeros(root.shape[1] - len(values))])
    return Spectrum(_signed(vecs[:k].T), values[:k])


def _signed(vecs: np.ndarray) -> np.ndarray:
    largest = np.abs(vecs).argmax(axis=0)
    return vecs * np.where(vecs[largest, np.arange(vecs.shape[1])] < 0, -1.0, 1.0)


def elbow_table(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """Per component: singular value, drop from the one before, cumulative percent of the squares."""
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "dim int, singular_value double")
    order = Window.orderBy("dim")  # one row per computed component, 20 by default
    square = F.col("singular_value") * F.col("singular_value")
    total = F.sum(square).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    drop = F.coalesce(F.lag("singular_value").over(order) - F.col("singular_value"), F.lit(0.0))
    return df.select("dim", "singular_value", drop.alias("diff"), (100 * F.sum(square).over(order) / total).alias("cumulative_pct"))


@dataclass
class Projection:
    """Least squares of Y on X without intercept; ``residual_root`` has the crossproduct of the residuals."""

    coefficients: np.ndarray
    residual_root: np.ndarray
    total_squares: float
    n: int
    #: The triangular factor of all columns: with it a fit can be extended by more rows.
    root: np.ndarray | None = None

    @property
    def residual_ratio(self) -> float:
        """Frobenius norm of the residuals over that of Y."""
        return float(np.sqrt((self.residual_root**2).sum() / self.total_squares))


def fit_projection(df: DataFrame, x: str, y: str, x_width: int, y_width: int, known: Projection | None = None) -> Projection:
    """Fit on the rows valid in both columns, and with ``known`` on those it was fitted on as well.

    In the triangular factor of the columns of X and Y, the corner of X gives the coefficients
    as the rows would, and what they leave of the corner of Y is as long as the residuals. The
    residuals themselves are never stored. Factors of two sets of rows, stacked, have that of both.
    """
    if known is not None and known.root is None:
        raise ValueError("this fit can't be extended: it was saved without its factor")
    ok = vectors.valid(F.col(x), x_width) & vectors.valid(F.col(y), y_width)
    both = F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"))
    n, root = triangle(df.filter(ok), both, x_width + y_width)
    if known is not None:
        n, root = n + known.n, reduced(np.concatenate([known.root, root]))
    if n < x_width:
        raise ValueError(f"too few valid rows ({n}) for a projection on {x_width} columns")
    xs, ys = root[:, :x_width], root[:, x_width:]
    coefficients = np.linalg.pinv(xs, rcond=RANK_TOLERANCE) @ ys
    return Projection(coefficients, ys - xs @ coefficients, float((ys**2).sum()), n, root)


def map_vectors(df: DataFrame, x: str, y: str, out: str, x_width: int, y_width: int, ax: np.ndarray, ay: np.ndarray) -> DataFrame:
    """Add ``out = x @ ax + y @ ay`` (null for rows invalid in either), batch by batch.

    Every column of ``df`` crosses to Python, so select what is needed first.
    """
    ok = vectors.valid(F.col(x), x_width) & vectors.valid(F.col(y), y_width)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            present = table["_ok"].to_numpy(zero_copy_only=False)
            xs, ys = (matrix(table[c].filter(table["_ok"]))[0] for c in (x, y))
            result = xs @ ax + ys @ ay if len(xs) else np.zeros((0, ax.shape[1]))
            columns = [*(table[n] for n in names), list_array(result, present, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    return df.withColumn("_ok", ok).mapInArrow(run, schema)


def projection_residuals(df: DataFrame, x: str, y: str, x_width: int, y_width: int, out: str = "residual") -> DataFrame:
    """Add ``y - x B``; null for rows invalid in either column."""
    fit = fit_projection(df, x, y, x_width, y_width)
    return map_vectors(df, x, y, out, x_width, y_width, -fit.coefficients, np.eye(y_width))


@dataclass
class Nuisance:
    """A fitted nuisance projection: scores are ``(y - x B) V``."""

    projection: Projection
    spectrum: Spectrum
    dims: int
    diagnostics: dict

    def score(self, df: DataFrame, x: str, y: str, out: str = "nuisance") -> DataFrame:
        """Add the scores; row by row, so it also runs on a stream."""
        v = self.spectrum.loadings[:, : self.dims]
        b = self.projection.coefficients
        return map_vectors(df, x, y, out, b.shape[0], b.shape[1], -b @ v, v)


def fit_nuisance(
    df: DataFrame,
    x: str,
    y: str,
    x_width: int,
    y_width: int,
    num_nuisance_dims: int | None = None,
    method: str = "svd",
    k_svd: int = 20,
    known: Nuisance | None = None,
) -> Nuisance:
    """Directions of the full vectors that the representations do not explain.

    With ``known`` the rows are added to those of that fit, which need not be read again.

    One pass over the rows; the right singular vectors of the residuals are those of
    what is left of their triangular factor.
    """
    if method != "svd":
        raise ValueError(f"unknown method {method!r}: only 'svd' runs distributed")
    using_default = num_nuisance_dims is None
    if using_default:
        num_nuisance_dims = DEFAULT_NUISANCE_DIMS
        warnings.warn(f"using {num_nuisance_dims} nuisance dimensions; see the elbow table before relying on it", stacklevel=2)
        k_svd = max(k_svd, 20)
    fit = fit_projection(df, x, y, x_width, y_width, known.projection if known else None)
    spec = spectrum_of_root(fit.residual_root, max(min(k_svd, fit.n - 1, y_width - 1), 1))
    diagnostics = {"method": method, "singular_values": spec.values.tolist(),
                   "num_dims": num_nuisance_dims, "using_default": using_default}
    return Nuisance(fit, spec, min(num_nuisance_dims, len(spec.values)), diagnostics)


def nuisance_controls(df: DataFrame, blocks: list[str], y: str, widths: list[int], y_width: int,
                      num_nuisance_dims: int | None = None, method: str = "svd") -> tuple[DataFrame, Nuisance]:
    """Join the attribute blocks in the given order and add ``interpretable`` and ``nuisance``."""
    combined = df.withColumn("interpretable", F.concat(*[F.col(b) for b in blocks]))
    fit = fit_nuisance(combined, "interpretable", y, sum(widths), y_width, num_nuisance_dims, method)
    return fit.score(combined, "interpretable", y), fit
