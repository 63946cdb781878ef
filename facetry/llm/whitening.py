"""Embeddings projected on the principal components of all of them, with unit variance.

Entries become integers, so sums are exact. A partition keeps the eigendecomposition of
its own rows and brings it up to date row by row; the spectra of the partitions are
combined in groups, again by rank-one terms, until one is left. Rounding that the many updates
have gathered goes in a last pass: the covariance of all rows in the basis found, which is
nearly diagonal, is summed over the table and decomposed once (Rayleigh-Ritz).

A task holds one or a few matrices of width x width, whatever the number of rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import table
from facetry.llm.eigen import Spectrum
from facetry.operators.blocks import sum_over

SCALE, SHIFT = 64, 1_000_000
#: Spectra combined by one task.
FAN_IN = 64
#: Variances below this share of the largest count as none.
NONE = 1e-12
STATE = "at long, n long, sums array<string>, values array<double>, vectors binary"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``floor(SCALE * entry)`` for valid vectors, and the mask of those among all rows."""
    lengths = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null entries become NaN
    present = np.flatnonzero(lengths)
    good = lengths > 0
    if len(present):
        ends = np.cumsum(lengths[present])
        good[present] = np.logical_and.reduceat(np.isfinite(flat), ends - lengths[present])
    widths = np.unique(lengths[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths.tolist()}")
    rows = flat[np.repeat(good[present], lengths[present])].reshape(int(good.sum()), -1 if good.any() else 0)
    rows = np.floor(rows * SCALE)
    if rows.size and np.abs(rows).max() >= 2.0**62:
        raise ArithmeticError("an entry is outside the range of the integers")
    return rows.astype(np.int64), good


def _spectra(rows: DataFrame) -> DataFrame:
    """One spectrum per partition that has valid rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            some, _ = integers(batch.column(1))
            if len(some):
                found = found or Spectrum.empty(some.shape[1])
                found.add_rows(some)
        if found:
            yield _packed(TaskContext.get().partitionId(), found)

    return rows.mapInArrow(run, STATE)


def _packed(at: int, s: Spectrum) -> pa.RecordBatch:
    columns = [
        pa.array([at], pa.int64()), pa.array([s.n], pa.int64()), pa.array([[str(x) for x in s.sums]], pa.list_(pa.string())),
        pa.array([s.values.tolist()], pa.list_(pa.float64())), pa.array([s.vectors.tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["at", "n", "sums", "values", "vectors"])


def _unpacked(n: int, sums: list[str], values: list[float], vectors: bytes) -> Spectrum:
    width = len(sums)
    return Spectrum(n, np.array([int(x) for x in sums], object), np.array(values), np.frombuffer(vectors).reshape(width, width))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spectra of each group, in the order of their numbers."""
    groups = defaultdict(list)
    for batch in batches:
        for r in batch.to_pylist():
            groups[r["at"] // FAN_IN].append(r)
    for group, rows in groups.items():
        rows.sort(key=lambda r: r["at"])
        total = None
        for r in rows:
            one = _unpacked(r["n"], r["sums"], r["values"], r["vectors"])
            if total is None:
                total = Spectrum.empty(len(one.sums))
            if len(one.sums) != len(total.sums):
                raise ValueError(f"vectors of different widths: {sorted({len(one.sums), len(total.sums)})}")
            total.merge(one)
        yield _packed(group, total)


def spectrum(rows: DataFrame) -> Spectrum | None:
    """The spectrum of all rows ``(key, vector)``; None if none is valid."""
    spectra, groups = _spectra(rows), rows.rdd.getNumPartitions()
    while groups > 1:
        groups = -(-groups // FAN_IN)
        spectra = spectra.repartition(groups, F.floor(F.col("at") / FAN_IN)).mapInArrow(_combine, STATE)
    found = spectra.collect()  # one row
    if not found:
        return None
    r = found[0]
    return _unpacked(r["n"], r["sums"], r["values"], bytes(r["vectors"]))


@dataclass
class Whitening:
    """Fitted on ``n`` vectors: exact sums, components as columns, their variances, the trace, and the check."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return rows - np.array([s / self.n for s in self.sums])

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """One column per component; NaN where a component has no variance."""
        with np.errstate(all="ignore"):
            return np.where(self.some(), self.centred(rows) @ self.components / np.sqrt(self.variances), np.nan)

    def some(self) -> np.ndarray:
        return self.variances > NONE * max(self.variances.max(initial=0.0), 0.0)

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """``sum_j (n x_j - S_j)^2`` of each row, exact: as int64 where that surely holds it, else as Python integers."""
        most = self.n * int(np.abs(rows).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most * most * max(rows.shape[1], 1) < 1 << 63:
            away = self.n * rows - self.sums.astype(np.int64)
            return (away * away).sum(1)
        away = self.n * rows.astype(object) - self.sums
        return (away * away).sum(1)


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> Whitening | None:
    """Components of all valid vectors, by falling variance; None if there is no valid vector.

    A vector is valid if it is not null, has entries, and none of them is null or not finite.
    Valid vectors must have one width (``ValueError``), and entries times 64 must be below 2^62
    (``ArithmeticError``). Signs: the largest loading of a component is positive.
    """
    rows = _read(vectors, key, vector)
    found = spectrum(rows)
    if found is None:
        return None
    basis, _ = np.linalg.qr(found.vectors)
    width = len(basis)
    mean = found.mean()

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            some, _ = integers(batch.column(1))
            if len(some):
                some = (some - mean) @ basis
                total = some.T @ some + (0 if total is None else total)
        return None if total is None else total.ravel()

    ritz = sum_over(rows, squares).reshape(width, width) / found.n
    values, turns = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    chosen = basis @ turns[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(0), np.arange(len(order))])
    model = Whitening(found.n, found.sums, chosen * signs, np.maximum(values[order], 0.0), float(np.trace(ritz)))
    model.identity_error = _identity_error(rows, model)
    return model


def _read(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("_vector"))


def _identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over components that have variance."""
    some = model.some()
    k = int(some.sum())
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        """Rows, sums, squares around the means of the task, and squares of those means."""
        n, sums, squares = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            found, _ = integers(batch.column(1))
            if len(found):
                found = model.whitened(found)[:, some]
                own, more = found.mean(0), len(found)
                away = own - (sums / n if n else 0)
                squares += (found - own).T @ (found - own) + np.outer(away, away) * (n * more / (n + more) if n else 0)
                n, sums = n + more, sums + found.sum(0)
        return np.concatenate([[n], sums, squares.ravel(), (np.outer(sums, sums) / n).ravel()]) if n else None

    total = sum_over(rows, moments)
    n, sums = total[0], total[1 : k + 1]
    inside, means = total[k + 1 :].reshape(2, k, k)
    covariance = (inside + means - np.outer(sums, sums) / n) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row per valid vector and component.

    ``deviation`` is an exact ``decimal(38,0)``. Rows whose vector is not valid (see ``fit``) go; null
    keys stay, repeated rows are rows of their own. ``whitened`` is null for a component without
    variance (one vector, or fewer directions than components), which ``identity_error`` leaves
    out; that is null if none has variance. A table without valid vectors gives no row.
    """
    model = fit(vectors, key, vector, components)
    schema = f"`{key}` {dict(vectors.dtypes)[key]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # width x components
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.variances)
        explained = model.variances / model.trace if model.trace else np.zeros(k)
        for batch in batches:
            rows, good = integers(batch.column(1))
            if not len(rows):
                continue
            size, values = len(rows) * k, model.whitened(rows).ravel()
            at = pa.array(np.repeat(np.flatnonzero(good), k))
            exact = model.deviations(rows)
            exact = pa.array([Decimal(int(x)) for x in exact], pa.decimal128(38, 0)) if exact.dtype == object else pa.array(exact).cast(pa.decimal128(38, 0))
            columns = [
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(size, model.n, np.int64)),
                exact.take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(values, mask=np.isnan(values)), pa.array(np.tile(explained, len(rows))),
                pa.array([model.identity_error] * size, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _read(vectors, key, vector).mapInArrow(run, schema)


def op11_whitening(spark, folder):
    """All embeddings on their first 32 components; ``deviation`` is null where a long can't hold it, ``deviation_exact`` has it in any case."""
    found = whiten(table(spark, folder, "embeddings"))
    fits = F.expr("try_cast(deviation AS bigint)").alias("deviation")
    return found.select("vec_id", "component", "n", fits, "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
