"""Ridge regression of vectors on one-hot attributes, from grouped sums.

The labels of one attribute never occur together, so their block of the normal equations is
diagonal. The attribute with most labels is eliminated by a group-by over its labels (Schur
complement); what is left is a system of the other attributes' labels, solved at once. The
labels of the large attribute, their sums and coefficients stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions import vectors
from facetry.operators.arrow import list_array, matrix
from facetry.operators.blocks import sum_over
from facetry.operators.labels import LabelMapping, fit_labels
from facetry.operators.lookup import attach, salted_join
from facetry.operators.projection import Gram, Spectrum, gram, spectrum
from facetry.session import discard, stage

#: Up to this many labels besides those of the largest attribute the rest is solved at once, beyond it by conjugate gradients on tables.
DENSE_REST = 3_000
#: Coefficients of up to this many bytes travel as a broadcast variable, others stay in a table.
SMALL_BYTES = 64 * 1024 * 1024
#: Labels of the largest attribute that meet the others in one dense block.
BLOCK_ROWS = 256
STEPS, TOLERANCE = 3000, 1e-11
#: Labels whose sums a task holds before it passes them on.
HELD = 16_384


def design_pairs(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Crossproduct of the one-hot design: rows per pair of labels, diagonal included.

    ``(attribute_i, label_i, attribute_j, label_j, n)`` for attributes i <= j in the order
    given. The design matrix itself is never built.
    """
    labels = {a: F.coalesce(F.col(c).cast("string"), F.lit("")) for a, c in columns.items()}
    keys = df.groupBy(*[c.alias(a) for a, c in labels.items()]).agg(F.count("*").alias("n"))
    keys = stage(keys, "design-keys")  # one row per distinct key
    names, parts = list(columns), []
    for a, b in [(a, a) for a in names] + list(combinations(names, 2)):
        parts.append(keys.groupBy(F.col(a).alias("label_i"), F.col(b).alias("label_j")).agg(F.sum("n").alias("n")).select(
            F.lit(a).alias("attribute_i"), "label_i", F.lit(b).alias("attribute_j"), "label_j", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Ridge:
    """A fitted baseline. ``coefficients`` has one row per label, attributes stacked.

    Beyond ``SMALL_BYTES`` it is None, and ``table`` holds ``(place, w)`` instead.
    """

    mapping: LabelMapping
    attributes: list[str]
    alpha: float
    intercept: np.ndarray
    coefficients: np.ndarray | None
    spectrum: Spectrum
    explained_variance_ratio: np.ndarray
    n: int
    residual_norm: float
    vector_norm: float
    residual_variance_ratio: float
    table: DataFrame | None = None

    @property
    def sizes(self) -> dict[str, int]:
        return {a: self.mapping.sizes[a] for a in self.attributes}

    def coefficient_frame(self, spark) -> DataFrame:
        """``(attribute, idx, coefficients)``, one row per label."""
        if self.table is not None:
            parts, at = [], 0
            for a in self.attributes:
                own = self.table.filter((F.col("place") >= at) & (F.col("place") < at + self.sizes[a]))
                parts.append(own.select(F.lit(a).alias("attribute"), (F.col("place") - at).cast("int").alias("idx"), F.col("w").alias("coefficients")))
                at += self.sizes[a]
            return reduce(DataFrame.unionByName, parts)
        rows, at = [], 0
        for a in self.attributes:
            rows += [(a, i, self.coefficients[at + i].tolist()) for i in range(self.sizes[a])]
            at += self.sizes[a]
        return spark.createDataFrame(rows, "attribute string, idx int, coefficients array<double>")

    def score(self, df: DataFrame, columns: dict[str, str], vector: str, spread_by: str | None = None) -> DataFrame:
        """Add ``fitted``, ``residual`` and the SVD scores ``nuisance``.

        They are null for invalid vectors and for labels without a coefficient.

        Small coefficients travel as a broadcast variable, so the pass joins nothing but the
        label numbers; those in a table are joined by label, hot labels salted.
        """
        if self.table is not None:
            return self._score_wide(df, columns, vector, spread_by)
        width, attributes = len(self.intercept), self.attributes
        offsets = np.concatenate([[0], np.cumsum([self.sizes[a] for a in attributes])[:-1]]).astype(int)
        shared = df.sparkSession.sparkContext.broadcast((self.coefficients, self.intercept, self.spectrum.loadings))
        encoded = self.mapping.transform(df, {a: columns[a] for a in attributes}, on_unknown="null", spread_by=spread_by)
        ok = vectors.valid(F.col(vector), width)
        for a in attributes:
            ok = ok & F.col(f"{a}_idx").isNotNull()
        encoded = encoded.withColumn("_ok", ok)
        names, added = df.columns, ["fitted", "residual", "nuisance"]
        schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in added]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, intercept, loadings = shared.value
            for batch in batches:
                table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                present = table["_ok"].to_numpy(zero_copy_only=False)
                rows, _ = matrix(table[vector].filter(table["_ok"]))
                rows = rows.reshape(-1, width)
                fitted = np.tile(intercept, (len(rows), 1))
                for a, at in zip(attributes, offsets):
                    fitted += weights[at + table[f"{a}_idx"].filter(table["_ok"]).to_numpy()]
                residual = rows - fitted
                results = [list_array(r, present, pa.float64()) for r in (fitted, residual, residual @ loadings)]
                yield pa.RecordBatch.from_arrays([*(table[n] for n in names), *results], names=[*names, *added])

        return encoded.mapInArrow(run, schema)

    def _score_wide(self, df: DataFrame, columns: dict[str, str], vector: str, spread_by: str | None) -> DataFrame:
        width = len(self.intercept)
        shared = df.sparkSession.sparkContext.broadcast((self.intercept, self.spectrum.loadings))
        rows = self.mapping.transform(df, {a: columns[a] for a in self.attributes}, on_unknown="null", spread_by=spread_by)
        ok, at = vectors.valid(F.col(vector), width), 0
        for i, a in enumerate(self.attributes):
            own = self.table.select((F.col("place") - at).cast("int").alias(f"{a}_idx"), F.col("w").alias(f"_w{i}"))
            own = own.filter((F.col(f"{a}_idx") >= 0) & (F.col(f"{a}_idx") < self.sizes[a]))
            rows = attach(rows, own, [f"{a}_idx"], spread_by=spread_by)
            ok, at = ok & F.col(f"{a}_idx").isNotNull(), at + self.sizes[a]
        parts = [f"_w{i}" for i in range(len(self.attributes))]
        total = reduce(lambda x, y: F.zip_with(x, y, lambda u, v: u + v), [F.col(p) for p in parts])
        rows = rows.select(*df.columns, F.when(ok, F.col(vector)).alias("_v"), F.when(ok, total).alias("_total"))
        names, added = df.columns, ["fitted", "residual", "nuisance"]
        schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in added]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            intercept, loadings = shared.value
            for batch in batches:
                found, present = matrix(batch.column(len(names)))
                fitted = matrix(batch.column(len(names) + 1))[0].reshape(-1, width) + intercept
                residual = found.reshape(-1, width) - fitted
                results = [list_array(r, present, pa.float64()) for r in (fitted, residual, residual @ loadings)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *results], names=[*names, *added])

        return rows.mapInArrow(run, schema)


def _sum_by_place(rows: DataFrame) -> DataFrame:
    """Sums of ``(place, n, v)`` by place: in the tasks first, a bounded number of places at a time, then by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def passed_on() -> pa.RecordBatch:
            vs = np.stack([h[1] for h in held.values()])
            columns = [pa.array(list(held), pa.int64()), pa.array([h[0] for h in held.values()], pa.int64()), list_array(vs, np.ones(len(vs), bool), pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["place", "n", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place, n, (v, _) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            for p, k, s in zip(place[order][first].tolist(), np.add.reduceat(n[order], first).tolist(), np.add.reduceat(v[order], first, axis=0)):
                if p in held:
                    held[p][0] += k
                    held[p][1] = held[p][1] + s
                else:
                    held[p] = [k, s]
            if len(held) > HELD:
                yield passed_on()
                held.clear()
        if held:
            yield passed_on()

    schema = "place long, n long, v array<double>"
    cast = rows.select(F.col("place").cast("long"), F.col("n").cast("long"), F.col("v").cast("array<double>"))
    # After the sort a place's rows are together, so passing on in between splits at most one place a time.
    met = cast.mapInArrow(run, schema).repartition("place").sortWithinPartitions("place")
    met = met.mapInArrow(run, schema)
    return met.groupBy("place").agg(F.sum("n").alias("n"), F.array_agg("v").alias("vs")).select(
        "place", "n", F.aggregate(F.slice("vs", 2, F.size("vs")), F.get("vs", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("v"))


def _with_arrays(df: DataFrame, inputs: list[str], outputs: list[str], step) -> DataFrame:
    """``place, n`` and new vectors ``step(n, *inputs)``; all vectors as matrices of a batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy().astype(float)[:, None]
            found = step(n, *[matrix(batch.column(i + 2))[0] for i in range(len(inputs))]) if batch.num_rows else [np.zeros((0, 0))] * len(outputs)
            present = np.ones(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[list_array(f, present, pa.float64()) for f in found]], names=["place", "n", *outputs])

    return df.select("place", "n", *inputs).mapInArrow(run, ", ".join(["place long", "n long", *[f"{o} array<double>" for o in outputs]]))


def _totals(df: DataFrame, inputs: list[str], step) -> np.ndarray:
    """Sum over the table of ``step(n, *inputs)``, a flat array per batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                n = batch.column(0).to_numpy().astype(float)[:, None]
                found = step(n, *[matrix(batch.column(i + 1))[0] for i in range(len(inputs))]).ravel()
                total = found if total is None else total + found
        return total

    return sum_over(df.select("n", *inputs), partial)


def _fit_wide(encoded: DataFrame, attributes: list[str], sizes: list[int], vector: str, width: int, alpha: float, dims: int, mapping: LabelMapping) -> Ridge:
    """Conjugate gradients, one system per vector entry, all at once; labels and their vectors stay in tables.

    A step joins the search directions to the pair counts, sums them by label and adds up a few
    vectors of the vectors' width on the driver. The preconditioner is the diagonal.
    """
    offsets = dict(zip(attributes, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist()))
    places = F.array(*[(F.col(f"{a}_idx") + offsets[a]).cast("long") for a in attributes])
    labels = _sum_by_place(encoded.select(F.explode(places).alias("place"), F.lit(1).alias("n"), F.col(vector).alias("v")))
    g = gram(encoded, vector, width)
    mean = g.sums / g.n
    pairs = design_pairs(encoded, {a: f"{a}_idx" for a in attributes}).filter("attribute_i <> attribute_j")
    at = lambda side: F.coalesce(*[F.when(F.col(f"attribute_{side}") == a, F.col(f"label_{side}").cast("long") + offsets[a]) for a in attributes])
    pairs = pairs.select(at("i").alias("i"), at("j").alias("j"), "n")
    pairs = stage(pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n")), "label-pairs")

    b = stage(_with_arrays(labels, ["v"], ["b"], lambda n, v: [v - n * mean]), "label-sums")
    weight = lambda n: 1 / (n + alpha)
    state = _with_arrays(b, ["b"], ["x", "r", "p"], lambda n, b: [np.zeros_like(b), b, b * weight(n)])
    kept, goal, center, beta = None, None, _totals(b, ["b"], lambda n, b: (n * b * weight(n)).sum(0)) / g.n, None
    for _ in range(STEPS):
        directions = state.select(F.col("place").alias("j"), "p")
        met = salted_join(pairs, directions, ["j"], "inner", "i").select(F.col("i").alias("place"), F.col("n").alias("_k"), F.col("p").alias("_p"))
        scaled = met.select("place", F.lit(0).alias("n"), F.transform("_p", lambda v: v * F.col("_k")).alias("v"))
        near = _sum_by_place(scaled).select("place", F.col("v").alias("near"))
        joined = state.join(near, "place", "left").withColumn("near", F.coalesce("near", F.transform("p", lambda v: F.lit(0.0))))
        center_now = center
        step = lambda n, x, r, p, near: [x, r, p, n * p + near - n * center_now + alpha * p]
        latest = stage(_with_arrays(joined, ["x", "r", "p", "near"], ["x", "r", "p", "q"], step), "conjugate-gradients")
        if kept is not None:
            discard(kept)  # the table of the step before
        state = kept = latest

        def dots(n, r, p, q):
            w = weight(n)
            return np.stack([(r * r * w).sum(0), (p * q).sum(0), (r * q * w).sum(0), (q * q * w).sum(0),
                             (n * r * w).sum(0), (n * q * w).sum(0), (n * p).sum(0)])

        rr, pq, rq, qq, nr, nq, np_ = _totals(state, ["r", "p", "q"], dots).reshape(7, width)
        length = np.divide(rr, pq, out=np.zeros(width), where=pq > 0)
        left = np.maximum(rr - 2 * length * rq + length**2 * qq, 0)
        beta = np.divide(left, rr, out=np.zeros(width), where=rr > 0)
        goal = rr if goal is None else goal
        center = (nr - length * nq + beta * np_) / g.n

        def move(n, x, r, p, q, length=length, beta=beta):
            r = r - length * q
            return [x + length * p, r, r * weight(n) + beta * p]

        state = _with_arrays(state, ["x", "r", "p", "q"], ["x", "r", "p"], move)
        if (left <= TOLERANCE**2 * np.maximum(goal, 1e-300)).all():
            break
    else:
        reached = np.sqrt((left / np.maximum(goal, 1e-300)).max())
        raise ArithmeticError(f"conjugate gradients reached a residual of {reached:.1e} in {STEPS} steps, {TOLERANCE:.0e} is wanted")
    solved = stage(state.select("place", "n", F.col("x").alias("w"), "r").join(b.select("place", "b"), "place"), "ridge-coefficients")

    def products(n, w, r, b):
        return np.concatenate([(n * w).sum(0), (b.T @ w).ravel(), (w.T @ (b - r - alpha * w)).ravel()])

    flat = _totals(solved, ["w", "r", "b"], products)
    shift, bw, wdw = flat[:width] / g.n, flat[width : width + width**2].reshape(width, width), flat[width + width**2 :].reshape(width, width)
    residual = g.cross - g.n * np.outer(mean, mean) - bw - bw.T + (wdw + wdw.T) / 2
    return _summary(mapping, attributes, alpha, dims, g, residual, mean - shift, None, solved.select("place", "w"))


def fit_ridge(
    df: DataFrame,
    columns: dict[str, str],
    vector: str,
    width: int,
    alpha: float = 1.0,
    n_nuisance_dims: int = 5,
    spread_by: str | None = None,
) -> Ridge:
    """Ridge with an unpenalised intercept on the one-hot labels of all attributes.

    Counts of pairs of labels give D'D; passes over the vectors give sums by label and Y'Y. From
    these come the fit, the residual crossproduct and its eigenvectors.
    """
    attributes = list(columns)
    rows = df.filter(vectors.valid(F.col(vector), width))
    mapping = fit_labels(rows, columns)
    sizes = [mapping.sizes[a] for a in attributes]
    encoded = mapping.transform(rows, columns, spread_by=spread_by)
    if sum(sizes) == 0:
        raise ValueError("no valid vectors")
    fit = _fit_wide if sum(sizes) - max(sizes) > DENSE_REST else _fit_by_elimination
    return fit(encoded, attributes, sizes, vector, width, alpha, n_nuisance_dims, mapping)


def _fit_by_elimination(encoded: DataFrame, attributes: list[str], sizes: list[int], vector: str, width: int, alpha: float, dims: int, mapping: LabelMapping) -> Ridge:
    """Eliminate the largest attribute, solve for the others and the intercept, and put them back.

    A task holds matrices as wide as the labels of the other attributes, and a block of
    labels of the largest.
    """
    spark, idx = encoded.sparkSession, [f"{a}_idx" for a in attributes]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist()
    big = int(np.argmax(sizes))
    rest = [i for i in range(len(attributes)) if i != big]
    q = sum(sizes[i] for i in rest)
    starts = dict(zip(rest, np.concatenate([[0], np.cumsum([sizes[i] for i in rest])]).astype(int).tolist()))

    keys = stage(encoded.groupBy(*idx).agg(F.count("*").alias("n")), "design-keys")  # one row per distinct key
    places = F.array(*[(F.col(c) + o).cast("long") for c, o in zip(idx, offsets)])
    sums = stage(_sum_by_place(encoded.select(F.explode(places).alias("place"), F.lit(1).alias("n"), F.col(vector).alias("v"))), "label-sums")
    g = gram(encoded, vector, width)
    mean = g.sums / g.n

    def rest_pairs(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        """Pair counts of the other attributes and the intercept, which comes last."""
        total = None
        for batch in batches:
            n = batch.column(len(rest)).to_numpy()
            at = [batch.column(j).to_numpy() + starts[i] for j, i in enumerate(rest)] + [np.full(len(n), q)]
            total = np.zeros((q + 1, q + 1)) if total is None else total
            for one in at:
                for other in at:
                    np.add.at(total, (one, other), n)
        return None if total is None else total.ravel()

    inner = sum_over(keys.select(*[idx[i] for i in rest], "n"), rest_pairs).reshape(q + 1, q + 1)

    # The large attribute's labels, each with its count, its sum and its counts with the other labels.
    met = [keys.groupBy(F.col(idx[big]).alias("e"), (F.col(idx[i]) + starts[i]).alias("at")).agg(F.sum("n").alias("n")) for i in rest]
    here = (F.col("place") >= offsets[big]) & (F.col("place") < offsets[big] + sizes[big])
    large = sums.filter(here).select("place", "n", "v")
    if met:
        lists = reduce(DataFrame.unionByName, met).groupBy((F.col("e") + offsets[big]).cast("long").alias("place"))
        lists = lists.agg(F.array_agg(F.struct("at", "n")).alias("near"))  # at most DENSE_REST entries
        large = large.join(lists, "place").select("place", "n", "v", F.col("near.at").alias("at"), F.col("near.n").alias("k"))
    else:
        large = large.select("place", "n", "v", F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("k"))
    large = stage(large, "large-labels")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Places, counts with the other labels and the intercept as a dense block, centred sums, weights."""
        for whole in batches:
            for first in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(first, BLOCK_ROWS)
                n = batch.column(1).to_numpy().astype(float)
                block = np.zeros((len(n), q + 1))
                block[:, q] = n
                sizes = [len(x) for x in batch.column(3)]
                block[np.repeat(np.arange(len(n)), sizes), batch.column(3).flatten().to_numpy()] = batch.column(4).flatten().to_numpy()
                v = matrix(batch.column(2))[0]
                yield batch.column(0), block, v - n[:, None] * mean, 1 / (n + alpha)

    def eliminated(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        square, right, found = np.zeros((q + 1, q + 1)), np.zeros((q + 1, width)), False
        for _, block, v, weight in blocks(batches):
            scaled, found = block * weight[:, None], True
            square += block.T @ scaled
            right += scaled.T @ v
        return np.concatenate([square.ravel(), right.ravel()]) if found else None

    flat = sum_over(large, eliminated)
    square, right = flat[: (q + 1) ** 2].reshape(q + 1, q + 1), flat[(q + 1) ** 2 :].reshape(q + 1, width)
    known = np.zeros((q + 1, width))  # centred sums of the other labels; that of all rows is zero
    stack = {offsets[i] + j: starts[i] + j for i in rest for j in range(sizes[i])}
    for r in sums.filter(~here).collect():  # at most DENSE_REST rows
        known[stack[r["place"]]] = np.array(r["v"]) - r["n"] * mean
    penalty = np.append(np.full(q, alpha), 0.0)
    solved = np.linalg.solve(inner + np.diag(penalty) - square, known - right)

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, block, v, weight in blocks(batches):
            w, every = (v - block @ solved) * weight[:, None], np.ones(len(v), bool)
            yield pa.RecordBatch.from_arrays([place, list_array(w, every, pa.float64()), list_array(v, every, pa.float64())], names=["place", "w", "v"])

    found = stage(large.mapInArrow(put_back, "place long, w array<double>, v array<double>"), "large-coefficients")

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if len(batch):
                w, v = matrix(batch.column(0))[0], matrix(batch.column(1))[0]
                more = v.T @ w + alpha * w.T @ w
                total = more if total is None else total + more
        return None if total is None else total.ravel()

    # With the normal equations, what the fit takes away is the sums times the coefficients, and the penalty.
    taken = sum_over(found.select("w", "v"), products).reshape(width, width) + known.T @ solved + alpha * solved[:q].T @ solved[:q]
    residual = g.cross - g.n * np.outer(mean, mean) - (taken + taken.T) / 2
    rows = [(p, solved[at].tolist()) for p, at in stack.items()]
    table = found.select("place", "w").union(spark.createDataFrame(rows, "place long, w array<double>"))
    coefficients = None
    if sum(sizes) * width * 8 <= SMALL_BYTES:
        coefficients, table = np.zeros((sum(sizes), width)), table.toArrow()
        coefficients[table.column(0).to_numpy()] = matrix(table.column(1))[0]
        table = None
    return _summary(mapping, attributes, alpha, dims, g, residual, solved[q] + mean, coefficients, table)


def _summary(mapping, attributes, alpha, dims, g: Gram, residual: np.ndarray, intercept, w, table=None) -> Ridge:
    n, spec, total = g.n, spectrum(residual, dims), np.trace(residual)
    y_grand = g.sums.sum() / (n * len(g.sums))
    y_var = np.trace(g.cross) / (n * len(g.sums)) - y_grand**2
    return Ridge(
        mapping, attributes, alpha, intercept, w, spec, spec.values**2 / total, n,
        float(np.sqrt(total)), float(np.sqrt(np.trace(g.cross))), float(total / (n * len(g.sums)) / y_var), table,
    )
