"""The attribute network: numpy kernels for one batch, and scoring of a table.

trim -> linear -> GELU -> dropout -> linear -> GELU -> dropout -> one block per
attribute -> a linear classifier per block. The contrastive term compares the blocks of
an item with those of its negatives.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions import vectors
from facetry.functions.hashing import DIGITS, SPAN
from facetry.operators.arrow import list_array, matrix

# Default hyperparameters.
DEFAULT_SHAPE = {
    "mini_batch_size": 10,
    "projection_units": 128,
    "embedding_units_per_attribute": 8,
    "mask_size": 2048,
    "dropout_rate": 0.125,
    "contrastive_temperature": 0.1,
    "contrastive_weight": 0.1,
}


@cache
def _erf_table(limit: float = 6.0, steps: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, float]:
    x = np.linspace(-limit, limit, steps + 1)
    return np.array([math.erf(v) for v in x]), 2 / math.sqrt(math.pi) * np.exp(-x * x), x[1] - x[0]


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by cubic Hermite interpolation of a table; exact to about 1e-15."""
    values, slopes, h = _erf_table()
    at = np.clip((x + 6.0) / h, 0, len(values) - 1.000001)
    i = at.astype(np.int64)
    t = at - i
    a, b, c, d = values[i], values[i + 1], h * slopes[i], h * slopes[i + 1]
    return a + t * (c + t * (3 * (b - a) - 2 * c - d + t * (2 * (a - b) + c + d)))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def network_shape(attribute_sizes: dict[str, int], orig_size: int, **changes) -> dict:
    """Hyperparameters; the mask never exceeds the vectors."""
    shape = {"attribute_names": list(attribute_sizes), "attribute_sizes": dict(attribute_sizes), "orig_size": orig_size}
    shape |= DEFAULT_SHAPE | {k: v for k, v in changes.items() if v is not None}
    shape["mask_size"] = min(shape["mask_size"], orig_size)
    return shape


def layer_dims(shape: dict) -> dict[str, tuple[int, int]]:
    units, names = shape["embedding_units_per_attribute"], shape["attribute_names"]
    dims = {"projection": (shape["mask_size"], shape["projection_units"]),
            "reduction": (shape["projection_units"], units * len(names))}
    return dims | {f"classifier.{a}": (units, shape["attribute_sizes"][a]) for a in names}


def initial_weight(seed: int, layer: str, row: int, column: int) -> float:
    """Between -1 and 1, from an md5, so the same in any language. Row -1 is the bias."""
    digest = hashlib.md5(f"{seed}:{layer}:{row}:{column}".encode()).hexdigest()
    return 2 * int(digest[:DIGITS], 16) / SPAN - 1


class Network:
    """Hyperparameters and weights. They travel as a broadcast variable, once per executor."""

    def __init__(self, shape: dict, weights: dict[str, np.ndarray]):
        self.shape, self.weights = shape, weights

    @classmethod
    def initial(cls, shape: dict, seed: int = 42) -> Network:
        """Uniform weights within 1 / sqrt(inputs)."""
        weights = {}
        for layer, (rows, columns) in layer_dims(shape).items():
            drawn = [[initial_weight(seed, layer, i, j) for j in range(columns)] for i in range(-1, rows)]
            scaled = np.array(drawn) / math.sqrt(rows)
            weights[f"{layer}.bias"], weights[f"{layer}.weight"] = scaled[0], scaled[1:]
        return cls(shape, weights)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return Network(self.shape, out)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """``(layer, row, values)``, one row per matrix row."""
        rows = [(name, i, r.tolist()) for name, w in self.weights.items() for i, r in enumerate(np.atleast_2d(w))]
        return spark.createDataFrame(rows, "layer string, row int, values array<double>")

    @classmethod
    def from_rows(cls, shape: dict, rows: list) -> Network:
        found = {}
        for r in sorted(rows, key=lambda r: (r["layer"], r["row"])):
            found.setdefault(r["layer"], []).append(r["values"])
        weights = {}
        for layer in layer_dims(shape):
            weights[f"{layer}.bias"] = np.array(found[f"{layer}.bias"][0])
            weights[f"{layer}.weight"] = np.array(found[f"{layer}.weight"])
        return cls(shape, weights)

    # -- batch kernels ---------------------------------------------------------

    def encode(self, x: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Both hidden layers for rows ``x``; dropout only with ``rng``."""
        w, rate = self.weights, self.shape["dropout_rate"]

        def keep(shape):
            if rng is None or rate == 0:
                return 1.0
            return (rng.random(shape) >= rate) / (1 - rate)

        z1 = x @ w["projection.weight"] + w["projection.bias"]
        k1 = keep(z1.shape)
        h1 = gelu(z1) * k1
        z2 = h1 @ w["reduction.weight"] + w["reduction.bias"]
        k2 = keep(z2.shape)
        return {"z1": z1, "k1": k1, "h1": h1, "z2": z2, "k2": k2, "out": gelu(z2) * k2}

    def representations(self, x: np.ndarray) -> dict[str, np.ndarray]:
        parts = np.split(self.encode(x)["out"], len(self.shape["attribute_names"]), axis=-1)
        return dict(zip(self.shape["attribute_names"], parts))

    def logits(self, representations: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        w = self.weights
        return {a: r @ w[f"classifier.{a}.weight"] + w[f"classifier.{a}.bias"] for a, r in representations.items()}

    def losses(self, cells: np.ndarray, labels: dict[str, np.ndarray], rng=None, slopes: bool = True):
        """Summed losses of a batch and, with ``slopes``, the summed gradient.

        ``cells`` is (rows, 1 + negatives, mask). Returns ``({loss or count: sum}, gradient)``.
        """
        w, shape = self.weights, self.shape
        n, slots, mask = cells.shape
        x = cells.reshape(n * slots, mask)
        enc = self.encode(x, rng)
        names, tau, weight = shape["attribute_names"], shape["contrastive_temperature"], shape["contrastive_weight"]
        out = enc["out"].reshape(n, slots, len(names), -1)
        d_out = np.zeros_like(out)
        grad, sums = {}, {"rows": float(n), "contrastive": 0.0}
        for i, a in enumerate(names):
            block = out[:, :, i]
            logits = block[:, 0] @ w[f"classifier.{a}.weight"] + w[f"classifier.{a}.bias"]
            top = logits.max(axis=1, keepdims=True)
            exps = np.exp(logits - top)
            total = exps.sum(axis=1)
            truth = labels[a]
            sums[f"{a}_loss"] = float((np.log(total) + top[:, 0] - logits[np.arange(n), truth]).sum())
            sums[f"{a}_correct"] = float((logits.argmax(axis=1) == truth).sum())

            norms = np.maximum(np.linalg.norm(block, axis=2, keepdims=True), 1e-12)
            unit = block / norms
            scaled = np.einsum("nu,nju->nj", unit[:, 0], unit[:, 1:]) / tau
            peak = np.maximum(scaled.max(axis=1, initial=0.0), 0.0)[:, None]
            shares = np.exp(scaled - peak)
            denominator = np.exp(-peak) + shares.sum(axis=1, keepdims=True)
            sums["contrastive"] += float((np.log(denominator) + peak).sum())
            if not slopes:
                continue
            d_logits = exps / total[:, None]
            d_logits[np.arange(n), truth] -= 1
            grad[f"classifier.{a}.weight"] = block[:, 0].T @ d_logits
            grad[f"classifier.{a}.bias"] = d_logits.sum(axis=0)
            d_out[:, 0, i] += d_logits @ w[f"classifier.{a}.weight"].T
            pull = shares / denominator * (weight / tau)
            d_unit = np.empty_like(unit)
            d_unit[:, 0] = np.einsum("nj,nju->nu", pull, unit[:, 1:])
            d_unit[:, 1:] = pull[:, :, None] * unit[:, :1]
            d_out[:, :, i] += (d_unit - unit * (unit * d_unit).sum(axis=2, keepdims=True)) / norms
        sums["total"] = sum(sums[f"{a}_loss"] for a in names) + weight * sums["contrastive"]
        if not slopes:
            return sums, None
        d_z2 = d_out.reshape(n * slots, -1) * enc["k2"] * gelu_slope(enc["z2"])
        grad["reduction.weight"], grad["reduction.bias"] = enc["h1"].T @ d_z2, d_z2.sum(axis=0)
        d_z1 = (d_z2 @ w["reduction.weight"].T) * enc["k1"] * gelu_slope(enc["z1"])
        grad["projection.weight"], grad["projection.bias"] = x.T @ d_z1, d_z1.sum(axis=0)
        return sums, np.concatenate([grad[name].ravel() for name in w])


def score(
    df: DataFrame, network: Network, vector: str = "embedding", keep: list[str] | None = None, with_logits: bool = False
) -> DataFrame:
    """Columns ``keep`` plus one representation per attribute, as ``array<double>``.

    ``with_logits`` adds ``<attribute>_logits``. Rows without a valid vector get nulls.
    The vector is cut to the mask before it leaves the JVM. Stateless per row, so it
    runs on a stream as well.
    """
    names, mask = network.shape["attribute_names"], network.shape["mask_size"]
    keep = [c for c in df.columns if c != vector] if keep is None else keep
    ok = vectors.valid(F.col(vector)) & (F.size(vector) >= mask)
    rows = df.select(*keep, F.when(ok, vectors.trim(F.col(vector), mask)).alias("_v"))
    added = names + ([f"{a}_logits" for a in names] if with_logits else [])
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in added]])

    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            x, present = matrix(batch.column(len(keep)))
            found = network.representations(x.reshape(-1, mask))
            if with_logits:
                found |= {f"{a}_logits": v for a, v in network.logits(found).items()}
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [list_array(found[n], present, pa.float64()) for n in added]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return rows.mapInArrow(run, schema)
