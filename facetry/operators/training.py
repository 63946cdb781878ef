"""Distributed training of the attribute network.

The training rows are written once. Each epoch deals them anew to a fixed number of shards and
orders them there, by a seeded hash of item and epoch: a permutation of all rows that
does not depend on files or partitions. Every shard starts from the same weights and walks its
rows in minibatches, cut from the stream of rows whatever batches it arrives in; then the weights
and optimiser moments are averaged by rows (``sync="weights"``), or all rows give one
summed gradient and one step (``sync="gradient"``).

With a state folder every epoch ends with a written state, and a run that was ended goes on
from the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import vectors
from facetry.operators.arrow import matrix
from facetry.operators.blocks import sum_over
from facetry.operators.lookup import salted_join
from facetry.operators.network import Network
from facetry.session import discard, stage

# Optimiser defaults.
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8
SHARDS = 8
#: Rows whose gradients are summed at once, where no step is taken in between.
TOGETHER = 1024


def training_rows(
    items: DataFrame, negatives: DataFrame, label_cols: list[str], item_id: str = "item_id", vector: str = "embedding",
    mask: int | None = None,
) -> DataFrame:
    """``(item_id, labels.., cells)``: the item's vector and those of its negatives in slot order.

    ``mask`` cuts the vectors before they are gathered. Items whose own vector is invalid or all zero are left out. Slots meet vectors by
    item id; an item that is a negative of very many others is salted.
    """
    known = items.select(F.col(item_id).alias("neg_id"), (vectors.trim(F.col(vector), mask) if mask else F.col(vector)).alias("_v"))
    slots = salted_join(negatives.filter(F.col("neg_id").isNotNull()), known, ["neg_id"], "inner", item_id)
    # One entry per slot, ten by default.
    grouped = slots.groupBy(item_id).agg(F.array_sort(F.collect_list(F.struct("pos", "_v"))).alias("_slots"))
    cells = F.transform("_slots", lambda s: s["_v"])
    labelled = items.filter(vectors.nonzero(F.col(vector))).select(item_id, *label_cols)
    return stage(labelled.join(grouped.select(item_id, cells.alias("cells")), item_id), "training-rows")


@dataclass(frozen=True)
class Layout:
    """How the columns of a shard's batches are read."""

    attributes: list[str]
    slots: int
    width: int

    def batches(self, stream: Iterator[pa.RecordBatch], size: int, mask: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        """Cells cut to ``mask`` and labels of ``size`` rows at a time, the last time of those left.

        No more than ``TOGETHER`` rows are widened at once, however many a batch of the stream has.
        """
        held = None
        for part in (batch.slice(at, TOGETHER) for batch in stream for at in range(0, batch.num_rows, TOGETHER)):
            cells = matrix(part.column(0))[0].reshape(-1, self.slots, self.width)[:, :, :mask]
            rows = [cells, *[part.column(i + 1).to_numpy() for i in range(len(self.attributes))]]
            held = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows)]
            whole = len(held[0]) // size * size
            for at in range(0, whole, size):
                yield self._named([x[at : at + size] for x in held])
            held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield self._named(held)

    def _named(self, rows: list[np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return np.ascontiguousarray(rows[0]), dict(zip(self.attributes, rows[1:]))


@dataclass
class Shards:
    """Rows written for repeated passes; networks with masks up to the layout's width train on them."""

    table: DataFrame
    layout: Layout
    shards: int

    def permuted(self, seed: int, epoch: int) -> DataFrame:
        """The rows of an epoch, dealt and ordered by a hash; a partition is a shard."""
        draw = F.xxhash64(F.lit(f"{seed}:{epoch}"), "_item")
        dealt = self.table.withColumn("_draw", draw).repartitionById(self.shards, F.pmod("_draw", F.lit(self.shards)).cast("int"))
        return dealt.sortWithinPartitions("_draw", "_item").select(*self.columns())

    def rows(self) -> DataFrame:
        return self.table.select(*self.columns())

    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c != "_item"]

    def unpersist(self) -> None:
        """Delete the written rows."""
        discard(self.table)


def place(rows: DataFrame, attributes: list[str], mask: int, slots: int, item_id: str = "item_id",
          shards: int = SHARDS, label_suffix: str = "_idx") -> Shards:
    """Write the rows, cut to the widest mask that will be asked for.

    With ``sync="weights"`` the number of shards is the degree of averaging. So it is a
    parameter of the training, whatever the table and the cluster; large tables ask for more.
    """
    flat = F.flatten(F.transform("cells", lambda v: vectors.trim(v, mask))).alias("cells")
    labels = [F.col(f"{a}{label_suffix}").alias(f"_{a}") for a in attributes]
    return Shards(stage(rows.select(flat, *labels, F.col(item_id).alias("_item")), "placed-rows"), Layout(attributes, slots, mask), shards)


@dataclass
class AdamW:
    """Weights, moments and step count; decay acts on the weights directly."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def start(cls, network: Network) -> AdamW:
        flat = network.flat()
        return cls(flat, np.zeros_like(flat), np.zeros_like(flat))

    def step(self, gradient: np.ndarray, rate: float, decay: float) -> None:
        self.steps += 1
        self.weights = self.weights * (1 - rate * decay)
        self.first = BETA_1 * self.first + (1 - BETA_1) * gradient
        self.second = BETA_2 * self.second + (1 - BETA_2) * gradient**2
        mean = self.first / (1 - BETA_1**self.steps)
        scale = np.sqrt(self.second / (1 - BETA_2**self.steps)) + EPSILON
        self.weights = self.weights - rate * mean / scale


def loss_names(attributes: list[str]) -> list[str]:
    return ["rows", "total", "contrastive", *[f"{a}_{k}" for a in attributes for k in ("loss", "correct")]]


def _means(names: list[str], sums: np.ndarray) -> dict[str, float]:
    found = dict(zip(names, sums.tolist()))
    rows = found.pop("rows")
    n = max(rows, 1.0)
    return {"rows": rows} | {("acc".join(k.rsplit("correct", 1)) if k.endswith("_correct") else k): v / n for k, v in found.items()}


def evaluate(shards: Shards, network: Network) -> dict[str, float]:
    """Row means of the losses and accuracies, dropout off."""
    layout, names = shards.layout, loss_names(shards.layout.attributes)
    shared = shards.table.sparkSession.sparkContext.broadcast(network)

    def partial(stream: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        network, total, seen = shared.value, np.zeros(len(names)), False
        for cells, labels in layout.batches(stream, TOGETHER, network.shape["mask_size"]):
            sums, _ = network.losses(cells, labels, slopes=False)
            total, seen = total + [sums[k] for k in names], True
        return total if seen else None

    sums = sum_over(shards.rows(), partial)
    shared.unpersist()
    return _means(names, sums if sums is not None else np.zeros(len(names)))


def train_epoch(shards: Shards, network: Network, state: AdamW, rate: float, decay: float, batch_size: int,
                epoch: int, seed: int, sync: str = "weights", dropout: bool = True) -> tuple[AdamW, dict[str, float]]:
    """One pass over all rows; the new optimiser state and the row means of the losses."""
    layout, names = shards.layout, loss_names(shards.layout.attributes)
    size = len(state.weights)

    shared = shards.table.sparkSession.sparkContext.broadcast((network, state))  # once per executor, not per task

    def local_steps(stream: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        network, state = shared.value
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        own = AdamW(state.weights, state.first, state.second, state.steps)
        total = np.zeros(len(names))
        for cells, labels in layout.batches(stream, batch_size, network.shape["mask_size"]):
            sums, grad = network.with_flat(own.weights).losses(cells, labels, rng if dropout else None)
            own.step(grad / len(cells), rate, decay)
            total += [sums[k] for k in names]
        n = total[0]
        if not n:
            return None
        return np.concatenate([total, [n * own.steps], n * own.weights, n * own.first, n * own.second])

    def whole_gradient(stream: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        network, _ = shared.value
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        total, gradient = np.zeros(len(names)), np.zeros(size)
        for cells, labels in layout.batches(stream, TOGETHER, network.shape["mask_size"]):
            sums, grad = network.losses(cells, labels, rng if dropout else None)
            total, gradient = total + [sums[k] for k in names], gradient + grad
        return np.concatenate([total, gradient]) if total[0] else None

    if sync not in ("weights", "gradient"):
        raise ValueError(f"unknown sync {sync!r}")
    flat = sum_over(shards.permuted(seed, epoch), local_steps if sync == "weights" else whole_gradient, merge_splits=False)
    shared.unpersist()
    if flat is None:
        raise ValueError("no training rows")
    losses, rest = flat[: len(names)], flat[len(names) :]
    if sync == "gradient":
        new = AdamW(state.weights, state.first, state.second, state.steps)
        new.step(rest / losses[0], rate, decay)
    else:
        rest = rest / losses[0]
        new = AdamW(rest[1 : 1 + size], rest[1 + size : 1 + 2 * size], rest[1 + 2 * size :], max(int(round(rest[0])), 1))
    return new, _means(names, losses)


class Plateau:
    """Cuts the learning rate when the loss has not improved for more than ``patience`` epochs."""

    def __init__(self, rate: float, factor: float, patience: int, floor: float, threshold: float = 1e-4):
        self.rate, self.factor, self.patience, self.floor, self.threshold = rate, factor, patience, floor, threshold
        self.best, self.bad = float("inf"), 0

    def update(self, loss: float) -> None:
        if loss < self.best * (1 - self.threshold):
            self.best, self.bad = loss, 0
            return
        self.bad += 1
        if self.bad > self.patience:
            self.rate, self.bad = max(self.rate * self.factor, self.floor), 0


class States:
    """The state after each epoch as a small table ``folder/epoch-N``; the last two are kept.

    A state counts once its table is complete, so a run that ends while writing goes on from the one before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        where = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, epoch: int, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epoch-{epoch:06}{name}")

    def write(self, epoch: int, record: dict, arrays: dict[str, np.ndarray]) -> None:
        rows = [("record", json.dumps(record), None), *[(k, None, v.tolist()) for k, v in arrays.items()]]
        frame = self.spark.createDataFrame(rows, "name string, record string, numbers array<double>").coalesce(1)
        frame.write.mode("overwrite").parquet(self._path(epoch).toString())
        if epoch > 1:
            self.files.delete(self._path(epoch - 2), True)

    def last(self) -> tuple[dict, dict[str, np.ndarray]] | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not self.files.exists(where):
            return None
        epochs = [int(f.getPath().getName().split("-")[1]) for f in self.files.listStatus(where)]
        done = [e for e in epochs if self.files.exists(self._path(e, "/_SUCCESS"))]
        if not done:
            return None
        rows = {r["name"]: r for r in self.spark.read.parquet(self._path(max(done)).toString()).collect()}  # one model
        return json.loads(rows.pop("record")["record"]), {k: np.array(r["numbers"]) for k, r in rows.items()}


def train_network(
    train: DataFrame | Shards,
    validation: DataFrame | Shards,
    network: Network,
    epochs: int = 100,
    learning_rate: float = 0.001,
    weight_decay: float = 0.01,
    batch_size: int = 8,
    early_stopping_patience: int = 10,
    lr_reduce_patience: int = 2,
    lr_reduce_factor: float = 0.9,
    min_lr: float = 1e-6,
    start_from_epoch: int = 3,
    seed: int = 42,
    sync: str = "weights",
    shards: int = SHARDS,
    item_id: str = "item_id",
    on_improvement=None,
    state_path: str | None = None,
) -> tuple[Network, list[dict]]:
    """Train with early stopping; the best weights are returned with the history.

    The best weights are tracked from the first epoch, patience counts from
    ``start_from_epoch``. ``on_improvement(network)`` runs whenever counted epochs improve.
    Rows may have been placed before. With ``state_path`` the run continues from the last
    state written there, as if it had not been ended; a state of a training with other settings
    is an error. ``epochs`` may be raised from run to run.
    """
    shape = network.shape
    args = (shape["attribute_names"], shape["mask_size"], shape["mini_batch_size"], item_id, shards)
    placed, held_out = (r if isinstance(r, Shards) else place(r, *args) for r in (train, validation))
    spark = placed.table.sparkSession
    settings = [shape, learning_rate, weight_decay, batch_size, early_stopping_patience, lr_reduce_patience, lr_reduce_factor,
                min_lr, start_from_epoch, seed, sync, placed.shards]
    settings = json.loads(json.dumps(settings))
    state, schedule = AdamW.start(network), Plateau(learning_rate, lr_reduce_factor, lr_reduce_patience, min_lr)
    best, best_loss, waited, history = network, float("inf"), 0, []
    states = States(spark, state_path) if state_path else None
    known = states.last() if states else None
    if known:
        record, arrays = known
        if record["settings"] != settings:
            raise ValueError(f"{state_path} has the state of another training")
        state = AdamW(arrays["weights"], arrays["first"], arrays["second"], record["steps"])
        network, best = network.with_flat(state.weights), network.with_flat(arrays["best"])
        best_loss, waited, history = record["best_loss"], record["waited"], record["history"]
        schedule.rate, schedule.best, schedule.bad = record["schedule"]
    try:
        for epoch in range(len(history), epochs):
            if waited >= early_stopping_patience and epoch > start_from_epoch:
                break
            state, fitted = train_epoch(placed, network, state, schedule.rate, weight_decay, batch_size, epoch, seed, sync)
            network = network.with_flat(state.weights)
            seen = evaluate(held_out, network)
            if not seen["rows"]:
                raise ValueError("no validation rows")
            history.append({"epoch": epoch, "train_loss": fitted["total"], "val_loss": seen["total"], "learning_rate": schedule.rate}
                           | {f"val_{a}_acc": seen[f"{a}_acc"] for a in shape["attribute_names"]})
            schedule.update(seen["total"])
            improved = seen["total"] < best_loss
            if improved:
                best, best_loss = network, seen["total"]
            if epoch >= start_from_epoch:
                waited = 0 if improved else waited + 1
                if improved and on_improvement:
                    on_improvement(network)
            if states:
                record = {"settings": settings, "steps": state.steps, "best_loss": best_loss, "waited": waited, "history": history,
                          "schedule": [schedule.rate, schedule.best, schedule.bad]}
                states.write(epoch, record, {"weights": state.weights, "first": state.first, "second": state.second, "best": best.flat()})
    finally:
        for rows, given in ((placed, train), (held_out, validation)):
            if rows is not given:
                rows.unpersist()
    return best, history


def history_frame(spark: SparkSession, history: list[dict]) -> DataFrame:
    """One row per epoch."""
    fields = [f"{k} {'int' if k == 'epoch' else 'double'}" for k in history[0]]
    return spark.createDataFrame([tuple(h.values()) for h in history], ", ".join(fields))
