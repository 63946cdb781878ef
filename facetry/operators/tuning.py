"""Search over the network's hyperparameters by successive halving; each trial trains distributed.

All random trials train for a few epochs, the best third of them for three times as many, and so
on until one is left to train to the end. Trials share the rows, which are written once,
and keep their state in tables: a trial that goes on does so from its last epoch, and a
search that was ended too.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.network import Network, network_shape
from facetry.operators.training import SHARDS, place, train_network
from facetry.session import scratch_path

# The search space.
PROJECTION_UNITS = range(64, 129, 8)
UNITS_PER_ATTRIBUTE = range(4, 17, 2)
MASK_SIZES = [128, 256, 512, 1024, 2048, 3072]
LEARNING_RATE = (1e-4, 1e-2)
WEIGHT_DECAY = (1e-4, 1e-1)


def mask_choices(orig_size: int, fixed_mask_size: int | None = None) -> list[int]:
    if fixed_mask_size is not None:
        return [fixed_mask_size]
    return sorted({s for s in MASK_SIZES if s <= orig_size} | {orig_size})


def draw_trials(n_trials: int, orig_size: int, fixed_mask_size: int | None = None, seed: int = 42) -> list[dict]:
    rng = np.random.default_rng(seed)
    masks = mask_choices(orig_size, fixed_mask_size)
    return [{
        "projection_units": int(rng.choice(PROJECTION_UNITS)),
        "embedding_units_per_attribute": int(rng.choice(UNITS_PER_ATTRIBUTE)),
        "mask_size": int(rng.choice(masks)),
        "learning_rate": float(np.exp(rng.uniform(*np.log(LEARNING_RATE)))),
        "weight_decay": float(np.exp(rng.uniform(*np.log(WEIGHT_DECAY)))),
    } for _ in range(n_trials)]


def rungs(n_trials: int, epochs: int, eta: int | None) -> list[tuple[int, int]]:
    """(trials, epochs) of each rung: all trials first, the best of ``eta`` next, one to the end. Without ``eta`` all go to the end."""
    if not eta or eta < 2:
        return [(n_trials, epochs)]
    out, size, steps = [], n_trials, 0
    while size > 1:
        size, steps = size // eta, steps + 1
    for i in range(steps + 1):
        rung = (max(n_trials // eta**i, 1), max(-(-epochs // eta ** (steps - i)), 1))
        if not out or rung[1] > out[-1][1]:
            out.append(rung)
    return out


def tune(
    train: DataFrame,
    validation: DataFrame,
    attribute_sizes: dict[str, int],
    orig_size: int,
    mini_batch_size: int = 10,
    n_trials: int = 75,
    epochs_per_trial: int = 50,
    batch_size: int = 8,
    seed: int = 42,
    fixed_mask_size: int | None = None,
    parallel_trials: int = 1,
    shape_changes: dict | None = None,
    eta: int | None = 3,
    shards: int = SHARDS,
    item_id: str = "item_id",
    state_path: str | None = None,
    **training,
) -> tuple[dict, DataFrame]:
    """Best parameters and the table of trials ``(trial, val_loss, epochs, params)``.

    ``eta`` is the share that goes on from rung to rung, one of ``eta``; with None every trial
    trains to the end. ``parallel_trials`` lets several submit their jobs to the cluster at
    once. With ``state_path`` a search that was ended continues.
    """
    spark, trials = train.sparkSession, draw_trials(n_trials, orig_size, fixed_mask_size, seed)
    root = state_path or scratch_path(spark, "trials")
    args = (list(attribute_sizes), max(mask_choices(orig_size, fixed_mask_size)), mini_batch_size, item_id, shards)
    placed = [place(rows, *args) for rows in (train, validation)]

    def run(number: int, epochs: int) -> tuple[float, int]:
        params = dict(trials[number])
        optimiser = {k: params.pop(k) for k in ("learning_rate", "weight_decay")}
        shape = network_shape(attribute_sizes, orig_size, **((shape_changes or {}) | params | {"mini_batch_size": mini_batch_size}))
        _, history = train_network(*placed, Network.initial(shape, seed), epochs=epochs, batch_size=batch_size, seed=seed,
                                   state_path=f"{root}/trial-{number:05}", **optimiser, **training)
        return min(h["val_loss"] for h in history), len(history)

    found: dict[int, tuple[float, int]] = {}
    left = list(range(n_trials))
    try:
        for size, epochs in rungs(n_trials, epochs_per_trial, eta):
            left = sorted(left, key=lambda t: (found.get(t, (0.0,))[0], t))[:size]
            with ThreadPoolExecutor(parallel_trials) as pool:
                found |= zip(left, pool.map(inheritable_thread_target(spark)(lambda t: run(t, epochs)), left))
    finally:
        for rows in placed:
            rows.unpersist()
    rows = [(t, *found[t], json.dumps(trials[t])) for t in range(n_trials)]
    table = spark.createDataFrame(rows, "trial int, val_loss double, epochs int, params string")
    return best_trial(table), table


def best_trial(trials: DataFrame) -> dict:
    """Parameters of the trial with the lowest validation loss."""
    return json.loads(trials.agg(F.min_by("params", "val_loss")).first()[0])
