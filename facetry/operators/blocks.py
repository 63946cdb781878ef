"""Sums of matrices over a table: partials per task, added up in two steps.

A task emits its partial matrix as row blocks. Blocks meet by number only, so no task
and not the driver ever holds more than one partial matrix plus a few blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1024 * 1024
FAN_IN = 64
SCHEMA = "part long, block int, data binary"


def _batch(part: int, block: int, data: bytes) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "data"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum equal (part, block) entries of a task."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, block, data in zip(*(column.to_pylist() for column in batch.columns)):
            found = totals.get((part, block))
            totals[part, block] = np.frombuffer(data) + (0 if found is None else found)
    for (part, block), total in totals.items():
        yield _batch(part, block, total.tobytes())


def sum_over(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], merge_splits: bool = True) -> np.ndarray | None:
    """Add up ``partial(batches)``, a flat float64 array per task, and fetch the sum.

    ``partial`` returns None for a task without rows. The result has the size of one
    partial, whatever the number of rows. Merging input splits down to a few per core
    keeps the number of partials in line with the cluster and moves no rows.
    """
    limit = 2 * df.sparkSession.sparkContext.defaultParallelism
    if merge_splits:
        df = df.coalesce(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = partial(batches)
        part, step = TaskContext.get().partitionId(), BLOCK_BYTES // 8
        for at in range(0, 0 if flat is None else len(flat), step):
            yield _batch(part // FAN_IN, at // step, np.ascontiguousarray(flat[at : at + step], dtype=np.float64).tobytes())

    partials = df.mapInArrow(run, SCHEMA)
    if limit > FAN_IN or not merge_splits:
        partials = partials.repartition("part", "block").mapInArrow(_add, SCHEMA)
    rows = partials.withColumn("part", F.lit(0).cast("long")).repartition("block").mapInArrow(_add, SCHEMA).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["data"]) for r in sorted(rows, key=lambda r: r["block"])])
