"""The triangular factor of a tall matrix whose rows are a table.

Each task reduces its rows to a triangle, batch by batch; triangles are stacked and reduced
again in groups until one is left. Unlike sums of products, the triangle has the
condition of the matrix, not its square.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.arrow import matrix
from facetry.session import stage

FAN_IN = 32
SCHEMA = "part long, n long, data binary"


def reduced(rows: np.ndarray) -> np.ndarray:
    """The triangular factor; as many rows as there are, up to the number of columns."""
    return np.linalg.qr(rows, mode="r")


def _row(part: int, n: int, triangle: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([triangle.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "data"])


def triangle(df: DataFrame, vector: Column, width: int) -> tuple[int, np.ndarray]:
    """Rows and triangular factor of a vector column; null rows are skipped.

    A task holds one triangle and one batch, or a group of FAN_IN triangles.
    """

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros((0, width))
        for batch in batches:
            rows, _ = matrix(batch.column(0))
            if len(rows):
                n, found = n + len(rows), reduced(np.concatenate([found, rows]))
        if n:
            yield _row(TaskContext.get().partitionId(), n, found)

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                groups[r["part"] // FAN_IN].append(r)
        for group, rows in groups.items():
            rows.sort(key=lambda r: r["part"])
            stacked = np.concatenate([np.frombuffer(r["data"]).reshape(-1, width) for r in rows])
            yield _row(group, sum(r["n"] for r in rows), reduced(stacked))

    found = stage(df.select(vector.alias("v")).mapInArrow(of_rows, SCHEMA), "triangles")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts, F.floor(F.col("part") / FAN_IN)).mapInArrow(of_triangles, SCHEMA)
    rows = found.collect()  # one row
    if not rows:
        return 0, np.zeros((0, width))
    return rows[0]["n"], np.frombuffer(bytes(rows[0]["data"])).reshape(-1, width)
