"""Scoring of a stream of vectors with a fitted network and nuisance projection.

Both steps work row by row, so a stream gives the rows a batch job gives. The nuisance
part projects on the fitted directions; refitting them needs all rows and is batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetry.operators.network import Network, score
from facetry.operators.projection import Nuisance


def score_rows(df: DataFrame, network: Network, nuisance: Nuisance | None = None, item_id: str = "item_id",
               vector: str = "embedding") -> DataFrame:
    """``(item_id, one representation per attribute[, nuisance])`` for a batch or a stream."""
    names = network.shape["attribute_names"]
    if nuisance is None:
        return score(df, network, vector, keep=[item_id])
    scored = score(df.withColumn("_full", F.col(vector)), network, vector, keep=[item_id, "_full"])
    combined = scored.withColumn("interpretable", F.concat(*[F.col(a) for a in names]))
    return nuisance.score(combined, "interpretable", "_full").drop("interpretable", "_full")


def write_scores(scored: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scored rows to a Parquet folder; ``once`` stops after the rows present now."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
