"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.lookup import salted_join
from facetry.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction: neighbours of a node are linked to the least of them instead.

    The large one moves the neighbours above a node, the small one those below it and
    the node itself. Least neighbours are found map-side first; a node with very many
    links is spread over several salts to meet its own.
    """
    links = edges.filter("u > v") if small else _both_ways(edges)
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = salted_join(links, least, ["u"], "inner", spread_by="v")
    if small:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node with a link to another one; a component is named by its least node.

    Large and small stars take turns until nothing changes, which takes about the
    logarithm of the longest chain. Each turn is a written table. Null ends are left out.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = edges.filter((F.col("u") > F.col("v")) & F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    edges = stage(edges, "links")
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
        edges = stage(_stars(_stars(edges, small=False), small=True), "links")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
