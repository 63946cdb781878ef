"""Session helpers: where scratch tables live and how a plan is cut into one."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_facetry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="facetry-package-"), "facetry")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "facetry"))
    context._facetry_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the session names it.

    A cluster session has to name ``spark.checkpoint.dir``. Only a local session
    without one gets a fresh temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="facetry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    context = spark.sparkContext
    if not hasattr(context, "_facetry_run"):
        context._facetry_run = f"{scratch_root(spark)}/facetry-{uuid.uuid4().hex}"
    return f"{context._facetry_run}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; tables built on them are then gone too."""
    context = spark.sparkContext
    run = getattr(context, "_facetry_run", None)
    if run:
        where = context._jvm.org.apache.hadoop.fs.Path(run)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        del context._facetry_run


def stage(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table and return the table.

    Cuts the lineage on storage that outlives executors, gives the next plan exact
    file sizes, and lets it prune columns again. ``by`` is the last column, if the
    table is to have a folder for each of its values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._facetry_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``stage`` has returned and that nothing reads any more."""
    where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._facetry_path)
    where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unpivot(df: DataFrame, keys: list[str], columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """Rows ``(keys.., name, value)``, one per entry of ``columns``; no shuffle."""
    pairs = [F.struct(F.lit(k).alias(name), c.alias(value)) for k, c in columns.items()]
    return df.select(*keys, F.inline(F.array(*pairs)))
