"""From documents to token files: language, near duplicates, benchmark items, mixture, ids.

Each stage takes what the one before has kept and returns the columns of ``documents``;
the last one writes token files and returns each document's place in them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import decontaminate, language, mixing, neardup, tokenids
from facetry.llm.common import table, whole
from facetry.operators.lookup import attach
from facetry.session import ship_package, stage

#: Below this score a text is hardly nearer to its language than to the others.
LEAST_SCORE = 0.3


def shipped(step):
    """The stage, with the package shipped to the workers first."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return step(spark, docs, sf_dir)

    return run_step


@shipped
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without a letter, null texts and doubtful ones go."""
    found = language.identify(docs, language.fit(docs), keep=docs.columns, names=("_lang_pred", "_score"))
    return found.filter((F.col("_lang_pred") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


@shipped
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose five-word shingles overlap by 0.8 or more.

    Texts are compared, not ids: a row without an id, or with the id of a row that has another
    text, is a document of its own with a name made from its id and text. Of rows with the same id
    and text one stays, and of a group of rows without ids the one whose name is smallest.
    """
    name = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", whole("text")), F.lit(1 << 62))
    digest = F.xxhash64(whole("text"))
    shared = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min(digest).alias("_first"), F.max(digest).alias("_last"))
    shared = stage(shared.filter("_first <> _last").drop("_last"), "ids-of-several-texts")
    rows = attach(docs.withColumn("_id", F.col("doc_id")).withColumn("_digest", digest), shared, ["_id"], spread_by="_digest")
    own = F.col("doc_id").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == F.col("_digest")))
    rows = rows.select(*docs.columns, F.when(own, F.col("doc_id").cast("long")).otherwise(name).alias("_name"))
    found = neardup.near_duplicates(rows, neardup.Sketch(words=5, percent=80), key="_name")
    kept = found.filter("kept").select(F.col("_name").alias("_kept")).distinct()
    return rows.join(kept, F.col("_name") == F.col("_kept"), "left_semi").dropDuplicates(["_name"]).select(*docs.columns)


@shipped
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), name="_matches")
    return found.filter(F.size("_matches") == 0).select(*docs.columns)


@shipped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards square-root source weights, in a global random order."""
    return mixing.mix(docs, names=("_copy", "_shuffle_key")).select(*docs.columns)


@shipped
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, number and checksum of each document's ids in the token files."""
    return tokenids.token_table(docs, tokenids.default_tokenizer())


STAGES = [
    ("language", known_language), ("near-duplicates", one_of_each_group), ("decontamination", without_benchmarks),
    ("mixing", mixed), ("token-files", token_files),
]
#: No stage but the mixing can be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
