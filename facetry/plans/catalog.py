"""Every operator as a query on the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import partial, reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import text, vectors
from facetry.operators import augment as aug
from facetry.operators import clean, encode, labelvectors, lexicon, metrics, negatives, network, projection, ridge, tuning
from facetry.operators.labels import count_classes, fit_labels
from facetry.operators.split import split_items
from facetry.operators.training import evaluate, history_frame, place, train_network, training_rows
from facetry.plans.baseline import run_baseline
from facetry.plans.estimator import FacetModel, classification_metrics
from facetry.plans.settings import Settings
from facetry.session import scratch_path, ship_package, stage
from facetry.sources import readers, writers
from facetry.streaming.scoring import score_rows, write_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ATTRIBUTES = {"lang": "lang", "label": "label"}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder):
    return table(spark, folder, "documents")


def labelled(spark, folder):
    """Documents with the sparse attributes quality and toxic, null where unknown."""
    return documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")


def items(spark, folder, *columns):
    """Items with vectors: ``item_id, lang, source, label, embedding``."""
    docs = documents(spark, folder).select(F.col("doc_id").alias("item_id"), "lang", "source", *columns)
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return clean.align(docs, known)


def maybe_items(spark, folder):
    """All documents, the vector null where there is none."""
    docs = documents(spark, folder).select(F.col("doc_id").alias("item_id"), "lang", "source")
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return docs.join(known, "item_id", "left")


def encoded_items(spark, folder):
    rows = items(spark, folder)
    return fit_labels(rows, ATTRIBUTES).transform(rows, ATTRIBUTES).select("item_id", "lang_idx", "label_idx", "embedding")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


def exploded(df: DataFrame, keys: list[str], vector: str, digits: int = 6) -> DataFrame:
    """One row per vector entry, so that results compare as plain numbers."""
    rows = df.select(*keys, F.posexplode(vector))
    return rows.select(*keys, F.col("pos").cast("int").alias("pos"), (F.round(F.col("col").cast("double"), digits) + 0.0).alias("value"))


# -- sources and sinks ----------------------------------------------------------


@query
def read_items(spark, folder):
    docs = readers.load_items(spark, f"{folder}/documents.parquet")
    return docs.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("length"))


@query
def read_items_csv(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    path = scratch_path(spark, "items") + ".csv"
    writer = docs.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.load_items(spark, path, "doc_id bigint, text string, lang string, source string")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@query
def read_orders_typed(spark, folder):
    """Orders written as CSV and read without a schema: whole numbers, numbers, dates and strings."""
    path = scratch_path(spark, "orders") + ".csv"
    table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string")).write.option("header", True).csv(path)
    back = readers.load_items(spark, path, infer=True, multi_line=False)
    kinds = F.lit(",".join(kind for _, kind in back.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus").dtypes))
    return back.select("o_orderkey", "o_totalprice", F.date_add("o_orderdate", 1).cast("string").alias("next_day"), "o_orderstatus", kinds.alias("kinds"))


@query
def sketched_attributes(spark, folder):
    """Sketches of the documents by source, added up: exact counts, and whether the estimate is within four standard errors."""
    rows, columns = labelled(spark, folder).withColumn("doc", F.col("doc_id")), ["doc", "lang", "source", "quality"]
    even, odd = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 <> 0")
    merged = clean.summarise_sketches(clean.merge_sketches(*[clean.sketch_attributes(part, columns) for part in (even, odd)]))
    exact = clean.summarise(rows, columns).select("attribute", F.col("n_unique").alias("exact"))
    close = F.abs(F.col("n_unique") - F.col("exact")) <= 4 * 1.04 / 64 * F.col("exact")
    return merged.join(exact, "attribute").select("attribute", "n_rows", "n_missing", close.alias("close"))


@query
def read_vectors(spark, folder):
    known = readers.load_vectors(spark, f"{folder}/embeddings.parquet")
    return known.select("vec_id", F.size("embedding").cast("bigint").alias("width"))


@query
def vectors_round_trip(spark, folder):
    path = writers.save_table(table(spark, folder, "embeddings"), scratch_path(spark, "vectors"))
    return exploded(readers.load_vectors(spark, path), ["vec_id"], "embedding")


@query
def labels_round_trip(spark, folder):
    path = writers.save_labels(fit_labels(items(spark, folder), ATTRIBUTES), scratch_path(spark, "labels"))
    return readers.load_labels(spark, path).table


@query
def negatives_round_trip(spark, folder):
    path = writers.save_table(sample_negatives(spark, folder), scratch_path(spark, "negatives"))
    return readers.load_negatives(spark, path)


@query
def network_round_trip(spark, folder):
    path = writers.save_network(spark, initial_network(spark, folder), scratch_path(spark, "network"))
    weights = readers.load_network(spark, path).to_frame(spark)
    rows = weights.select("layer", "row", F.posexplode("values").alias("column", "value"))
    return rounded(rows.withColumn("column", F.col("column").cast("int")), "value", digits=9)


@query
def metrics_round_trip(spark, folder):
    path = writers.save_table(classification_report(spark, folder), scratch_path(spark, "metrics"))
    return readers.load_metrics(spark, path)


@query
def augmentation_round_trip(spark, folder):
    path = scratch_path(spark, "augmentation")
    write_variations(spark, folder, cache_path=path)
    return readers.load_augmentation(spark, path).select("base_id", "strategy", "variation", F.md5("text").alias("digest"), "attempts")


# -- cleaning -------------------------------------------------------------------


@query
def drop_stray_columns(spark, folder):
    docs = documents(spark, folder)
    stray = docs.withColumn("X", F.col("doc_id")).withColumn("Unnamed: 0", F.col("doc_id")).withColumn("_c0", F.col("doc_id"))
    return clean.drop_stray_columns(stray).drop("text")


@query
def drop_missing_text(spark, folder):
    docs = labelled(spark, folder).withColumn("description", F.when(F.col("quality").isNotNull(), F.col("text")))
    return clean.drop_missing_text(docs, "description").select("doc_id", "source", F.md5("description").alias("digest"))


@query
def drop_missing_attributes(spark, folder):
    return clean.drop_missing_attributes(labelled(spark, folder), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query
def keep_first_text(spark, folder):
    return clean.keep_first(documents(spark, folder), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query
def keep_first_part_name(spark, folder):
    return clean.keep_first(table(spark, folder, "part"), "p_name", "p_partkey").select("p_partkey", "p_name", "p_brand")


@query
def assign_item_ids(spark, folder):
    return clean.assign_ids(table(spark, folder, "events").select("event_id", "event_type"), "event_id")


@query
def clean_items(spark, folder):
    docs = labelled(spark, folder).withColumn("Unnamed: 0", F.col("doc_id"))
    cleaned = clean.clean_items(docs, "doc_id", "text", ["quality", "toxic"])
    return cleaned.select("id", "doc_id", "lang", "quality", F.md5("text").alias("digest"))


@query
def clean_report(spark, folder):
    return clean.clean_report(labelled(spark, folder), "text", ["quality", "toxic"])


@query
def filter_frequent_values(spark, folder):
    return clean.filter_frequent(documents(spark, folder), "lang", 100).select("doc_id", "lang")


@query
def filter_frequent_nations(spark, folder):
    return clean.filter_frequent(table(spark, folder, "customer"), "c_nationkey", 60, spread_by="c_custkey")


@query
def composite_field(spark, folder):
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return clean.add_composite(customers, ["r_name", "n_name"], "place", text.COMPOSITE_SEPARATOR).select("c_custkey", "place")


@query
def composite_field_with_nulls(spark, folder):
    return clean.add_composite(labelled(spark, folder), ["quality", "lang", "toxic"], "mix", "#####").select("doc_id", "mix")


@query
def item_summary(spark, folder):
    return clean.summarise(labelled(spark, folder), ["lang", "source", "quality", "toxic", "absent"])


@query
def select_attributes(spark, folder):
    return clean.select_attributes(documents(spark, folder), ["language:lang", "source"], ["doc_id"])


@query
def clean_text_for_service(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(text.clean_for_service(F.col("text"))).alias("digest"))


@query
def clean_text_for_local(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.md5(text.clean_for_local(F.col("text"))).alias("digest"))


@query
def normalise_labels(spark, folder):
    mixed = composite_field_with_nulls(spark, folder)
    return mixed.select("doc_id", text.normalise_label(F.col("mix")).alias("label"))


# -- labels ---------------------------------------------------------------------


@query
def label_mapping(spark, folder):
    return fit_labels(labelled(spark, folder), {"lang": "lang", "source": "source", "quality": "quality"}).table


@query
def encode_labels(spark, folder):
    columns = {"lang": "lang", "source": "source", "quality": "quality"}
    docs = labelled(spark, folder)
    coded = fit_labels(docs, columns).transform(docs, columns)
    return coded.select("doc_id", "lang_idx", "source_idx", "quality_idx")


@query
def decode_labels(spark, folder):
    docs = documents(spark, folder)
    mapping = fit_labels(docs, {"source": "source"})
    coded = mapping.transform(docs, {"source": "source"}).select("doc_id", "source_idx")
    return mapping.class_names(coded, {"source": "source_idx"}).select("doc_id", "source_name")


@query
def class_counts(spark, folder):
    return count_classes(labelled(spark, folder), {"lang": "lang", "source": "source", "quality": "quality"})


@query
def align_items_with_vectors(spark, folder):
    return items(spark, folder).select("item_id", "lang", "source", "label", F.size("embedding").cast("bigint").alias("width"))


@query
def split_rows(spark, folder):
    return split_items(documents(spark, folder), "doc_id", 0.1, 42).select("doc_id", "split")


# -- vectors --------------------------------------------------------------------


@query
def valid_vectors(spark, folder):
    return maybe_items(spark, folder).select("item_id", vectors.valid(F.col("embedding"), 64).alias("valid"))


@query
def valid_rows(spark, folder):
    parts = vectors.blocks(F.col("embedding"), ["a", "b"], 64)
    rows = maybe_items(spark, folder).withColumn("p", parts)
    ok = vectors.valid(F.col("embedding")) & vectors.valid(F.col("p.a")) & vectors.valid(F.col("p.b"))
    return rows.filter(ok).select("item_id", "lang")


@query
def nonzero_anchors(spark, folder):
    return table(spark, folder, "embeddings").filter(vectors.nonzero(F.col("embedding"))).select("vec_id", "label")


@query
def trim_vectors(spark, folder):
    short = table(spark, folder, "embeddings").select("vec_id", vectors.trim(F.col("embedding"), 16).alias("v"))
    return exploded(short, ["vec_id"], "v")


@query
def split_vectors(spark, folder):
    parts = vectors.blocks(F.col("embedding"), ["first", "second", "third", "fourth"], 64)
    rows = table(spark, folder, "embeddings").select("vec_id", parts.alias("p"))
    named = [exploded(rows, ["vec_id"], f"p.{n}").withColumn("block", F.lit(n)) for n in ("first", "second", "third", "fourth")]
    return reduce(DataFrame.unionByName, named)


@query
def concat_vectors(spark, folder):
    parts = vectors.blocks(F.col("embedding"), ["a", "b"], 64)
    rows = table(spark, folder, "embeddings").select("vec_id", parts.alias("p"))
    return exploded(rows.select("vec_id", F.concat("p.b", "p.a").alias("v")), ["vec_id"], "v")


@query
def normalise_vectors(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", vectors.normalise(F.col("embedding")).alias("v"))
    return exploded(unit, ["vec_id"], "v")


# -- negatives ------------------------------------------------------------------


@query
def negative_pool_sizes(spark, folder):
    return negatives.pool_sizes(items(spark, folder), ["label", "lang"]).select("label", "lang", "n", "pool")


@query
def negative_pool_sizes_three(spark, folder):
    return negatives.pool_sizes(items(spark, folder), ["label", "lang", "source"]).select("label", "lang", "source", "n", "pool")


@query
def item_pool_sizes(spark, folder):
    rows = items(spark, folder)
    pools = negatives.pool_sizes(rows, ["label", "lang"]).select("label", "lang", "pool")
    return rows.join(pools, ["label", "lang"]).select("item_id", "pool")


@query
def compatible_keys(spark, folder):
    keys = stage(items(spark, folder).groupBy("label", "lang").agg(F.count("*").alias("n")), "keys")
    return negatives.compatible_keys(keys, keys, ["label", "lang"])


@query
def brute_force_pool(spark, folder):
    rows = items(spark, folder)
    first = rows.agg(F.min("item_id")).first()[0]
    return negatives.brute_force_pool(rows, "item_id", first, ["label", "lang"])


@query
def sample_negatives(spark, folder):
    return negatives.sample_negatives(items(spark, folder), ["label", "lang"])


@query
def negatives_certificate(spark, folder):
    """Per item over three attributes: slots, distinct negatives, those sharing an attribute."""
    rows = items(spark, folder)
    found = negatives.sample_negatives(rows, ["label", "lang", "source"]).filter("pos > 0")
    own = rows.select("item_id", "label", "lang", "source")
    other = rows.select(F.col("item_id").alias("neg_id"), *[F.col(a).alias(f"_{a}") for a in ("label", "lang", "source")])
    shares = (F.col("label") == F.col("_label")) | (F.col("lang") == F.col("_lang")) | (F.col("source") == F.col("_source"))
    return found.join(own, "item_id").join(other, "neg_id").groupBy("item_id").agg(
        F.count("*").alias("n_slots"), F.countDistinct("neg_id").alias("n_distinct"), F.count_if(shares).alias("n_shared"))


@query
def negatives_of_all_documents(spark, folder):
    """Per document over three attributes, null quality being a value: slots, distinct negatives, those sharing an attribute."""
    rows = labelled(spark, folder).select(F.col("doc_id").alias("item_id"), "quality", "lang", "source")
    found = negatives.sample_negatives(rows, ["quality", "lang", "source"], vector=None).filter("pos > 0")
    other = rows.select(F.col("item_id").alias("neg_id"), *[F.col(a).alias(f"_{a}") for a in ("quality", "lang", "source")])
    shares = F.col("quality").eqNullSafe(F.col("_quality")) | (F.col("lang") == F.col("_lang")) | (F.col("source") == F.col("_source"))
    return found.join(rows, "item_id").join(other, "neg_id").groupBy("item_id").agg(
        F.count("*").alias("n_slots"), F.countDistinct("neg_id").alias("n_distinct"), F.count_if(shares).alias("n_shared"))


@query
def anchor_slots(spark, folder):
    anchors = sample_negatives(spark, folder).filter("pos = 0")
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("neg_id"), "embedding")
    return exploded(anchors.join(known, "neg_id"), ["item_id"], "embedding")


@query
def gather_negative_vectors(spark, folder):
    rows = encoded_items(spark, folder)
    cells = training_rows(rows, sample_negatives(spark, folder), ["lang_idx", "label_idx"])
    slots = cells.select("item_id", "lang_idx", "label_idx", F.posexplode("cells").alias("pos", "v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return slots.select("item_id", "lang_idx", "label_idx", F.col("pos").cast("int").alias("pos"), (F.round(total, 6) + 0.0).alias("total"))


@query
def check_negatives(spark, folder):
    rows = maybe_items(spark, folder)
    return negatives.check_negatives(negatives.sample_negatives(rows, ["lang", "source"]), 64)


# -- algebra --------------------------------------------------------------------


@query
def vector_gram(spark, folder):
    g = projection.gram(table(spark, folder, "embeddings"), "embedding", 64)
    return rounded(projection.gram_frame(spark, g), "value")


def two_part_items(spark, folder, x_width, y_width=64):
    return items(spark, folder).select(
        "item_id", vectors.trim(F.col("embedding"), x_width).alias("x"), vectors.trim(F.col("embedding"), y_width).alias("y"))


@query
def projection_residuals(spark, folder):
    rows = projection.projection_residuals(two_part_items(spark, folder, 2), "x", "y", 2, 64)
    return exploded(rows, ["item_id"], "residual")


@query
def residual_norms(spark, folder):
    fit = projection.fit_projection(two_part_items(spark, folder, 2), "x", "y", 2, 64)
    norms = [(fit.n, fit.residual_ratio * fit.total_squares**0.5, fit.total_squares**0.5, fit.residual_ratio)]
    return rounded(spark.createDataFrame(norms, "n bigint, residual_norm double, vector_norm double, ratio double"),
                   "residual_norm", "vector_norm", "ratio")


@query
def nuisance_three_wide(spark, folder):
    """Three-entry vectors on one representation column: two components, known in closed form."""
    rows = two_part_items(spark, folder, 1, 3)
    fit = projection.fit_nuisance(rows, "x", "y", 1, 3, num_nuisance_dims=2)
    return exploded(fit.score(rows, "x", "y"), ["item_id"], "nuisance")


@query
def elbow_three_wide(spark, folder):
    fit = projection.fit_nuisance(two_part_items(spark, folder, 1, 3), "x", "y", 1, 3, num_nuisance_dims=2)
    return rounded(projection.elbow_table(spark, fit.spectrum.values), "singular_value", "diff", "cumulative_pct")


@query
def nuisance_controls(spark, folder):
    """Network representations against full vectors, five components."""
    net = initial_network(spark, folder)
    rows = items(spark, folder).select("item_id", "embedding").withColumn("full", F.col("embedding"))
    scored = stage(network.score(rows, net, keep=["item_id", "full"]), "scored")
    units = net.shape["embedding_units_per_attribute"]
    out, _ = projection.nuisance_controls(scored, net.shape["attribute_names"], "full", [units] * 2, 64, 5)
    return exploded(out, ["item_id"], "nuisance")


@query
def elbow_table(spark, folder):
    rows = two_part_items(spark, folder, 8)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit = projection.fit_nuisance(rows, "x", "y", 8, 64)
    return rounded(projection.elbow_table(spark, fit.spectrum.values), "singular_value", "diff", "cumulative_pct")


def represented(spark, folder):
    """All documents: network representations ``x`` and full vectors ``y``, null where there is no vector."""
    net = initial_network(spark, folder)
    rows = maybe_items(spark, folder).select("item_id", "embedding").withColumn("y", F.col("embedding"))
    scored = network.score(rows, net, keep=["item_id", "y"])
    x = F.concat(*[F.col(a) for a in net.shape["attribute_names"]])
    width = net.shape["embedding_units_per_attribute"] * len(net.shape["attribute_names"])
    return stage(scored.select("item_id", "y", x.alias("x")), "represented"), width


def products(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``i, j, value``: the crossproduct of two vector columns, relative to the lengths of their columns."""
    one = rows.select("item_id", F.posexplode(left).alias("i", "a"))
    other = rows.select("item_id", F.posexplode(right).alias("j", "b"))
    sums = one.join(other, "item_id").groupBy("i", "j").agg(
        F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"), F.sum(F.col("a").cast("double") * F.col("a")).alias("aa"),
        F.sum(F.col("b").cast("double") * F.col("b")).alias("bb"))
    return sums.select("i", "j", (F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("value"))


@query
def projection_certificate(spark, folder):
    """Residuals of all entries on all representation entries: their products with these are zero."""
    rows, width = represented(spark, folder)
    found = projection.projection_residuals(rows, "x", "y", width, 64).filter("residual IS NOT NULL")
    n = found.count()
    leaks = products(found, "x", "residual").groupBy("j").agg((F.round(F.max(F.abs("value")), 6) + 0.0).alias("leak"))
    return leaks.select(F.col("j").cast("int").alias("pos"), F.lit(n).cast("bigint").alias("n"), "leak")


@query
def nuisance_certificate(spark, folder):
    """Five components at full width: free of the representations, and of each other."""
    rows, width = represented(spark, folder)
    fit = projection.fit_nuisance(rows, "x", "y", width, 64, num_nuisance_dims=5)
    scored = stage(fit.score(rows, "x", "y").filter("nuisance IS NOT NULL"), "nuisance")
    leak = products(scored, "x", "nuisance").groupBy("j").agg((F.round(F.max(F.abs("value")), 6) + 0.0).alias("leak"))
    own = products(scored, "nuisance", "nuisance").filter("i <> j").groupBy("j").agg((F.round(F.max(F.abs("value")), 6) + 0.0).alias("overlap"))
    return leak.join(own, "j").select(F.col("j").cast("int").alias("component"), F.lit(scored.count()).cast("bigint").alias("n"), "leak", "overlap")


@query
def extend_certificate(spark, folder):
    """A nuisance fit on the even documents, extended by the odd ones, against the fit on all: rows, singular values, directions."""
    rows, width = represented(spark, folder)
    whole = projection.fit_nuisance(rows, "x", "y", width, 64, num_nuisance_dims=5)
    part = projection.fit_nuisance(rows.filter("item_id % 2 = 0"), "x", "y", width, 64, num_nuisance_dims=5)
    part = projection.fit_nuisance(rows.filter("item_id % 2 <> 0"), "x", "y", width, 64, num_nuisance_dims=5, known=part)
    found = []
    for i in range(5):
        one, other = whole.spectrum, part.spectrum
        turn = 1.0 - abs(float(one.loadings[:, i] @ other.loadings[:, i]))
        found.append((i, part.projection.n, float(abs(one.values[i] - other.values[i])), turn))
    return rounded(spark.createDataFrame(found, "component int, n bigint, gap double, turn double"), "gap", "turn")


@query
def elbow_certificate(spark, folder):
    """Each singular value of the residuals is the length of its scores; drops and shares follow from them."""
    rows, width = represented(spark, folder)
    fit = projection.fit_nuisance(rows, "x", "y", width, 64, num_nuisance_dims=20)
    table = projection.elbow_table(spark, fit.spectrum.values)
    lengths = fit.score(rows, "x", "y").filter("nuisance IS NOT NULL").select(F.posexplode("nuisance").alias("i", "v"))
    lengths = lengths.groupBy((F.col("i") + 1).alias("dim")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    falls = (F.col("diff") >= 0) & (F.col("cumulative_pct") > 0) & (F.col("cumulative_pct") <= 100 + 1e-9)
    return table.join(lengths, "dim").select("dim", (F.round(F.col("length") - F.col("singular_value"), 6) + 0.0).alias("gap"), falls.alias("falls"))


@query
def design_pair_counts(spark, folder):
    return ridge.design_pairs(items(spark, folder), {"lang": "lang", "source": "source", "label": "label"})


def one_attribute_ridge(spark, folder):
    rows = stage(items(spark, folder).select("item_id", "source", "embedding"), "ridge-rows")
    fit = ridge.fit_ridge(rows, {"source": "source"}, "embedding", 64)
    return rows, fit


@query
def ridge_fitted(spark, folder):
    rows, fit = one_attribute_ridge(spark, folder)
    scored = fit.score(rows, {"source": "source"}, "embedding").withColumn("pair", F.arrays_zip("fitted", "residual"))
    values = scored.select("item_id", F.posexplode("pair"))
    flat = values.select("item_id", F.col("pos").cast("int").alias("pos"), F.col("col.fitted").alias("fitted"), F.col("col.residual").alias("residual"))
    return rounded(flat, "fitted", "residual")


@query
def ridge_coefficients(spark, folder):
    _, fit = one_attribute_ridge(spark, folder)
    return exploded(fit.coefficient_frame(spark), ["attribute", "idx"], "coefficients")


@query
def ridge_norms(spark, folder):
    _, fit = one_attribute_ridge(spark, folder)
    row = [(fit.n, fit.residual_norm, fit.vector_norm, fit.residual_variance_ratio)]
    frame = spark.createDataFrame(row, "n bigint, residual_norm double, vector_norm double, residual_variance_ratio double")
    return rounded(frame, "residual_norm", "vector_norm", "residual_variance_ratio")


@query
def ridge_two_attributes(spark, folder):
    rows = items(spark, folder)
    columns = {"lang": "lang", "source": "source"}
    fit = ridge.fit_ridge(rows, columns, "embedding", 64)
    return exploded(fit.score(rows, columns, "embedding").select("item_id", "nuisance"), ["item_id"], "nuisance")


@query
def ridge_certificate(spark, folder):
    """Three attributes: residuals of a label add up to alpha times its coefficients."""
    rows = items(spark, folder)
    columns = {"lang": "lang", "source": "source", "label": "label"}
    fit = ridge.fit_ridge(rows, columns, "embedding", 64, alpha=2.0)
    scored = stage(fit.mapping.transform(fit.score(rows, columns, "embedding"), columns), "scored")
    weights, gaps = fit.coefficient_frame(spark), []
    for a in columns:
        sums = scored.select(F.col(f"{a}_idx").alias("idx"), F.posexplode("residual")).groupBy("idx", "pos").agg(F.sum("col").alias("total"), F.count("*").alias("n"))
        own = weights.filter(F.col("attribute") == a).select("idx", F.posexplode("coefficients").alias("pos", "w"))
        gap = F.round(F.max(F.abs(F.col("total") - 2.0 * F.col("w"))), 6) + 0.0
        gaps.append(sums.join(own, ["idx", "pos"]).groupBy("idx").agg(F.first("n").alias("n"), gap.alias("gap")).select(F.lit(a).alias("attribute"), "idx", "n", "gap"))
    return reduce(DataFrame.unionByName, gaps)


@query
def linear_baseline(spark, folder):
    docs = labelled(spark, folder).select(F.col("doc_id").alias("item_id"), "text", "lang", "source", "quality")
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    _, files = run_baseline(docs, known, "item_id", "text", ["lang", "quality"], "source", scratch_path(spark, "baseline"))
    return exploded(spark.read.parquet(files["nuisance"]), ["item_id"], "embedding")


# -- metrics --------------------------------------------------------------------


def toy_logits(spark, folder):
    """Vector entries 1-10 as logits of the label, 11-14 of the language, 15-34 of the source."""
    rows = items(spark, folder)
    columns = {"lang": "lang", "source": "source"}
    coded = fit_labels(rows, columns).transform(rows, columns)
    v = F.col("embedding")
    return coded.withColumn("label_logits", F.slice(v, 1, 10)).withColumn("lang_logits", F.slice(v, 11, 4)).withColumn("source_logits", F.slice(v, 15, 20))


def predictions(spark, folder):
    rows = toy_logits(spark, folder)
    sides = [metrics.ranked_predictions(rows, a, c, f"{a}_logits") for a, c in
             (("label", "label"), ("lang", "lang_idx"), ("source", "source_idx"))]
    return reduce(DataFrame.unionByName, sides)


@query
def top_predictions(spark, folder):
    rows = toy_logits(spark, folder).select("item_id", F.posexplode(vectors.best_classes(F.col("label_logits"), 5)))
    return rows.select("item_id", F.col("pos").cast("int").alias("rank"), F.col("col").cast("int").alias("class"))


@query
def confusion_counts(spark, folder):
    return metrics.confusion(predictions(spark, folder)).select("attribute", "truth", "predicted", "n", "n_top_5")


@query
def class_scores(spark, folder):
    scores = metrics.class_scores(metrics.confusion(predictions(spark, folder)))
    return rounded(scores, "precision", "recall", "f1")


@query
def classification_report(spark, folder):
    return rounded(metrics.attribute_metrics(predictions(spark, folder)), *metrics.AVERAGED)


@query
def average_report(spark, folder):
    return rounded(metrics.average_metrics(metrics.attribute_metrics(predictions(spark, folder))), *metrics.AVERAGED)


@query
def cross_entropy_rows(spark, folder):
    rows = toy_logits(spark, folder)
    return rounded(rows.select("item_id", vectors.cross_entropy(F.col("label_logits"), F.col("label")).alias("loss")), "loss")


def cosines(spark, folder):
    """Cosines of each item's halves with those of its negatives."""
    own = items(spark, folder).select("item_id", vectors.blocks(F.col("embedding"), ["a", "b"], 64).alias("own"))
    other = own.select(F.col("item_id").alias("neg_id"), F.col("own").alias("other"))
    pairs = sample_negatives(spark, folder).filter("pos > 0").join(own, "item_id").join(other, "neg_id")
    return pairs.select("item_id", "pos", *[vectors.cosine(F.col(f"own.{n}"), F.col(f"other.{n}")).alias(f"cos_{n}") for n in "ab"])


@query
def cosine_rows(spark, folder):
    return rounded(cosines(spark, folder), "cos_a", "cos_b")


@query
def contrastive_rows(spark, folder):
    grouped = cosines(spark, folder).groupBy("item_id").agg(*[F.collect_list(f"cos_{n}").alias(n) for n in "ab"])  # 9 each
    total = vectors.contrastive_term(F.col("a")) + vectors.contrastive_term(F.col("b"))
    return rounded(grouped.select("item_id", total.alias("loss")), "loss")


@query
def loss_means(spark, folder):
    ce = cross_entropy_rows(spark, folder).agg(F.avg("loss").alias("cross_entropy"), F.count("*").alias("n_rows"))
    pull = contrastive_rows(spark, folder).agg(F.avg("loss").alias("contrastive"))
    both = ce.crossJoin(pull)  # one row each
    total = F.col("cross_entropy") + 0.1 * F.col("contrastive")
    return rounded(both.withColumn("total", total), "cross_entropy", "contrastive", "total", digits=5)


# -- lexicon, label vectors, encoder --------------------------------------------


def word_lists(spark, folder):
    """A lexicon from the benchmark table: a category per passage, its words as terms."""
    words = table(spark, folder, "benchmark").select(F.col("item_id").alias("category"), F.explode(lexicon.tokens(F.col("text"))).alias("term"))
    return words.distinct()


@query
def lexicon_scores(spark, folder):
    scores = lexicon.category_scores(documents(spark, folder), "doc_id", "text", word_lists(spark, folder))
    return rounded(scores, "score")


@query
def lexicon_summary(spark, folder):
    summary = lexicon.category_summary(documents(spark, folder), "doc_id", "text", word_lists(spark, folder))
    return rounded(summary, "mean", "std")


@query
def lexicon_certificate(spark, folder):
    """Ten controls of every document: free of each other, as long as their singular values."""
    out, fit = lexicon.lexicon_controls(documents(spark, folder), "doc_id", "text", word_lists(spark, folder), 10)
    out = stage(out.withColumnRenamed("doc_id", "item_id"), "controls")
    own = products(out, "controls", "controls").filter("i <> j").groupBy("j").agg((F.round(F.max(F.abs("value")), 6) + 0.0).alias("overlap"))
    lengths = out.select(F.posexplode("controls").alias("j", "v")).groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"), F.count("*").alias("n"))
    values = spark.createDataFrame(list(enumerate(fit.spectrum.values.tolist())), "j int, value double")
    gap = (F.round(F.col("length") - F.col("value"), 6) + 0.0).alias("gap")
    return own.join(lengths, "j").join(values, "j").select(F.col("j").cast("int").alias("component"), "n", "overlap", gap)


@query
def lexicon_controls(spark, folder):
    out, _ = lexicon.lexicon_controls(documents(spark, folder), "doc_id", "text", word_lists(spark, folder), 10)
    return exploded(out, ["doc_id"], "controls")


@query
def count_empty_texts(spark, folder):
    return lexicon.count_empty(table(spark, folder, "conversations"), "text")


@query
def hash_vectors(spark, folder):
    out = encode.encode_texts(documents(spark, folder), "doc_id", "text", encode.HashingEncoder, "service")
    return exploded(out, ["doc_id"], "embedding", digits=4)


@query
def encode_status(spark, folder):
    out = encode.encode_texts(table(spark, folder, "part"), "p_partkey", "p_name", encode.HashingEncoder, "local")
    return encode.status_counts(out)


def label_table(spark, folder):
    mixed = composite_field_with_nulls(spark, folder).select(F.col("doc_id").alias("item_id"), "mix")
    return mixed.join(labelled(spark, folder).select(F.col("doc_id").alias("item_id"), F.col("quality").cast("string").alias("plain")), "item_id")


@query
def label_vectors(spark, folder):
    out = labelvectors.label_vectors(label_table(spark, folder), "mix", "plain", partial(encode.HashingEncoder, 16), 16)
    return exploded(out, ["item_id"], "combined", digits=4)


@query
def label_vector_zeros(spark, folder):
    out = labelvectors.label_vectors(label_table(spark, folder), "mix", "plain", partial(encode.HashingEncoder, 16), 16)
    return labelvectors.zero_counts(out)


@query
def label_baselines(spark, folder):
    encoders = {"narrow": (partial(encode.HashingEncoder, 8), 8), "wide": (partial(encode.HashingEncoder, 16), 16)}
    made = labelvectors.baselines(label_table(spark, folder), "mix", "plain", encoders)
    parts = [df.select(F.lit(n).alias("encoder"), "item_id", F.size("combined").cast("bigint").alias("width"),
                       vectors.nonzero(F.col("varietal")).alias("has_plain")) for n, df in made.items()]
    return reduce(DataFrame.unionByName, parts)


# -- augmentation ---------------------------------------------------------------


@query
def build_prompts(spark, folder):
    asked = aug.prompts(documents(spark, folder), "doc_id", "text", [aug.CONCISE, aug.CREATIVE], 3, {"language": "lang", "origin": "source"})
    return asked.select("base_id", "strategy", "variation", "temperature", "max_tokens", F.md5("prompt").alias("digest"))


@query
def check_responses(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.usable_response(F.col("html")).alias("html_ok"), text.usable_response(F.col("url")).alias("url_ok"))


def write_variations(spark, folder, **options):
    return aug.augment(documents(spark, folder), "doc_id", "text", aug.TemplateGenerator, num_variations=2, **options)


@query
def augment_texts(spark, folder):
    out = write_variations(spark, folder)
    return out.select("base_id", "strategy", "variation", F.md5("text").alias("digest"), "status", "attempts")


@query
def augmentation_outcomes(spark, folder):
    """Texts asked for and attempts made by status, from a generator that fails by a hash of the text."""
    found = aug.answers(documents(spark, folder), "doc_id", "text", aug.MoodyGenerator, num_variations=2, retry_delay=0.0)
    return aug.outcome(found).select("status", F.col("texts").alias("n"), "attempts")


@query
def augmentation_status(spark, folder):
    return encode.status_counts(write_variations(spark, folder))


# -- network --------------------------------------------------------------------


def initial_network(spark, folder):
    """Untrained network over lang and label: its weights are known functions of their place."""
    sizes = {r["attribute"]: r["n_classes"] for r in count_classes(items(spark, folder), ATTRIBUTES).collect()}  # two rows
    shape = network.network_shape({a: sizes[a] for a in ATTRIBUTES}, 64, projection_units=32, embedding_units_per_attribute=4)
    return network.Network.initial(shape, 42)


@query
def network_representations(spark, folder):
    rows = network.score(items(spark, folder).select("item_id", "embedding"), initial_network(spark, folder))
    return exploded(rows.select("item_id", F.concat("lang", "label").alias("v")), ["item_id"], "v")


@query
def network_logits(spark, folder):
    rows = network.score(items(spark, folder).select("item_id", "embedding"), initial_network(spark, folder), with_logits=True)
    return exploded(rows.select("item_id", F.concat("lang_logits", "label_logits").alias("v")), ["item_id"], "v")


@query
def network_metrics(spark, folder):
    found = classification_metrics(encoded_items(spark, folder), initial_network(spark, folder))
    return rounded(found, *metrics.AVERAGED)


@query
def network_losses(spark, folder):
    """Mean losses and accuracies of the untrained network over all items and their negatives."""
    net = initial_network(spark, folder)
    rows = training_rows(encoded_items(spark, folder), sample_negatives(spark, folder), ["lang_idx", "label_idx"])
    shards = place(rows, list(ATTRIBUTES), 64, 10)
    found = evaluate(shards, net)
    shards.unpersist()
    names = ["contrastive", "lang_loss", "lang_acc", "label_loss", "label_acc", "total"]
    frame = spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return rounded(frame, *names)


@query
def streamed_representations(spark, folder):
    """The vectors read as a stream, scored and appended to a table."""
    net = initial_network(spark, folder)
    source = scratch_path(spark, "stream-in")
    items(spark, folder).select("item_id", "embedding").write.parquet(source)
    stream = spark.readStream.schema("item_id bigint, embedding array<float>").parquet(source)
    out = scratch_path(spark, "stream-out")
    write_scores(score_rows(stream, net), out, scratch_path(spark, "stream-log"), once=True).awaitTermination()
    rows = spark.read.parquet(out)
    return exploded(rows.select("item_id", F.concat("lang", "label").alias("v")), ["item_id"], "v")


def split_training_rows(spark, folder):
    rows = training_rows(encoded_items(spark, folder), sample_negatives(spark, folder), ["lang_idx", "label_idx"])
    split = stage(split_items(rows), "split")
    return split.filter("split = 'train'"), split.filter("split = 'validation'")


@query
def training_history(spark, folder):
    train, held_out = split_training_rows(spark, folder)
    _, history = train_network(train, held_out, initial_network(spark, folder), epochs=3, learning_rate=0.004)
    return history_frame(spark, history)


@query
def training_certificate(spark, folder):
    """Three epochs in two runs, the second from the first one's state: rates, and whether the loss is below that of the untrained network."""
    train, held_out = split_training_rows(spark, folder)
    net, path = initial_network(spark, folder), scratch_path(spark, "state")
    args = (list(ATTRIBUTES), 64, 10)
    placed, kept = place(train, *args), place(held_out, *args)
    before = evaluate(kept, net)["total"]
    train_network(placed, kept, net, epochs=1, learning_rate=0.004, state_path=path)
    _, history = train_network(placed, kept, net, epochs=3, learning_rate=0.004, state_path=path)
    rows = history_frame(spark, history).select("epoch", "learning_rate", (F.col("val_loss") < before).alias("below"))
    return rows.withColumn("n_train", F.lit(placed.rows().count()).cast("bigint")).withColumn("n_validation", F.lit(kept.rows().count()).cast("bigint"))


@query
def tuning_certificate(spark, folder):
    """How many of six trials went how far, and that the best of them went to the end."""
    found = tuning_trials(spark, folder)
    best = F.max(F.struct(-F.col("val_loss"), "epochs")).alias("best")
    last = found.agg(best, F.max("epochs").alias("most")).select((F.col("best.epochs") == F.col("most")).alias("best_is_last"))
    return found.groupBy("epochs").agg(F.count("*").alias("n_trials")).join(F.broadcast(last))


@query
def tuning_trials(spark, folder):
    train, held_out = split_training_rows(spark, folder)
    sizes = initial_network(spark, folder).shape["attribute_sizes"]
    _, trials = tuning.tune(train, held_out, sizes, 64, n_trials=6, epochs_per_trial=6, parallel_trials=3)
    return trials


def fitted_model(spark, folder):
    settings = Settings(epochs_final=2, mask_size=64, projection_units=32, embedding_units_per_attribute=4, num_nuisance_dims=5)
    model = FacetModel(list(ATTRIBUTES), scratch_path(spark, "model"), settings)
    return model.fit(items(spark, folder), tune_first=False)


@query
def fit_and_transform(spark, folder):
    scored = fitted_model(spark, folder).transform()
    return scored.select("item_id", *[F.size(c).cast("bigint").alias(f"{c}_width") for c in ("lang", "label", "nuisance")])


@query
def reload_certificate(spark, folder):
    """A saved and loaded model gives every document what the fitted one gives it, and its representations are the network's."""
    model = fitted_model(spark, folder)
    rows = maybe_items(spark, folder).select("item_id", "embedding")
    one = model.transform(rows, nuisance="project")
    other = FacetModel.load(spark, model.save(spark)).transform(rows, nuisance="project")
    direct = network.score(rows, model.network).select("item_id", F.concat("lang", "label").alias("direct"))
    names = ["lang", "label", "nuisance"]
    both = one.join(other.select("item_id", *[F.col(n).alias(f"_{n}") for n in names]), "item_id").join(direct, "item_id")

    def gap(a: str, b: str):
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))

    far = F.greatest(*[gap(n, f"_{n}") for n in names], gap("_all", "direct"))
    both = both.withColumn("_all", F.concat("lang", "label"))
    return both.select("item_id", F.col("nuisance").isNotNull().alias("valid"), (F.round(F.coalesce(far, F.lit(0.0)), 9) + 0.0).alias("gap"))


@query
def transform_new_items(spark, folder):
    model = fitted_model(spark, folder)
    path = model.save(spark)
    loaded = FacetModel.load(spark, path)
    new = maybe_items(spark, folder).select("item_id", "embedding")
    scored = loaded.transform(new, nuisance="project")
    return scored.select("item_id", F.col("nuisance").isNotNull().alias("valid"))


@query
def export_files(spark, folder):
    model = fitted_model(spark, folder)
    texts = documents(spark, folder).select(F.col("doc_id").alias("item_id"), "text")
    files = model.export(full_embeddings=items(spark, folder).select("item_id", "embedding"), lexicon_table=word_lists(spark, folder), texts=texts)
    sums = readers.read_json(spark, files["manifest"])["tables"]
    return spark.createDataFrame(sorted((n, s["rows"]) for n, s in sums.items()), "name string, n_rows bigint")
