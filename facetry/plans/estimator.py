"""The whole flow: encode labels, vectors, negatives, train, represent, control, measure, export."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import vectors
from facetry.operators import encode, labelvectors, lexicon, metrics
from facetry.operators.labels import LabelMapping, fit_labels
from facetry.operators.negatives import sample_negatives
from facetry.operators.network import Network, network_shape, score
from facetry.operators.projection import Nuisance, Projection, Spectrum, elbow_table, fit_nuisance, vector_width
from facetry.operators.split import split_items
from facetry.operators.training import history_frame, train_network, training_rows
from facetry.operators.tuning import tune
from facetry.plans.settings import Settings
from facetry.session import stage
from facetry.sources.readers import complete, exists, load_network, read_json
from facetry.sources.writers import fingerprint, save_json, save_labels, save_network, save_table


class FacetModel:
    """Fit on a table of items, then score, export, save and load."""

    def __init__(self, attributes: list[str], output_dir: str, settings: Settings | None = None):
        self.attributes, self.output_dir = list(attributes), output_dir.rstrip("/")
        self.settings = settings or Settings()
        self.mapping: LabelMapping | None = None
        self.network: Network | None = None
        self.nuisance: Nuisance | None = None
        self.scored: DataFrame | None = None
        self.metrics: DataFrame | None = None
        self.history: DataFrame | None = None
        self.trials: DataFrame | None = None
        self.hyperparameters: dict = {}

    def fit(
        self,
        items: DataFrame,
        columns: dict[str, str] | None = None,
        item_id: str = "item_id",
        vector: str | None = "embedding",
        text: str | None = None,
        make_encoder: Callable[[], encode.Encoder] | None = None,
        tune_first: bool = True,
        n_trials: int = 75,
        use_cached_model: bool = True,
        cached_model_path: str | None = None,
        **training,
    ) -> FacetModel:
        """``columns`` maps attribute to column. Vectors come from ``vector`` or from ``text``.

        A complete model at ``cached_model_path`` (by default ``<output>/model``) is used instead of
        training a new one if it was made for the same labels, width and settings; otherwise it is
        trained anew, and a warning says what differs.
        """
        s, spark = self.settings, items.sparkSession
        columns = columns or {a: a for a in self.attributes}
        self.item_id = item_id
        self.mapping = fit_labels(items, {a: columns[a] for a in self.attributes})
        rows = self._with_vectors(items, item_id, vector, text, make_encoder)
        encoded = self.mapping.transform(rows, {a: columns[a] for a in self.attributes}, spread_by=item_id)
        label_cols = [f"{a}_idx" for a in self.attributes]
        encoded = stage(encoded.select(F.col(item_id).alias("item_id"), *label_cols, "embedding"), "encoded-items")
        self.vectors, self.width = encoded, vector_width(encoded, "embedding")
        negatives = stage(sample_negatives(encoded, label_cols, mini_batch_size=s.mini_batch_size, seed=s.array_seed, width=self.width), "negatives")
        self.negatives = negatives

        model_path = cached_model_path or f"{self.output_dir}/model"
        # The nuisance part is fitted anew in any case, and the length of the search is no property of the model.
        own = {k: v for k, v in asdict(s).items() if "nuisance" not in k}
        made_with = {"labels": fingerprint(self.mapping.table), "width": self.width, "settings": own}
        if use_cached_model and self._is_made_with(spark, model_path, made_with):
            self.network = load_network(spark, model_path)
        else:
            self._train(encoded, negatives, label_cols, model_path, tune_first, n_trials, training)
            save_json(spark, made_with, f"{model_path}/made_with")
        self.hyperparameters = self.hyperparameters or dict(self.network.shape)

        self.scored = self._score(encoded, label_cols, refit=True)
        self.metrics = stage(classification_metrics(encoded, self.network), "metrics")
        return self

    @staticmethod
    def _is_made_with(spark: SparkSession, path: str, made_with: dict) -> bool:
        """Whether a complete model lies at ``path`` that was made just so."""
        if not complete(spark, f"{path}/weights"):
            return False
        found = read_json(spark, f"{path}/made_with") if complete(spark, f"{path}/made_with") else {}
        other = [k for k, v in json.loads(json.dumps(made_with)).items() if found.get(k) != v]
        if other:
            warnings.warn(f"the model at {path} was made with other {', '.join(other)} and is trained anew", stacklevel=3)
        return not other

    def _with_vectors(self, items, item_id, vector, text, make_encoder) -> DataFrame:
        if vector and vector in items.columns:
            return items.withColumnRenamed(vector, "embedding")
        if text is None or make_encoder is None:
            raise ValueError("give a vector column, or a text column and make_encoder")
        mode = "service" if self.settings.embedding_backend == "openai" else "local"
        made = stage(encode.encode_texts(items, item_id, text, make_encoder, mode), "vectors")
        return items.join(made.select(item_id, "embedding"), item_id, "left")

    def _train(self, encoded, negatives, label_cols, model_path, tune_first, n_trials, training) -> None:
        s, spark = self.settings, encoded.sparkSession
        # Searches never ask for more than the larger of the two masks.
        mask = None if tune_first else min(s.mask_size, self.width)
        split = split_items(training_rows(encoded, negatives, label_cols, mask=mask), "item_id", s.validation_split, s.seed)
        train, validation = split.filter("split = 'train'"), split.filter("split = 'validation'")
        sizes = {a: self.mapping.sizes[a] for a in self.attributes}
        plan = {"learning_rate": s.learning_rate, "weight_decay": s.weight_decay, "mask_size": s.mask_size,
                "projection_units": s.projection_units, "embedding_units_per_attribute": s.embedding_units_per_attribute}
        fixed = {"dropout_rate": s.dropout_rate, "contrastive_temperature": s.contrastive_temp,
                 "contrastive_weight": s.contrastive_weight, "mini_batch_size": s.mini_batch_size}
        schedule = {"lr_reduce_patience": s.lr_reduce_patience, "lr_reduce_factor": s.lr_reduce_factor, "min_lr": s.min_lr}
        if tune_first:
            plan, self.trials = tune(
                train, validation, sizes, self.width, n_trials=n_trials, epochs_per_trial=s.epochs_tuning,
                batch_size=s.batch_size, seed=s.seed, fixed_mask_size=s.fixed_mask_size,
                early_stopping_patience=s.early_stopping_patience, shape_changes=fixed, **schedule, **training)
        plan = dict(plan)
        rate, decay = plan.pop("learning_rate"), plan.pop("weight_decay")
        shape = network_shape(sizes, self.width, **plan, **fixed)
        self.network, history = train_network(
            train, validation, Network.initial(shape, s.seed), epochs=s.epochs_final, learning_rate=rate,
            weight_decay=decay, batch_size=s.batch_size, seed=s.seed,
            early_stopping_patience=s.early_stopping_patience, **schedule, **training)
        self.history = history_frame(spark, history)
        self.hyperparameters = shape | {"learning_rate": rate, "weight_decay": decay}
        save_network(spark, self.network, model_path)

    def _score(self, rows: DataFrame, keep: list[str], refit: bool, extend: bool = False) -> DataFrame:
        names, units = self.attributes, self.network.shape["embedding_units_per_attribute"]
        scored = score(rows.withColumn("_full", F.col("embedding")), self.network, keep=["item_id", *keep, "_full"])
        combined = stage(scored.withColumn("interpretable", F.concat(*[F.col(a) for a in names])), "representations")
        if self.nuisance is None and not refit:
            raise RuntimeError("no fitted nuisance projection; use nuisance='refit'")
        if refit or extend:
            self.nuisance = fit_nuisance(combined, "interpretable", "_full", units * len(names), self.width, self.settings.num_nuisance_dims,
                                         self.settings.nuisance_method, known=self.nuisance if extend else None)
        return stage(self.nuisance.score(combined, "interpretable", "_full").select("item_id", *keep, *names, "nuisance"), "scored")

    def transform(self, items: DataFrame | None = None, item_id: str = "item_id", vector: str | None = "embedding",
                  text: str | None = None, make_encoder: Callable[[], encode.Encoder] | None = None,
                  nuisance: str = "refit") -> DataFrame:
        """``(item_id, representations.., nuisance)``: of the fitted items, or of new ones.

        ``nuisance="refit"`` fits the nuisance projection anew on the given rows;
        ``"project"`` uses the fitted one and is the choice for small batches; ``"extend"`` adds
        the rows to those it was fitted on and keeps the result, so that batches one after
        another give the projection of all of them.
        """
        if self.network is None:
            raise RuntimeError("fit or load first")
        if items is None:
            if self.scored is None:
                raise RuntimeError("a loaded model holds no fitted items")
            return self.scored.select("item_id", *self.attributes, "nuisance")
        if nuisance not in ("refit", "project", "extend"):
            raise ValueError(f"unknown nuisance mode {nuisance!r}")
        rows = self._with_vectors(items, item_id, vector, text, make_encoder)
        rows = rows.select(F.col(item_id).alias("item_id"), "embedding")
        fitted = self.nuisance
        self.width = self.network.shape["orig_size"]
        try:
            return self._score(rows, [], refit=nuisance == "refit", extend=nuisance == "extend")
        finally:
            if nuisance != "extend":
                self.nuisance = fitted or self.nuisance

    def elbow(self, spark: SparkSession) -> DataFrame:
        return elbow_table(spark, self.nuisance.spectrum.values)

    def export(
        self,
        output_dir: str | None = None,
        full_embeddings: DataFrame | None = None,
        embedding_backend: str | None = None,
        lexicon_table: DataFrame | None = None,
        texts: DataFrame | None = None,
        lexicon_components: int = 10,
        label_table: DataFrame | None = None,
        label_encoders: dict | None = None,
    ) -> dict[str, str]:
        """Write everything under ``output_dir``; returns name -> path, the manifest included.

        ``texts`` is ``(item_id, text)`` for lexicon controls, ``label_table`` is
        ``(item_id, region, varietal)`` for label vectors by the named encoders.
        """
        if self.scored is None:
            raise RuntimeError("fit first")
        if lexicon_table is not None and texts is None:
            raise ValueError("texts are needed for lexicon controls")
        if label_encoders and label_table is None:
            raise ValueError("a label table is needed for label vectors")
        spark, root = self.scored.sparkSession, (output_dir or self.output_dir).rstrip("/")
        backend = embedding_backend or self.settings.embedding_backend
        files, sums = {}, {}

        def table(name: str, df: DataFrame, path: str) -> None:
            files[name] = save_table(df, f"{root}/{path}")
            sums[name] = fingerprint(spark.read.parquet(files[name]))

        width = None
        if full_embeddings is not None:
            width = vector_width(full_embeddings, "embedding")
            table("full_embedding", full_embeddings, f"embeddings/full_embedding_{backend}_{width}")
        for name in [*self.attributes, "nuisance"]:
            table(f"{name}_embedding", self.scored.select("item_id", F.col(name).alias("embedding")), f"representations/{name}_embedding")
        files["model"] = save_network(spark, self.network, f"{root}/model")
        files["encoder"] = save_labels(self.mapping, f"{root}/metadata/encoder")
        files["hyperparameters"] = save_json(spark, self.hyperparameters, f"{root}/metadata/hyperparameters")
        files["config"] = self.settings.save(spark, f"{root}/metadata/config")
        table("classification_metrics", self.metrics, "metadata/classification_metrics")
        manifest = {
            "attributes": self.attributes, "n_samples": sums["nuisance_embedding"]["rows"],
            "embedding_dim_per_attribute": self.network.shape["embedding_units_per_attribute"],
            "num_nuisance_dims": self.settings.num_nuisance_dims, "embedding_backend": backend, "full_embedding_dim": width,
            "embedding_model": self.settings.embedding_model, "embedding_dim": self.settings.embedding_dim,
            # One row per attribute.
            "classification_metrics": {r["attribute"]: r.asDict() for r in self.metrics.collect()},
        }
        if lexicon_table is not None:
            controls, fit = lexicon.lexicon_controls(texts, "item_id", "text", lexicon_table, lexicon_components)
            table("lexicon_controls", controls, "representations/lexicon_controls")
            files["lexicon_diagnostics"] = save_json(spark, fit.diagnostics, f"{root}/metadata/lexicon_diagnostics")
            manifest["lexicon"] = {k: fit.diagnostics[k] for k in ("n_components", "n_categories", "total_explained_variance", "explained_variance_ratio")}
        for name, df in (labelvectors.baselines(label_table, "region", "varietal", label_encoders) if label_encoders else {}).items():
            files |= save_label_vectors(df, name, root, label_encoders[name][1])
        manifest |= {"files": files, "tables": sums}
        files["manifest"] = save_json(spark, manifest, f"{root}/metadata/manifest")
        return files

    def save(self, spark: SparkSession, path: str | None = None) -> str:
        """Network, and where fitted also the nuisance projection and the labels."""
        if self.network is None:
            raise RuntimeError("fit first")
        path = path or f"{self.output_dir}/model"
        save_network(spark, self.network, path)
        if self.mapping is not None:
            save_labels(self.mapping, f"{path}/labels")
        if self.nuisance is not None:
            save_json(spark, nuisance_to_dict(self.nuisance), f"{path}/nuisance")
            root = self.nuisance.projection.root
            if root is not None:
                rows = spark.createDataFrame(list(enumerate(root.tolist())), "row int, entries array<double>")
                save_table(rows, f"{path}/nuisance_factor")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, output_dir: str | None = None, settings: Settings | None = None) -> FacetModel:
        from facetry.sources.readers import load_labels

        network = load_network(spark, path)
        model = cls(network.shape["attribute_names"], output_dir or path, settings)
        model.network, model.hyperparameters, model.width = network, dict(network.shape), network.shape["orig_size"]
        if exists(spark, f"{path}/labels"):
            model.mapping = load_labels(spark, f"{path}/labels")
        if exists(spark, f"{path}/nuisance"):
            model.nuisance = nuisance_from_dict(read_json(spark, f"{path}/nuisance"))
            if exists(spark, f"{path}/nuisance_factor"):
                rows = spark.read.parquet(f"{path}/nuisance_factor").orderBy("row").collect()  # as many as columns
                model.nuisance.projection.root = np.array([r["entries"] for r in rows])
        return model


def nuisance_to_dict(fit: Nuisance) -> dict:
    p, sp = fit.projection, fit.spectrum
    return {"coefficients": p.coefficients.tolist(), "total_squares": p.total_squares, "n": p.n,
            "loadings": sp.loadings.tolist(), "values": sp.values.tolist(), "dims": fit.dims, "diagnostics": fit.diagnostics}


def nuisance_from_dict(saved: dict) -> Nuisance:
    spec = Spectrum(np.array(saved["loadings"]), np.array(saved["values"]))
    root = spec.values[:, None] * spec.loadings.T  # of the kept components
    fit = Projection(np.array(saved["coefficients"]), root, saved["total_squares"], saved["n"])
    return Nuisance(fit, spec, saved["dims"], saved["diagnostics"])


def classification_metrics(rows: DataFrame, network: Network, vector: str = "embedding", split: str | None = None) -> DataFrame:
    """Metrics of the network on all given rows, or those of a ``split``; labels in ``<attribute>_idx``.

    A row without a valid vector counts as one of zeros, as it does among the samples.
    """
    names, width = network.shape["attribute_names"], network.shape["orig_size"]
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    zeros = F.array_repeat(F.lit(0.0), width).cast(rows.schema[vector].dataType)
    filled = rows.withColumn(vector, F.when(vectors.valid(F.col(vector), width), F.col(vector)).otherwise(zeros))
    scored = score(filled, network, vector, keep=[f"{a}_idx" for a in names], with_logits=True)
    sides = [metrics.ranked_predictions(scored, a, f"{a}_idx", f"{a}_logits") for a in names]
    return metrics.attribute_metrics(reduce(DataFrame.unionByName, sides))


def save_label_vectors(df: DataFrame, name: str, root: str, width: int) -> dict[str, str]:
    """``baselines/<name>/``: region, varietal and combined vectors with a description."""
    spark, files = df.sparkSession, {}
    for kind in ("region", "varietal", "combined"):
        path = f"{root}/baselines/{name}/{name}_{kind}"
        files[f"{name}_{kind}"] = save_table(df.select("item_id", F.col(kind).alias("embedding")), path)
    config = {"model_type": name, "embedding_dim": width, "combined_dim": 2 * width,
              "n_samples": spark.read.parquet(files[f"{name}_region"]).count()}
    files[f"{name}_config"] = save_json(spark, config, f"{root}/baselines/{name}/{name}_config")
    return files


def describe(files: dict[str, str]) -> str:
    return json.dumps(files, indent=2)
