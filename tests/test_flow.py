import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators.encode import HashingEncoder
from facetry.plans import baseline, job
from facetry.plans.estimator import FacetModel
from facetry.plans.settings import Settings
from facetry.sources import readers, writers
from facetry.streaming.scoring import score_rows, write_scores


hashing = lambda: HashingEncoder(24)  # travels to the workers by value


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"text number {i % 37} with {' '.join('abcdefgh'[j] for j in rng.integers(0, 8, 5))}", "nsew"[i % 4], str(i % 3), "x") for i in range(90)]
    return spark.createDataFrame(rows, "item_id long, text string, region string, kind string, country string").cache()


@pytest.fixture(scope="module")
def model(spark, items, tmp_path_factory):
    settings = Settings(epochs_final=2, epochs_tuning=1, projection_units=8, embedding_units_per_attribute=3)
    out = FacetModel(["region", "kind"], str(tmp_path_factory.mktemp("model")), settings)
    with pytest.warns(UserWarning):
        return out.fit(items, vector=None, text="text", make_encoder=hashing, n_trials=1, shards=2)


def test_fit_transform(model, spark):
    rows = model.transform().collect()
    width = model.network.shape["embedding_units_per_attribute"]
    assert len(rows) == 90 and all(len(r.region) == width and len(r.nuisance) == 5 for r in rows)
    assert {r.attribute for r in model.metrics.collect()} == {"region", "kind"}
    assert model.trials.count() == 1 and model.history.count() == 2 and model.elbow(spark).count() > 5


def test_save_load_project_and_refit(model, spark, items, tmp_path):
    path = model.save(spark, str(tmp_path / "saved"))
    loaded = FacetModel.load(spark, path)
    fitted = {r.item_id: r for r in model.transform().collect()}
    for mode in ("project", "refit"):
        with pytest.warns(UserWarning) if mode == "refit" else _nothing():
            again = loaded.transform(items, vector=None, text="text", make_encoder=hashing, nuisance=mode)
        got = {r.item_id: r for r in again.collect()}
        assert all(np.allclose(got[i].region, fitted[i].region) and np.allclose(got[i].nuisance, fitted[i].nuisance, atol=1e-5) for i in fitted)
    with pytest.raises(RuntimeError):
        loaded.transform()
    with pytest.raises(RuntimeError):
        loaded.export()
    with pytest.raises(ValueError):
        loaded.transform(items)


def test_extend(model, spark, items, tmp_path):
    """The same rows once more: twice as many, the same directions; also for a model that was saved and loaded."""
    loaded = FacetModel.load(spark, model.save(spark, str(tmp_path / "saved")))
    before = loaded.nuisance
    with pytest.warns(UserWarning):
        scored = loaded.transform(items, vector=None, text="text", make_encoder=hashing, nuisance="extend")
    assert loaded.nuisance.projection.n == 2 * before.projection.n and scored.count() == 90
    assert np.allclose(loaded.nuisance.spectrum.values, np.sqrt(2) * before.spectrum.values)
    assert np.allclose(loaded.nuisance.projection.coefficients, before.projection.coefficients, atol=1e-6)


class _nothing:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_unfitted(spark, tmp_path):
    fresh = FacetModel(["a"], str(tmp_path))
    assert fresh.attributes == ["a"] and fresh.network is None
    for call in (fresh.transform, fresh.export, lambda: fresh.save(spark)):
        with pytest.raises(RuntimeError):
            call()


def test_stream_equals_batch(model, spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    model.vectors.select("item_id", "embedding").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("item_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    write_scores(score_rows(stream, model.network, model.nuisance), out, str(tmp_path / "log"), once=True).awaitTermination()
    streamed = {r.item_id: r for r in spark.read.parquet(out).collect()}
    for r in model.transform().collect():
        assert np.allclose(streamed[r.item_id].region, r.region) and np.allclose(streamed[r.item_id].nuisance, r.nuisance)


def test_export(model, spark, items, tmp_path):
    words = spark.createDataFrame([("x", "text"), ("y", "a"), ("y", "b"), ("z", "c")], "category string, term string")
    labels = items.select("item_id", F.col("region"), F.col("kind").alias("varietal"))
    files = model.export(str(tmp_path), full_embeddings=model.vectors.select("item_id", "embedding"), lexicon_table=words,
                         texts=items.select("item_id", "text"), lexicon_components=2, label_table=labels, label_encoders={"toy": (hashing, 24)})
    manifest = readers.read_json(spark, files["manifest"])
    assert manifest["n_samples"] == 90 and manifest["full_embedding_dim"] == 24 and manifest["lexicon"]["n_categories"] == 3
    assert manifest["tables"]["region_embedding"]["rows"] == 90
    assert writers.fingerprint(spark.read.parquet(files["nuisance_embedding"])) == manifest["tables"]["nuisance_embedding"]
    assert spark.read.parquet(files["toy_combined"]).count() == 90
    assert readers.load_labels(spark, files["encoder"]).sizes == {"kind": 3, "region": 4}
    with pytest.raises(ValueError):
        model.export(str(tmp_path), lexicon_table=words)
    with pytest.raises(ValueError):
        model.export(str(tmp_path), label_encoders={"toy": (hashing, 24)})


def test_cached_model_is_used(model, spark, items):
    again = FacetModel(["region", "kind"], model.output_dir, model.settings.with_changes(num_nuisance_dims=4))
    again.fit(items, vector=None, text="text", make_encoder=hashing)
    assert again.history is None and np.allclose(again.network.flat(), model.network.flat())


def test_model_of_other_labels_is_not_used(model, spark, items):
    """As many labels, but others: the names have changed."""
    renamed = items.withColumn("kind", F.concat(F.lit("other "), "kind"))
    again = FacetModel(["region", "kind"], model.output_dir + "-copy", model.settings)
    with pytest.warns(UserWarning, match="other labels"):
        again.fit(renamed, vector=None, text="text", make_encoder=hashing, tune_first=False, shards=2, cached_model_path=copied(spark, model))
    assert again.history is not None


def copied(spark, model):
    path = f"{model.output_dir}-copied"
    for name in ("weights", "made_with", "shape"):
        source = f"{model.output_dir}/model/{name}"
        (spark.read.parquet(source).write.parquet if name == "weights" else spark.read.text(source, wholetext=True).coalesce(1).write.text)(f"{path}/{name}")
    return path


def test_job(spark, items, tmp_path):
    data, vectors, out = (str(tmp_path / n) for n in ("items.parquet", "vectors.parquet", "out"))
    items.write.parquet(data)
    rows = [(r.item_id, [float(x) for x in hashing()([r.text])[0]]) for r in items.collect()]
    spark.createDataFrame(rows, "item_id long, embedding array<float>").write.parquet(vectors)
    args = job.parser().parse_args(["run", "-d", data, "--id-col", "item_id", "--description-col", "text", "-a", "where:region", "kind",
                                    "-e", vectors, "-o", out, "--skip-tuning", "--preset", "quick"])
    quick, Settings.quick = Settings.quick, classmethod(lambda cls: cls(epochs_final=1, num_nuisance_dims=2))
    try:
        files = job.run(spark, args)
    finally:
        Settings.quick = quick
    distinct = items.select("text").distinct().count()
    assert spark.read.parquet(files["where_embedding"]).count() == distinct
    with pytest.raises(SystemExit):  # a command is required
        job.main([])


def test_linear_baseline(spark, items, tmp_path):
    vectors = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(90)], "item_id long, embedding array<float>")
    fit, files = baseline.run_baseline(items, vectors, "item_id", "text", ["country", "region"], "kind", str(tmp_path), n_nuisance_dims=2)
    config = readers.read_json(spark, files["config"])
    assert config["design_matrix_cols"] == 7 and len(config["singular_values"]) == 2
    assert spark.read.parquet(files["attribute_embedding"]).count() == fit.n


def test_settings(spark, tmp_path):
    s = Settings()
    assert (s.contrastive_temp, s.contrastive_weight, s.embedding_backend, s.embedding_dim) == (0.1, 0.1, "openai", 3072)
    assert [getattr(Settings, n)().epochs_final for n in ("quick", "standard", "thorough")] == [50, 200, 1000]
    assert Settings.for_gemma().embedding_dim == 768
    path = Settings.quick().save(spark, str(tmp_path / "s"))
    assert Settings.load(spark, path) == Settings.quick()
    writers.save_json(spark, {"seed": 5, "unknown": 1}, path)
    assert Settings.load(spark, path).seed == 5


def test_readers(spark, tmp_path):
    text = tmp_path / "items.csv"
    text.write_text('Unnamed: 0,description,region\n0,"two\nlines, ""quoted""",NA\n1,,b\n2, padded ,c\n', encoding="utf-8")
    rows = readers.load_items(spark, str(text)).collect()
    assert [(r.description, r.region) for r in rows] == [('two\nlines, "quoted"', None), (None, "b"), (" padded ", "c")]
    import gzip

    (tmp_path / "items.csv.gz").write_bytes(gzip.compress(text.read_bytes()))
    assert readers.load_items(spark, str(tmp_path / "items.csv.gz"), "i int, description string, region string").first().i == 0
    with pytest.raises(FileNotFoundError):
        readers.load_items(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        readers.load_items(spark, str(tmp_path / "items.txt"))
    spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        readers.load_vectors(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        readers.load_negatives(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        readers.load_labels(spark, str(tmp_path / "v"))
    assert json.dumps(readers.read_json(spark, writers.save_json(spark, {"é": [1]}, str(tmp_path / "j")))) == json.dumps({"é": [1]})


def test_scratch_folder_follows_the_session(spark):
    import os

    from facetry.session import clear_scratch, scratch_root, stage

    stage(spark.range(3), "probe")
    run = spark.sparkContext._facetry_run
    assert run.startswith(scratch_root(spark))
    # On its own run folder only: other tests keep theirs.
    del spark.sparkContext._facetry_run
    probe = stage(spark.range(3), "probe")
    assert probe.count() == 3
    own = spark.sparkContext._facetry_run.removeprefix("file:")
    assert os.path.isdir(own)
    clear_scratch(spark)
    assert not os.path.isdir(own) and os.path.isdir(run.removeprefix("file:"))
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/scratch/"})
    assert scratch_root(named) == "/shared/scratch"
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(RuntimeError):
        scratch_root(cluster)
