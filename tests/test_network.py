import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetry.operators import network as nn
from facetry.operators.network import Network, network_shape
from facetry.operators import training, tuning
from facetry.sources import readers, writers

SIZES = {"a": 3, "b": 4}


def small(**changes):
    shape = nn.network_shape(SIZES, 6, projection_units=5, embedding_units_per_attribute=2, mini_batch_size=4, dropout_rate=0.0, **changes)
    return nn.Network.initial(shape, 1)


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 4, 6)), {a: rng.integers(0, k, n) for a, k in SIZES.items()}


def rows(spark, n, seed=0):
    cells, labels = sample(n, seed)
    data = [(i, int(labels["a"][i]), int(labels["b"][i]), cells[i].tolist()) for i in range(n)]
    return spark.createDataFrame(data, "item_id long, a_idx int, b_idx int, cells array<array<double>>")


def test_erf_and_mask():
    x = np.linspace(-7, 7, 9999)
    assert np.abs(nn.erf(x) - [math.erf(v) for v in x]).max() < 1e-13
    assert nn.network_shape(SIZES, 6)["mask_size"] == 6


def test_gradient_by_finite_differences():
    net = small(contrastive_weight=0.7, contrastive_temperature=0.3)
    cells, labels = sample(7)
    _, grad = net.losses(cells, labels)
    flat = net.flat()
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (net.with_flat(flat + s).losses(cells, labels, slopes=False)[0]["total"] for s in (step, -step))
        assert math.isclose((up - down) / 2e-6, grad[i], rel_tol=1e-5, abs_tol=1e-6)


def test_dropout_keeps_the_mean():
    net = small()
    net.shape["dropout_rate"] = 0.5
    x = np.random.default_rng(1).normal(size=(20000, 6))
    dropped = net.encode(x, np.random.default_rng(2))["h1"]
    assert np.allclose(dropped.mean(0), net.encode(x)["h1"].mean(0), atol=0.02)


def test_score_nulls_and_round_trip(spark, tmp_path):
    net = small()
    x = np.random.default_rng(4).normal(size=6)
    data = [(0, x.tolist()), (1, None), (2, [float("nan")] * 6), (3, x[:3].tolist())]
    df = spark.createDataFrame(data, "item_id long, embedding array<double>")
    got = {r.item_id: r for r in nn.score(df, net, with_logits=True).collect()}
    want = net.representations(x[None])
    assert np.allclose(got[0].a, want["a"][0]) and np.allclose(got[0].b_logits, net.logits(want)["b"][0])
    assert all(got[i].a is None and got[i].b_logits is None for i in (1, 2, 3))
    back = readers.load_network(spark, writers.save_network(spark, net, str(tmp_path / "net")))
    assert np.allclose(back.flat(), net.flat()) and back.shape == net.shape
    net.to_frame(spark).write.parquet(str(tmp_path / "bare" / "weights"))
    with pytest.raises(ValueError):
        readers.load_network(spark, str(tmp_path / "bare"))
    assert readers.load_network(spark, str(tmp_path / "bare"), net.shape).shape == net.shape


@pytest.mark.parametrize("shards", [1, 5])
def test_gradient_step_equals_one_process(spark, shards):
    net = small()
    cells, labels = sample(50)
    placed = training.place(rows(spark, 50), ["a", "b"], 6, 4, shards=shards)
    state, losses = training.train_epoch(placed, net, training.AdamW.start(net), 0.01, 0.1, 8, 0, 0, "gradient")
    sums, grad = net.losses(cells, labels)
    own = training.AdamW.start(net)
    own.step(grad / 50, 0.01, 0.1)
    assert np.allclose(state.weights, own.weights, atol=1e-10) and math.isclose(losses["total"], sums["total"] / 50)
    seen = training.evaluate(placed, net)
    assert math.isclose(seen["contrastive"], sums["contrastive"] / 50) and math.isclose(seen["a_acc"], sums["a_correct"] / 50)
    placed.unpersist()


def test_training_lowers_the_loss_and_repeats(spark):
    data = rows(spark, 120)
    run = lambda: training.train_network(data, data, small(), epochs=6, learning_rate=0.01, shards=3, seed=5)
    best, history = run()
    again, _ = run()
    assert history[-1]["val_loss"] < history[0]["val_loss"] and len(history) == 6
    assert np.allclose(best.flat(), again.flat())
    frame = training.history_frame(spark, history)
    assert frame.columns == ["epoch", "train_loss", "val_loss", "learning_rate", "val_a_acc", "val_b_acc"]


def test_early_stopping_returns_the_best(spark):
    data = rows(spark, 20)
    saved = []
    best, history = training.train_network(data, data, small(), epochs=50, learning_rate=2.0, early_stopping_patience=2,
                                           start_from_epoch=3, shards=1, sync="gradient", on_improvement=saved.append)
    assert len(history) < 50
    placed = training.place(data, ["a", "b"], 6, 4, shards=1)
    assert math.isclose(training.evaluate(placed, best)["total"], min(h["val_loss"] for h in history))
    with pytest.raises(ValueError, match="sync"):
        training.train_network(data, data, small(), epochs=1, sync="other")


def test_plateau():
    plateau = training.Plateau(1.0, 0.5, 2, 0.2)
    for loss in [5, 5, 5, 5, 5, 5, 5, 5, 5, 5]:
        plateau.update(loss)
    assert plateau.rate == 0.2


def test_training_rows_follow_slots_and_skip_zero_anchors(spark):
    items = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 0, [2.0, 2.0]), (2, 0, [0.0, 0.0]), (3, 1, None)], "item_id long, a_idx int, embedding array<float>")
    negatives = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 2), (2, 1, 0), (3, 0, None), (3, 1, None)], "item_id long, pos int, neg_id long")
    found = {r.item_id: r.cells for r in training.training_rows(items, negatives, ["a_idx"]).collect()}
    assert found == {0: [[1.0, 0.0], [2.0, 2.0]], 1: [[2.0, 2.0], [1.0, 0.0]]}


def test_search_space(spark):
    assert tuning.mask_choices(768) == [128, 256, 512, 768] and tuning.mask_choices(64) == [64]
    assert tuning.mask_choices(3072)[-1] == 3072 and tuning.mask_choices(768, 300) == [300]
    trials = tuning.draw_trials(200, 3072, seed=3)
    assert trials == tuning.draw_trials(200, 3072, seed=3)
    assert {t["projection_units"] for t in trials} == set(range(64, 129, 8))
    assert all(1e-4 <= t["learning_rate"] <= 1e-2 and 1e-4 <= t["weight_decay"] <= 1e-1 for t in trials)
    table = spark.createDataFrame([(0, 2.0, '{"x": 0}'), (1, 1.0, '{"x": 1}')], "trial int, val_loss double, params string")
    assert tuning.best_trial(table) == {"x": 1}


def test_parallel_trials(spark):
    data = rows(spark, 40)
    best, trials = tuning.tune(data, data, SIZES, 6, mini_batch_size=4, n_trials=2, epochs_per_trial=1, parallel_trials=2, shards=2)
    assert trials.count() == 2 and best["mask_size"] == 6
    assert trials.filter(F.col("val_loss") > 0).count() == 2


def test_minibatches_do_not_depend_on_arrow_batches(spark):
    data = rows(spark, 130)
    found = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for sync in ("weights", "gradient"):
            best, history = training.train_network(data.repartition(int(size) % 5 + 1), data, small(), epochs=2, learning_rate=0.01, shards=3, sync=sync)
            found.append((best.flat(), history))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for (one, history), (other, again) in zip(found[:2], found[2:]):
        assert np.array_equal(one, other) and [h["train_loss"] for h in history] == [h["train_loss"] for h in again]


def test_a_large_batch_is_widened_in_parts():
    """The rows of a batch are not all made double at once, and minibatches are the same whatever the batches."""
    n, layout = 20_000, training.Layout(["a"], 2, 32)
    cells = pa.array(np.random.default_rng(0).normal(size=(n, 64)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    whole = pa.RecordBatch.from_arrays([cells, pa.array(range(n), pa.int32())], names=["cells", "_a"])
    tracemalloc.start()
    cut = [(len(x), int(y["a"][0])) for x, y in layout.batches(iter([whole]), 24, 16)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * 64 * 8 / 3
    assert cut == [(min(24, n - at), at) for at in range(0, n, 24)]
    parts = [whole.slice(at, 777) for at in range(0, n, 777)]
    both = zip(layout.batches(iter([whole]), 1500, 16), layout.batches(iter(parts), 1500, 16), strict=True)
    assert all(np.array_equal(x, u) and np.array_equal(y["a"], v["a"]) for (x, y), (u, v) in both)


def test_every_epoch_has_another_order(spark):
    placed = training.place(rows(spark, 60), ["a", "b"], 6, 4, shards=3)
    first, again, second = (placed.permuted(1, e).collect() for e in (0, 0, 1))
    assert first == again != second and sorted(map(str, first)) == sorted(map(str, second))
    placed.unpersist()


def same(one, other):
    """Histories but for the order in which losses were added up."""
    return len(one) == len(other) and all(a.keys() == b.keys() and np.allclose(list(a.values()), list(b.values()), rtol=1e-12) for a, b in zip(one, other))


def test_an_ended_run_continues(spark, tmp_path):
    data, path = rows(spark, 60), str(tmp_path / "state")
    run = lambda epochs, **more: training.train_network(data, data, small(), epochs=epochs, learning_rate=0.01, shards=2, seed=5, **more)
    best, history = run(5)
    run(2, state_path=path)
    (tmp_path / "state" / "epoch-000002" / "_temporary").mkdir(parents=True)  # ended while writing the third state
    again, resumed = run(5, state_path=path)
    assert same(resumed, history) and np.array_equal(best.flat(), again.flat())
    assert run(5, state_path=path)[1] == resumed
    with pytest.raises(ValueError, match="another training"):
        run(6, state_path=path, batch_size=9)


def test_early_stop_is_kept(spark, tmp_path):
    data, path = rows(spark, 20), str(tmp_path / "state")
    run = lambda epochs: training.train_network(data, data, small(), epochs=epochs, learning_rate=2.0, early_stopping_patience=2, start_from_epoch=1, shards=1, sync="gradient", state_path=path)[1]
    stopped = run(30)
    assert len(stopped) < 30 and run(30) == stopped


def test_successive_halving(spark, tmp_path):
    assert tuning.rungs(75, 50, 3) == [(75, 1), (25, 2), (8, 6), (2, 17), (1, 50)]
    assert tuning.rungs(4, 2, 3) == [(4, 1), (1, 2)] and tuning.rungs(5, 7, None) == [(5, 7)] and tuning.rungs(1, 7, 3) == [(1, 7)]
    data, path = rows(spark, 40), str(tmp_path / "search")
    args = dict(mini_batch_size=4, n_trials=4, epochs_per_trial=3, shards=2, seed=1)
    best, trials = tuning.tune(data, data, SIZES, 6, **args, state_path=path)
    found = {r.trial: r for r in trials.collect()}
    assert sorted(r.epochs for r in found.values()) == [1, 1, 1, 3]
    last = next(r for r in found.values() if r.epochs == 3)
    # The one that is left has the loss of training it alone, and a search that goes on finds the same.
    params = tuning.draw_trials(4, 6, seed=1)[last.trial]
    optimiser = {k: params.pop(k) for k in ("learning_rate", "weight_decay")}
    net = Network.initial(network_shape(SIZES, 6, **(params | {"mini_batch_size": 4})), 1)
    _, history = training.train_network(data, data, net, epochs=3, batch_size=8, seed=1, shards=2, **optimiser)
    assert math.isclose(min(h["val_loss"] for h in history), last.val_loss, rel_tol=1e-12)
    assert sorted(tuning.tune(data, data, SIZES, 6, **args, state_path=path)[1].collect()) == sorted(trials.collect())
