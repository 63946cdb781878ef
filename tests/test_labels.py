import pytest

from facetry.operators.labels import LabelMapping, fit_labels
from facetry.sources import readers, writers


def frame(spark, labels):
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "item_id long, v string")


def test_order_null_and_unicode(spark):
    mapping = fit_labels(frame(spark, ["b", None, "É", "a", "Z", "", "b"]), {"v": "v"})
    found = [r.label for r in mapping.of("v").orderBy("idx").collect()]
    assert found == sorted({"b", "", "É", "a", "Z"}) and mapping.sizes == {"v": 5}


def test_null_label_override(spark):
    df = frame(spark, ["a", None])
    mapping = fit_labels(df, {"v": "v"}, null_label="None")
    assert [r.label for r in mapping.of("v").orderBy("idx").collect()] == ["None", "a"]
    assert {r.v_idx for r in mapping.transform(df, {"v": "v"}, null_label="None").collect()} == {0, 1}


def test_unseen_label(spark):
    mapping = fit_labels(frame(spark, ["a", "b"]), {"v": "v"})
    new = frame(spark, ["a", "nova"])
    with pytest.raises(Exception, match="unseen v label: nova"):
        mapping.transform(new, {"v": "v"}).collect()
    assert [r.v_idx for r in mapping.transform(new, {"v": "v"}, on_unknown="null").orderBy("item_id").collect()] == [0, None]


def test_shuffled_mapping_gives_the_same(spark):
    df = frame(spark, [str(i % 7) for i in range(100)])
    mapping = fit_labels(df, {"v": "v"})
    large = LabelMapping(mapping.table)
    large.__dict__["small"] = False
    pick = lambda m: sorted((r.item_id, r.v_idx) for r in m.transform(df, {"v": "v"}, spread_by="item_id").collect())
    assert pick(mapping) == pick(large)


def test_round_trip_and_errors(spark, tmp_path):
    mapping = fit_labels(frame(spark, ["x", "y"]), {"v": "v"})
    path = writers.save_labels(mapping, str(tmp_path / "labels"))
    back = readers.load_labels(spark, path)
    assert sorted(back.table.collect()) == sorted(mapping.table.collect())
    coded = back.class_names(mapping.transform(frame(spark, ["y"]), {"v": "v"}), {"v": "v_idx"})
    assert coded.first().v_name == "y"
    with pytest.raises(RuntimeError):
        writers.save_labels(None, str(tmp_path / "none"))
