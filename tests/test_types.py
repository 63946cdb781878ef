"""Types of CSV columns and sketches of attributes."""

import pytest

from facetry.operators import clean
from facetry.sources import readers


def test_types(spark):
    columns = {
        "whole": ["1", "-2", None, "007"], "broken": ["1", "2.5", ".5", "-1e3"], "flag": ["True", "false", None, "TRUE"],
        "day": ["2020-01-31", None, "1999-12-01", "2020-02-29"], "no_day": ["2020-02-30", "2020-01-01", None, None], "mixed": ["1", "true", None, None],
        "large": ["9223372036854775808", "1", "1", "1"], "text": ["a", "1", None, ""], "none": [None] * 4, "a.b": ["1", "2", "3", "4"],
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    assert readers.infer_types(df) == {
        "whole": "bigint", "broken": "double", "flag": "boolean", "day": "date", "no_day": "string", "mixed": "string", "large": "string",
        "text": "string", "none": "string", "a.b": "bigint"}


def test_typed_file(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('id,name,"a.b",day\n1,"x, y",2.5,2020-01-01\n2,NA,,NA\n3,"two\nlines",1,2021-01-01\n')
    df = readers.load_items(spark, str(path), infer=True)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("a.b", "double"), ("day", "date")]
    assert [r.name for r in df.orderBy("id").collect()] == ["x, y", None, "two\nlines"]
    assert readers.load_items(spark, str(path)).dtypes[0] == ("id", "string")
    assert readers.load_items(spark, str(path), multi_line=False).count() == 4


@pytest.mark.parametrize("parts", [1, 3])
def test_sketches_add_up(spark, parts):
    rows = [(i, i % 700, None if i % 3 else f"v{i}") for i in range(9_000)]
    df = spark.createDataFrame(rows, "i int, few int, text string")
    tables = [df.filter(f"i % {parts} = {p}") for p in range(parts)]
    merged = clean.merge_sketches(*[clean.sketch_attributes(t, ["few", "text", "i"]) for t in tables])
    found = {r.attribute: r for r in clean.summarise_sketches(merged).collect()}
    for name, exact, missing in (("few", 700, 0), ("text", 3000, 6000), ("i", 9000, 0)):
        assert found[name].n_rows == 9000 and found[name].n_missing == missing
        assert abs(found[name].n_unique - exact) <= 4 * 1.04 / 64 * exact
    assert clean.summarise_sketches(clean.sketch_attributes(df.filter("false"), ["i"])).first().n_unique == 0
