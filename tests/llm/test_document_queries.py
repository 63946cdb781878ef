"""Queries of the document operators that have SQL, at the smallest scale."""

import pytest
from compare import connect, difference

from facetry.llm.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


def test_all_operators_have_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pipeline"}))
def test_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns[0] in ("doc_id", "page_id", "vec_id", "lang") and df.count() > 0
