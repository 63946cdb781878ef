"""Run queries next to their SQL and compare rows, column names and values.

    python tests/compare.py 0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = rows_of(names, found.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    kinds = [(c, type(g), type(e)) for c, g, e in zip(sorted(names), got[0], expected[0]) if got and type(g) is not type(e)] if got else []
    return f"types {kinds}" if kinds else None


def main() -> None:
    from facetry.plans.catalog import QUERIES
    from facetry.plans.oracles import SQL
    from pyspark.sql import SparkSession

    folder = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                problem = difference(df, con, SQL[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4} {name:32} {time.time() - start:6.2f}s {'' if name in SQL else '(no SQL)'} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("missing queries:", sorted(set(SQL) - set(QUERIES)), "bad:", bad)


if __name__ == "__main__":
    main()
