"""Every registered query that has SQL against DuckDB on the small tables, and the others for shape."""

import math
import os

import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain():
    from tomeloom import plans

    return plans


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(same(x) for x in v)
    return v


def rows_of(rows, columns):
    order = sorted(columns)
    return sorted((tuple(str(same(r[columns.index(c)])) for c in order) for r in rows))


@pytest.mark.parametrize("name", sorted(_plain().SQL))
def test_equals_sql(spark, sf, duck, name):
    plans = _plain()
    df = plans.QUERIES[name](spark, sf)
    result = duck.execute(plans.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(_plain().QUERIES) - set(_plain().SQL)))
def test_runs(spark, sf, name):
    assert _plain().QUERIES[name](spark, sf).count() > 0


def test_embeddings_of_odd_conversations_equal_their_sql(spark, tmp_path):
    """Words whose signs cancel, no words, no text, and turns beyond the thousand that a chunk's id has room for."""
    import duckdb

    texts = ["Die berß iegeß keit.", "?!", None, "one two", None, "one two", "", "one two"]
    rows = [(i % 3, 990 * i, "user", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    plans = _plain()
    want = con.execute(plans.SQL["k5_embeddings"])
    columns = [c[0] for c in want.description]
    got = plans.QUERIES["k5_embeddings"](spark, str(tmp_path))
    assert rows_of([tuple(r) for r in got.select(columns).collect()], columns) == rows_of([(a, b, float(c), d) for a, b, c, d in want.fetchall()], columns)
