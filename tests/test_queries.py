"""Every query with SQL gives DuckDB's rows; every other one runs."""

import duckdb
import numpy as np
import pytest

from tests.duck import connected, rows
from wristloom.plans import epoch_queries, label_queries, signal_queries, stream_queries, study_queries

SF = "/root/testdata/sf0.001"
PLANS = (epoch_queries, signal_queries, label_queries, study_queries, stream_queries)
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
SQL = {k: v for p in PLANS for k, v in p.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_deviations_of_exactly_a_limit(spark, tmp_path):
    """Pairs 25 lines of quantity apart deviate by 0.5 exactly, or by a bit less in doubles: as values come in the table's order."""
    rng = np.random.default_rng(0)
    lines = []
    for device in range(400):
        low = int(rng.integers(1, 26))
        some = [low, low + 25] * int(rng.integers(1, 4))
        lines += [(1000 * device + k, device, k, float(q), 0.05, 0.04) for k, q in enumerate(rng.permutation(some).tolist())]
    lines += [(500_000, 1, 1, None, 0.05, 0.04), (501_000, 1, 1, 5.0, 0.05, 0.04), (501_001, 1, 1, None, 0.05, 0.04)]
    lines = [lines[k] for k in rng.permutation(len(lines))]
    path = tmp_path / "lineitem.parquet"
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(str(path))
    con = duckdb.connect()
    con.execute("SET threads = 1")  # on more the SQL adds in an order of its own, too
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    got, want = QUERIES["stuck_and_still"](spark, str(tmp_path)).toArrow(), con.sql(SQL["stuck_and_still"]).to_arrow_table()
    assert rows(got) == rows(want)
    assert {True, False} <= set(got.column("still").to_pylist())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
