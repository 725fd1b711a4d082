"""Every latency query against its DuckDB SQL at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from rillscope.registry import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(x) if isinstance(x, (bool, int, float)) or hasattr(x, "dtype") else x

    return sorted(map(repr, df[sorted(df.columns)].map(plain).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(name, spark, con, small_dir):
    found = queries()[name](spark, small_dir).toPandas()
    expected = con.execute(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(name, spark, small_dir):
    df = queries()[name](spark, small_dir)
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_overlap_scores_without_shared_time(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT i * 2 + k AS event_id, TIMESTAMP '2024-01-01' + to_minutes(15 * i) AS ts, i AS user_id, ['click', 'view'][k + 1] AS event_type,
      CASE WHEN k = 0 AND i >= 80 THEN 20.0 ELSE 5.0 + i % 3 END::DOUBLE AS value, '{{}}' AS props FROM range(240) a(i), range(2) b(k)) TO '{tmp_path}/events.parquet'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = c.execute(oracle_sql()["overlap_scores"]).fetchall()
    assert expected == [(None, None, None)]
    assert [tuple(r) for r in queries()["overlap_scores"](spark, str(tmp_path)).collect()] == expected
