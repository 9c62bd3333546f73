"""Every registered query against its SQL, and the plans they run as."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from gaugeflow.plans import catalog  # noqa: E402

# The corpus queries, where they are present, have tests of their own.
QUERIES = {name: run for name, run in entry.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for table in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, db, name):
    result = QUERIES[name](spark, small)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert _sorted(result.columns, result.collect()) == _sorted(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) == set(catalog.QUERIES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["layered_anomalies", "ewma_anomalies", "window_metrics_1m"])
def test_one_shuffle(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert plan.count("Exchange") == 1, plan


def test_top_k_without_a_full_sort(spark, small):
    plan = _plan(QUERIES["recent_events_filtered"](spark, small))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = _plan(QUERIES["events_of_type"](spark, small))
    assert "EqualTo(event_type,error)" in plan
    plan = _plan(QUERIES["window_metrics_1m"](spark, small))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    for name in ("windows_in_progress", "windows_retained"):
        assert "GreaterThanOrEqual(ts," in _plan(QUERIES[name](spark, small))
    assert "LessThan(ts," in _plan(QUERIES["windows_completed"](spark, small))
    plan = _plan(QUERIES["active_sensors"](spark, small))
    assert "GreaterThan(ts," in plan


def test_latest_row_is_limited_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in _plan(QUERIES["sensor_directory"](spark, small))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
