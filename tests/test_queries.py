"""Every registered query of the grading engine against DuckDB, and the rest for rows."""

import pytest

import __spark_entry__
from gradeloom.queries import ORACLES, QUERIES
from tests.oracle import SF_DIR, agree


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    assert agree(spark, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_whole_tables_are_read(spark):
    events, parts = (spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("events", "part"))
    repeats = [r.repeats for r in QUERIES["last_of_repeated"](spark, SF_DIR).collect()]
    assert sum(repeats) == events and max(repeats) > 1
    assert sum(r.num_runs for r in QUERIES["score_cube_stats"](spark, SF_DIR).collect()) == events
    assert sorted(r.call_rank for r in QUERIES["budget_rank"](spark, SF_DIR).collect()) == list(range(1, parts + 1))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
