"""Runs a registered query and its SQL on the driver's smallest tables and compares the rows."""

from __future__ import annotations

import math
import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 8)
    return str(value)


def agree(spark, query, sql: str) -> int:
    """The number of rows; fails where columns or rows differ."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver's tables are not here")
    got = query(spark, SF_DIR)
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{name}/*.parquet" if os.path.isdir(f"{SF_DIR}/{name}") else f"{SF_DIR}/{name}"
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    rows = sorted((tuple(normal(r[c]) for c in order) for r in got.collect()), key=repr)
    found = sorted((tuple(normal(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert rows == found
    return len(rows)
