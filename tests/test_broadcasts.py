"""Joins of tables with a row a question: Spark, which takes them for small, must not gather them on the driver to broadcast them."""

from __future__ import annotations

import re

import pytest

from gradeloom import file_queries
from gradeloom.operators import scores
from gradeloom.plans import evaluate, repair
from gradeloom.sources import documents
from tests.oracle import SF_DIR


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is staged or written as files."""
    found = []
    seen = lambda f: lambda df, *a: (found.append(df._jdf.queryExecution().executedPlan().toString()), f(df, *a))[1]
    for module in (evaluate, repair, scores):
        monkeypatch.setattr(module, "stage", seen(module.stage))
    monkeypatch.setattr(documents, "write", seen(documents.write))
    return found


def joins(plans, kind: str) -> list[str]:
    """The joins by question of a kind."""
    return [line for p in plans for line in p.splitlines() if re.search(kind, line) and "question_id" in line]


def test_no_join_of_questions_is_broadcast(spark, plans, monkeypatch):
    tables = []
    monkeypatch.setattr(repair.sinks, "write_table", lambda df, path, *_, **__: (tables.append(path), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    repair.write(spark, file_queries._statistics(spark, SF_DIR))
    assert len(tables) > 3 and joins(plans, "SortMergeJoin") and not joins(plans, "BroadcastHashJoin|BroadcastNestedLoopJoin|ShuffledHashJoin")
