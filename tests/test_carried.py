"""Explodes of whole files: no element's row carries the file it is of, which would cost the square of a file's elements."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeloom import queries
from gradeloom.plans import repair
from gradeloom.sources import documents, inference, statistics
from tests.oracle import SF_DIR


def carried(df) -> list[set[str]]:
    """The columns that each explode of the plan hands on beside what it makes."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Generate":
            own = node.requiredChildOutput()
            found.append({own.apply(k).name() for k in range(own.size())})
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_no_problem_carries_its_file(spark):
    files = spark.range(2).select(F.concat(F.lit("d/m/"), "id").alias("path"), F.lit("d").alias("dataset"), F.lit("m").alias("model"), F.col("id").cast("string").alias("run_id"), F.lit(True).alias("readable"), F.from_json(F.lit('[{"prediction": "1", "answer": "1", "points": 2}, {"prediction": "2"}]'), "array<variant>").alias("items"))
    df = inference.problems(files)
    assert all("items" not in c for c in carried(df))
    assert sorted((r["path"], r["idx"], r["question_id"], r["points"]) for r in df.collect()) == [(f"d/m/{k}", i, f"d/m_{i + 1}", p) for k in range(2) for i, p in ((0, [2.0]), (1, [0.0]))]


@pytest.mark.parametrize("name", ["problem_rows", "scored_problems"])
def test_no_row_of_a_query_carries_its_file(spark, name):
    assert all(not c & {"items", "l"} for c in carried(queries.QUERIES[name](spark, SF_DIR)))


def test_no_question_carries_its_document_and_no_run_its_question(spark):
    told = '{"dataset_key": "d/m", "question_statistics": {"q1": {"question": "a", "max_points": 2.0, "runs": {"r1": {"coarse_grained_score": 1.0}, "r2": {}}}, "q2": {"runs": {}}}}'
    df = repair.opened(spark.range(1).select(F.concat(F.lit("p"), "id").alias("path"), F.try_parse_json(F.concat(F.lit(told), F.lit(""))).alias("statistics")))
    assert all(not c & {"statistics", "q", "all"} for c in carried(df))
    assert sorted((r["question_id"], r["question"], r["max_points"], r["run_id"], r["earned_points"]) for r in df.collect()) == [("q1", "a", 2.0, "r1", 1.0), ("q1", "a", 2.0, "r2", 0.0), ("q2", None, 0.0, None, 0.0)]


def test_a_repair_reads_rows_of_questions_and_not_whole_documents_at_each_step(spark, tmp_path):
    told = {"a": '{"dataset_key": "d/m", "note": 1, "question_statistics": {"q1": {"max_points": 2.0, "runs": {"r1": {"coarse_grained_score": 1.0}}}, "q2": {"runs": {}}}, "overall_statistics": null}', "b": '{"dataset_key": "e"}', "c": "no JSON"}
    for name, text in told.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / statistics.DOCUMENT).write_text(text)
    root = str(tmp_path)
    df = repair.documents_of(inference.statistics_files(spark, root), repair.plain_root(spark, root))
    assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    documents.write(df, str(tmp_path / "new"), statistics.ORDER)
    found = {name: json.loads((tmp_path / "new" / name / statistics.DOCUMENT).read_text()) for name in ("a", "b")}
    assert found["b"] == {"dataset_key": "e"} and not (tmp_path / "new" / "c").exists()
    assert found["a"]["note"] == 1 and found["a"]["overall_statistics"]["total_runs"] == 1
    assert found["a"]["question_statistics"]["q1"]["runs"] == {"r1": {"coarse_grained_score": 1.0, "earned_score": 1.0}}
    assert found["a"]["question_statistics"]["q2"] == {"runs": {}}
