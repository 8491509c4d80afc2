"""Users' rules as a table function, and the log lines of verbose runs."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import parse
from gradeloom.operators import graph, judge, rules
from gradeloom.plans import evaluate, verify
from gradeloom.sources import inference


class Words:
    id, columns = "words", {"n": "int", "where": "array<string>"}

    def run(self, context, runtime):
        return [{"message": w, "n": len(w), "where": [context.dataset, str(context.sample_id)], "severity": "warning"} for w in context.text_all.split()] + ["no dict"]


class Broken:
    id = "broken"

    def run(self, context, runtime):
        raise KeyError("no") if "b" in context.text_all else OSError("gone")


def parsed(spark, *texts):
    return graph.parsed(spark.createDataFrame([(f"s{k}", "d", t) for k, t in enumerate(texts)], "id string, dataset string, text_all string"))


def test_rows_of_diagnostics(spark):
    rows = rules.diagnostic_rows(parsed(spark, "a bb", "", "c"), [Words(), Broken()])
    got = sorted((r.id, r.rule, r.message, r.n, r.where, r.rule_error) for r in rows.collect())
    assert [g[:4] for g in got if g[1] == "words"] == [("s0", "words", "a", 1), ("s0", "words", "bb", 2), ("s2", "words", "c", 1)]
    assert [(g[0], g[5]) for g in got if g[1] == "broken"] == [("s0", "KeyError: 'no'"), ("s1", "OSError: gone"), ("s2", "OSError: gone")]
    assert got[1][4] == ["d", "s0"] and rows.schema["n"].dataType.simpleString() == "int"
    outer = rules.diagnostic_rows(parsed(spark, "a", ""), [Words()], outer=True)
    assert {(r.id, r.message) for r in outer.collect()} == {("s0", "a"), ("s1", None)}
    assert rules.diagnostic_rows(parsed(spark, "a").limit(0), [Words()]).count() == 0
    with pytest.raises(ValueError, match="severity"):
        rules.diagnostic_rows(parsed(spark, "a").withColumn("Severity", F.lit(1)), [Words()])
    with pytest.raises(Exception, match="formulas"):
        rules.diagnostic_rows(parsed(spark, "a").drop("formulas"), [Words()]).collect()


def test_failures_are_in_the_report(spark):
    samples = spark.createDataFrame([("s1", "d", None, None, "a"), ("s2", "d", None, None, "b")], "id string, dataset string, question string, context string, prediction string")
    report, _ = verify.by_rules(samples, ["tests.test_rules_and_logs:Broken", "tests.test_rules_and_logs:Words"], inference.read_cache(spark, None))
    got = {r.id: ([f.rule for f in r.rule_failures], [f.error for f in r.rule_failures], len(r.diagnostics)) for r in report.collect()}
    assert got == {"s1": (["broken"], ["OSError: gone"], 1), "s2": (["broken"], ["KeyError: 'no'"], 1)}
    report, _ = verify.by_rules(samples, ["graph_consistency"], inference.read_cache(spark, None))
    assert [r.rule_failures for r in report.collect()] == [[], []]


def test_verbose_runs_write_their_lines_in_order(spark, tmp_path):
    rows = [{"id": k, "prediction": f"\\boxed{{{k}}}", "answer": "1", "points": 2, "marking": [["a", "b"]] if k == 1 else []} for k in range(40)] + [{"id": "no", "answer": "1"}]
    for run in ("r1", "r2"):
        (tmp_path / "in/D/M").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"in/D/M/{run}.json").write_text(json.dumps(rows))
    engine = evaluate.Engine(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda: judge.ScriptedClient(lambda p: "\\boxed{0.5}"), verbose=True)
    engine.save_multi_run(engine.multi_run("D", "M"))
    logs = sorted((tmp_path / "out/D/M").glob("*.log"))
    assert [p.name.split("_")[0] for p in logs] == ["r1", "r2"]
    problems = logs[0].read_text().split("\n\n")
    assert [p.split("\n")[0] for p in problems[:-1]] == [f"problem {k + 1} ({k if k < 40 else 'no'}), {'2.0' if k < 40 else '0.0'} points" for k in range(41)]
    assert problems[1].split("\n")[1:] == ["a prediction of 9 characters, 1 answers, 1 marking sets", "criterion 1: 0.5", "criterion 2: 0.5", "best marking set: 1", "read as answers: 1", "fine 1.0, coarse 2.0, earned 2.0"]
    assert problems[40].endswith("failed: no prediction")
    quiet = evaluate.Engine(spark, str(tmp_path / "in"), str(tmp_path / "quiet"))
    results, totals = quiet.evaluate("D", "M")
    quiet.save(results, totals)
    assert "log" not in results.columns and not list((tmp_path / "quiet").rglob("*.log"))


def test_texts_are_parsed_once_for_the_rules_that_ask_and_the_report(spark):
    samples = spark.createDataFrame([("d", "1", "q", None, "v_1 = u0 + 2 * t1"), ("d", "2", None, None, "")], "dataset string, id string, question string, context string, prediction string")
    reply = '[{"severity": "error", "message": "wrong"}]'
    report, fresh = verify.by_rules(samples, ["graph_consistency", "formula_correctness"], inference.read_cache(spark, None), lambda: judge.ScriptedClient(lambda p: reply), "m", 1)
    assert "F%04d" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["score"] for r in report.collect()} == {"1": -1.5, "2": 0.0} and fresh.count() == 1


def test_keys_of_texts_are_those_of_the_cache(spark):
    odd = ["", 'a "quoted" \\ / text', "\n\r\t\x00\x1f\x7f\u2028", "ä 中 😀 </script>", "{}", "null", "1e5"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    t, m = F.col("t"), F.lit("m")
    assert rows.filter(parse.text_key(rule=t, inputs=t, model=m) == parse.cache_key(t.alias("rule"), t.alias("inputs"), m.alias("model"))).count() == len(odd)
