"""Roll-ups, marking, rules, the judge stage, readers and plans on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import symbols as S
from gradeloom.operators import catalog, graph, judge, marking, rules, scores
from gradeloom.plans import evaluate, repair, verify
from gradeloom.sources import inference, sinks
from gradeloom.streaming import runs as streaming

RESULT = "dataset string, run_id string, idx int, question_id string, fine_grained_score double, coarse_grained_score double, earned_points double, max_points double, error string"


@pytest.fixture(scope="module")
def results(spark):
    rows = [("d", "r1", 0, "q1", 1.0, 0.0, 1.0, 4.0, None), ("d", "r2", 0, "q1", 2.0, 1.0, 2.0, 4.0, None), ("d", "r3", 0, "q1", 4.0, 4.0, 4.0, 4.0, None), ("d", "r1", 1, "q2", 0.0, 0.5, 0.5, 1.0, None), ("d", "r2", 1, "q2", None, None, None, 1.0, "failed")]
    return spark.createDataFrame(rows, RESULT)


def test_question_stats(results):
    q1 = scores.question_stats(results, ["question_id"]).filter("question_id = 'q1'").first()
    assert (q1.num_runs, q1.mean_score, q1.std_score, q1.min_score, q1.max_score, q1.score_rate) == (3, 2.33, 1.25, 1.0, 4.0, 58.33)
    q2 = scores.question_stats(results, ["question_id"], 4, True).filter("question_id = 'q2'").first()
    assert (q2.num_runs, q2.std_score, q2.median_score) == (1, 0.0, 0.5)


@pytest.mark.parametrize("stepwise", [True, False])
def test_dataset_score(results, stepwise):
    got = {r.run_id: r for r in scores.dataset_score(results, ["dataset", "run_id"], stepwise).collect()}
    assert (got["r1"].total_score, got["r1"].max_possible_score, got["r1"].score_rate, got["r1"].total_count) == (1.5, 5.0, 30.0, 2)
    assert (got["r2"].total_score, got["r2"].max_possible_score, got["r2"].total_count) == (2.0, 4.0, 2)


def test_pivot_and_summary(spark, results):
    got = {r.question_id: r.asDict() for r in scores.pivot_runs(results, ["r1", "r2", "r3"], ["question_id"]).collect()}
    assert got["q2"] == {"question_id": "q2", "r1": 0.5, "r2": 0.0, "r3": 0.0}
    questions = spark.createDataFrame([("d", "q1", 4.0), ("d", "q2", 1.0)], "dataset string, question_id string, max_points double")
    got = {r.run_id: (r.total_score, r.max_possible_score, r.score_rate) for r in scores.run_summary(results, questions).collect()}
    assert got == {"r1": (1.5, 5.0, 30.0), "r2": (2.0, 5.0, 40.0), "r3": (4.0, 5.0, 80.0)}
    assert scores.summary_by_file(results, questions).first().mean_score_rate == 50.0
    assert [r.question_id for r in scores.first_run_questions(results, ["dataset"]).orderBy("question_id").collect()] == ["q1", "q2"]


def test_empty(spark):
    none = spark.createDataFrame([], RESULT)
    assert scores.dataset_score(none, ["dataset"]).count() == 0
    assert scores.grand_total(scores.dataset_score(none, ["dataset"])).first().asDict() == {"grand_total_score": 0.0, "grand_max_score": 0.0, "grand_score_rate": 0.0, "num_datasets": 0}
    assert tuple(rules.summary(spark.createDataFrame([], "score double")).first()) == (0, 0.0, 0.0)


def test_repeated_question(spark):
    rows = [("d", "r", 0, "q", 1.0, 1.0, 1.0, 2.0, None), ("d", "r", 1, "q", 2.0, 2.0, 2.0, 2.0, None)]
    got = scores.last_of_repeated(spark.createDataFrame(rows, RESULT), ["dataset"]).collect()
    assert [(r.idx, r.repeats) for r in got] == [(1, 2)]


def test_settle(spark):
    rows = [("a", k, 1.0, [0.8, 0.6]) for k in (1, 2, 3, 4)] + [("b", 1, 0.0, [0.8, 0.6]), ("c", 1, 1.0, [0.8, 0.6]), ("c", 2, 1.0, [0.5, 0.25]), ("d", 1, 1.0, [])]
    got = {r.k: r for r in marking.settle(spark.createDataFrame(rows, "k string, attempt int, max_points double, scores array<double>"), ["k"]).collect()}
    assert (got["a"].score, got["a"].scores, got["a"].attempt, got["a"].scale_factor) == (1.0, [0.57, 0.43], 4, 0.714)
    assert (got["b"].score, got["b"].attempt, got["b"].scale_factor) == (1.4, 1, None)
    assert (got["c"].score, got["c"].attempt) == (0.75, 2)
    assert got["d"].score == 0.0


def test_best_set(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.5), ("b", 0, 0.0), ("b", 1, -1.0), ("c", 0, 0.1), ("c", 1, 0.2)]
    got = {r.k: (r.score, r.best_marking_set) for r in marking.best_set(spark.createDataFrame(rows, "k string, set_index int, score double"), ["k"]).collect()}
    assert got == {"a": (0.5, 1), "b": (0.0, None), "c": (0.2, 2)}


def parsed(spark, text):
    return graph.parsed(spark.createDataFrame([("s", "d", text)], "id string, dataset string, text_all string"))


def test_rules(spark):
    got = lambda text: rules.dedupe(rules.graph_consistency(F.col("text_all"), F.col("symbols"), F.col("formulas")))
    one = parsed(spark, "v = v0 + 3").select(got("").alias("d")).withColumn("s", rules.score("d")).first()
    assert [d["message"] for d in one.d] == [rules.SELF_REFERENCE] and one.s == -0.5
    two = parsed(spark, "E = h * f1\nE = p * c").select(got("").alias("d")).withColumn("s", rules.score("d")).first()
    assert [d["message"] for d in two.d] == [rules.SELF_REFERENCE, rules.CONFLICT] and two.s == -1.0
    strict = parsed(spark, "v = v0 + 3\nx = x + y1").select(rules.self_reference(F.col("formulas"), "strict", True).alias("d")).first()
    assert [d["symbol"] for d in strict.d] == ["x"]
    used = parsed(spark, "a1 = b1 + 2\nc1 = b1 * 3").select(rules.undefined_symbol(F.col("text_all"), F.col("symbols"), F.col("formulas")).alias("d")).first()
    assert [(d["symbol"], d["severity"]) for d in used.d] == [("b1", "info")]
    none = parsed(spark, None).select(got("").alias("d")).first()
    assert none.d == []


def test_graph(spark):
    edges = graph.uses(graph.formula_rows(parsed(spark, "a1 = b1 + 2\nd1 ∝ b1"))).collect()
    assert sorted((e.fid, e.symbol, e.role) for e in edges) == [("F0000", "a1", "defines"), ("F0000", "a1", "uses"), ("F0000", "b1", "uses"), ("F0001", "b1", "uses"), ("F0001", "d1", "uses")]
    nodes = {r.symbol: r for r in graph.nodes(parsed(spark, "a1 = b1 + 2\nd1 ∝ b1")).collect()}
    assert (nodes["b1"].used_in, nodes["b1"].defined_by, len(nodes["b1"].occurrences)) == (["F0000", "F0001"], [], 2)


class Loud:
    id = "loud"

    def run(self, context, runtime):
        return [{"severity": "error", "message": "m", "symbol": ["x"]}, "no dict", {"severity": "error", "message": "m", "symbol": ["x"]}]


class Broken:
    id = "broken"

    def run(self, context, runtime):
        raise RuntimeError("no")


def test_plugins(spark):
    found = rules.run_plugins(parsed(spark, "t"), [Broken(), Loud()]).select(rules.dedupe(F.col("plugin_diagnostics")).alias("d")).first()
    assert [(d["rule"], d["symbol"]) for d in found.d] == [("loud", '["x"]')]
    ids, loaded = rules.load_rules([rules.GRAPH_RULE, "tests.test_operators:Loud", "no.such:Rule"], {rules.GRAPH_RULE: None})
    assert ids == [rules.GRAPH_RULE] and [r.id for r in loaded] == ["loud"]
    registry = rules.Registry()
    registry.register(Loud())
    assert registry.list_ids() == ["loud"] and registry.get("loud").id == "loud" and registry.get("x") is None


def test_judge(spark):
    rows = [("p", "q", "s", [["a", " "], ["b"]], 1.0), ("none", "q", "s", [], 1.0), ("over", "q", "s", [["a", "a"]], 1.0)]
    problems = spark.createDataFrame(rows, "problem_key string, question string, prediction string, sets array<array<string>>, max_points double")
    found = judge.judge_criteria(problems, lambda: judge.ScriptedClient(lambda p: "\\boxed{0.75}" if "Criterion:\na" in p else "\\boxed{0.8}"))
    got = {(r.problem_key, r.set_index): (r.score, r.attempt, len(r.details)) for r in found.collect()}
    assert got == {("p", 0): (0.75, 1, 1), ("p", 1): (0.8, 1, 1), ("over", 0): (1.0, 4, 2)}
    silent = judge.call(problems.withColumn("prompt", F.lit("x")), judge.NoClient).first()
    assert silent.reply is None and silent.call_error
    assert not judge.NoClient().working() and judge.judge_wanted("m", "k", True) and not judge.judge_wanted("exact_matching", "k", True)


def test_cache_and_budget(spark):
    payloads = spark.createDataFrame([("d", str(i), "rule", f"k{i % 3}", f"p{i % 3}") for i in range(6)], "dataset string, id string, namespace string, key string, prompt string")
    cache = spark.createDataFrame([("rule", "k0", "[]")], "namespace string, key string, value string")
    full, fresh = judge.answered(payloads, cache, lambda: judge.ScriptedClient(lambda p: "[1]" if p == "p1" else "no json"), ["key"], 1)
    assert [tuple(r) for r in fresh.collect()] == [("rule", "k1", "[1]")]
    assert {r.key: r.value for r in full.collect()} == {"k0": "[]", "k1": "[1]", "k2": None} and full.count() == 6
    ranks = judge.budget_rank(spark.range(100).withColumnRenamed("id", "x"), ["x"]).collect()
    assert all(r.call_rank == r.x + 1 for r in ranks)


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("infer")
    one = [
        {"id": 1, "question": "Q" * 120, "prediction": "\\boxed{2}", "answer": "2", "points": 3, "marking": [["find it"], ["else"]]},
        {"id": "b", "question": "é", "prediction": "\\boxed{7}", "answer": ["1", "7"], "point": 2, "marking": ["state it", "nan"]},
        {"id": "c", "answer": "1"},
    ]
    write(base / "D1/M1/run1.json", one)
    write(base / "D1/M1/run2.json", [dict(one[0], prediction="\\boxed{5}"), one[1]])
    write(base / "D2/M1/only.json", [{"prediction": "1", "answer": "[\"1\", \"2\"]", "point": "[1, 2]"}])
    write(base / "D3/M1/bad.json", "{not json")
    write(base / "D3/M1/empty.json", "[]")
    return base


def test_reader(spark, root):
    files = inference.keyed(inference.read_files(spark, f"{root}/*/*"))
    assert sorted((r.dataset, r.run_id, r.readable) for r in files.collect()) == [("D1", "run1", True), ("D1", "run2", True), ("D2", "only", True), ("D3", "bad", False), ("D3", "empty", True)]
    got = {(r.dataset, r.run_id, r.question_id): r for r in inference.problems(files).collect()}
    assert got["D1", "run1", "1"].points == [3.0] and got["D1", "run1", "1"].sets == [["find it"], ["else"]]
    assert got["D1", "run1", "b"].points == [0.0] and got["D1", "run1", "b"].answer == ["1", "7"]
    assert got["D1", "run1", "c"].error == "no prediction"
    only = got["D2", "only", "D2/M1_1"]
    assert only.points == [1.0, 2.0] and only.answer == ["1", "2"] and only.modality == "text" and only.answer_type == ["Open-End"]
    assert catalog.multi_run(files).select("dataset").distinct().count() == 2
    assert [r.run_id for r in inference.newest(files.filter("dataset = 'D2'"), ["dataset"]).collect()] == ["only"]
    with pytest.raises(ValueError):
        inference.require(spark.range(1))


def test_evaluate(spark, root, tmp_path):
    engine = evaluate.Engine(spark, str(root), str(tmp_path), lambda: judge.ScriptedClient(lambda p: "\\boxed{0.5}"))
    results, totals = engine.evaluate("D1", "M1", "run1")
    got = {r.question_id: (r.fine_grained_score, r.coarse_grained_score, r.earned_points, r.extracted_pred) for r in results.collect()}
    assert got == {"1": (0.5, 3.0, 3.0, "2"), "b": (1.0, 1.0, 1.0, "7"), "c": (None, None, None, None)}
    assert totals.first().total_count == 3
    engine.save(results, totals)
    assert engine.evaluated().count() == 1
    detailed = sinks.detailed(results)
    assert len(detailed.columns) == 19 and detailed.filter("id = '1'").first().answer == ["\\boxed{2}"]
    waiting = engine.evaluate_all(["D2", "D1", "D3"], ["M1"])
    assert [(r.dataset, r.error) for r in waiting.select("dataset", "error").collect()] == [("D2", None), ("D3", "no readable problems")]
    found = engine.multi_run("D1", "M1")
    one = found["questions"].filter("question_id = '1'").first()
    assert (one.num_runs, one.mean_score, one.max_points) == (2, 1.75, 3.0)
    assert found["overall"].first().num_runs == 2
    engine.save_multi_run(found)
    report = sinks.write_report(sinks.run_table(found["run_scores"]), str(tmp_path / "x/report.json"), {"head": 1})
    assert len(json.loads(open(report).read())["results"]) == 2
    sinks.write_report(sinks.run_table(found["run_scores"]), str(tmp_path / "x/report.json"))
    assert sum(p.name.endswith(".backup") for p in (tmp_path / "x").iterdir()) == 1
    with pytest.raises(ValueError):
        sinks.write_report(results, str(tmp_path / "x/large.json"), most_bytes=10)


def test_repair(spark, tmp_path):
    stats = {"dataset_key": "D/M", "question_statistics": {"q1": {"max_points": 2, "runs": {"r1": {"fine_grained_score": 1, "coarse_grained_score": 2}, "r2": {"fine_grained_score": 0, "coarse_grained_score": 1}}}, "q2": {"max_points": 1, "runs": {}}}}
    write(tmp_path / "a/b/x_multi_run_statistics.json", stats)
    rows = repair.opened(inference.statistics_files(spark, str(tmp_path)))
    found = repair.repaired(rows)
    assert found["questions"].first().mean_score == 1.5
    assert found["summary"].first().max_possible_score == 6.0
    assert {r.run_id: r.total_score for r in found["runs"].collect()} == {"r1": 2.0, "r2": 1.0}
    before = (tmp_path / "a/b/x_multi_run_statistics.json").read_text()
    out = repair.write(spark, str(tmp_path))
    assert (tmp_path / "a/b/x_multi_run_statistics.json").read_text() == before
    again = {r.question_id: r for r in spark.read.json(out["statistics"]).collect()}
    assert again["q1"].runs.r1.earned_score == 2.0 and again["q1"].statistics.mean_score == 1.5 and again["q2"].statistics is None
    table = spark.read.parquet(out["questions_coarse"]).first()
    assert (table.question_id, table.mean_score, table.r1_score, table.r2_score) == ("q1", 1.5, 2.0, 1.0)
    assert spark.read.parquet(out["summary"]).first().max_possible_score == 6.0 and len(out) == 7


def test_verify(spark, root):
    samples = spark.createDataFrame([("s1", "d", "v = v0 + 3", None, "E = h * f1"), ("s2", "d", None, None, None)], "id string, dataset string, question string, context string, prediction string")
    cache = inference.read_cache(spark, None)
    reply = '[{"severity": "error", "message": "wrong"}]'
    report, fresh = verify.by_rules(samples, ["graph_consistency", "formula_correctness", "tests.test_operators:Loud"], cache, lambda: judge.ScriptedClient(lambda p: reply), "m", 1)
    got = {r.id: (r.score, [d["rule"] for d in r.diagnostics]) for r in report.collect()}
    # The one call goes to the first sample.
    assert {k: len(v[1]) for k, v in got.items()} == {"s1": 4, "s2": 1} and fresh.count() == 1
    assert sinks.light(report).columns == ["id", "dataset", "score", "diagnostics"]
    silent, _ = verify.by_model(samples, cache)
    assert [r.score for r in silent.collect()] == [0.0, 0.0]
    said, _ = verify.by_model(samples, cache, lambda: judge.ScriptedClient(lambda p: '{"diagnostics": [{"severity": "warning", "message": "m"}], "symbols": {"zz": "what"}}'), "m", 9)
    assert [r.score for r in said.collect()] == [-0.5, -0.5] and said.first().symbol_nodes["zz"] == "what"
    raw = inference.samples(inference.keyed(inference.read_files(spark, f"{root}/D1/M1")))
    first = raw.filter("id = '1' and run_id = 'run1'").first()
    assert first.prediction == "\\boxed{2}" and "points" in first.meta and "answer" in first.meta


class Counted:
    """A client that writes a line for each call."""

    def __init__(self, path, reply):
        self.path, self.reply = path, reply

    def working(self):
        return True

    def generate(self, prompt):
        with open(self.path, "a") as f:
            f.write(prompt.split("\n")[0] + "\n")
        return self.reply


def test_calls_are_made_once_within_one_budget(spark, tmp_path):
    """All rules share the budget, sample by sample; report and cache are of the same calls, however often they are read."""
    samples = spark.createDataFrame([(f"s{k}", "d", "r", k, f"v{k} = u0 + {k}", None, "E = h * f1") for k in range(6)], "id string, dataset string, run_id string, idx int, question string, context string, prediction string")
    cache = inference.read_cache(spark, str(tmp_path / "none"))
    told, specs = tmp_path / "calls", ["formula_correctness", "graph_consistency", "precondition_consistency"]
    factory = lambda: Counted(str(told), '[{"severity": "error", "message": "wrong"}]')
    report, fresh = verify.by_rules(samples, specs, cache, factory, "m", 5)
    for _ in range(2):
        got = {r.id: sorted(d["rule"] for d in r.diagnostics if d["message"] == "wrong") for r in report.collect()}
        assert got == {"s0": ["formula_correctness", "precondition_consistency"], "s1": ["formula_correctness", "precondition_consistency"], "s2": ["formula_correctness"], "s3": [], "s4": [], "s5": []}
        assert fresh.count() == 5
    assert len(told.read_text().split("\n")) - 1 == 5
    sinks.append_cache(fresh, str(tmp_path / "cache"))
    cached = inference.read_cache(spark, str(tmp_path / "cache"))
    again, more = verify.by_rules(samples, specs, cached, factory, "m", 3)
    assert more.count() == 3 and again.filter("exists(diagnostics, d -> d.message = 'wrong')").count() == 4 and len(told.read_text().split("\n")) - 1 == 8
    # Samples that share an id and repeated samples are told apart, or are one, by their text.
    twice = spark.createDataFrame([("s", "d", "a1 = 2", None, "x"), ("s", "d", "b1 = 2", None, "x"), ("s", "d", "b1 = 2", None, "x")], "id string, dataset string, question string, context string, prediction string")
    report, fresh = verify.by_rules(twice, ["formula_correctness"], cache, factory, "m", 9)
    assert report.count() == 3 and fresh.count() == 2 and report.filter("size(diagnostics) = 1").count() == 3


def test_stepwise_sums(spark):
    """Partial sums of cents give what rounding after each addition gives, ties and failures included."""
    import random

    rng = random.Random(4)
    cents = lambda x: round(x * 100) / 100  # noqa: E731  Python rounds halves to even
    rows, want = [], {}
    for run, digits in (("a", 2), ("b", 3), ("c", 6), ("d", 3)):
        total = [0.0, 0.0, 0.0]
        for k in range(400):
            x = [round(rng.uniform(0, 9), digits) if rng.random() < 0.9 else rng.choice([0.005, 0.015, 1.125, 2.375]) for _ in range(2)]
            x.append(max(x))
            failed = "failed" if rng.random() < 0.05 else None
            rows.append(("d", run, k, f"q{k}", x[0], x[1], x[2], 9.0, failed))
            if not failed:
                total = [cents(t + v) for t, v in zip(total, x, strict=True)]
        want[run] = tuple(total)
    rng.shuffle(rows)
    got = scores.dataset_score(spark.createDataFrame(rows, RESULT).repartition(5), ["dataset", "run_id"]).collect()
    assert {r.run_id: (r.fine_grained_total_score, r.coarse_grained_total_score, r.total_score) for r in got} == want


def test_grouped(spark):
    import random

    from gradeloom.functions import text as X

    rng = random.Random(9)
    rows = [([(rng.choice("abcdé"), k) for k in range(rng.randrange(9))], rng.sample("abcdxé", rng.randrange(6))) for _ in range(60)]
    table = spark.createDataFrame(rows, "pairs array<struct<k:string,v:int>>, names array<string>")
    for r in table.select("*", X.grouped(F.col("pairs"), F.col("names")).alias("g")).collect():
        assert [(g["name"], g["values"]) for g in r.g] == [(n, [p["v"] for p in r.pairs if p["k"] == n]) for n in r.names]


def test_dedupe_keeps_the_first(spark):
    d = lambda rule, symbol, n: ("info", rule, symbol, "m", str(n))
    listed = [d("b", None, 0), d("a", "x", 1), d("b", None, 2), d("a", "y", 3), d("a", "x", 4), d("c", None, 5)]
    table = spark.createDataFrame([(listed,), ([],), (None,)], "d array<struct<severity:string,rule:string,symbol:string,message:string,evidence:string>>")
    got = [r.k for r in table.select(rules.dedupe(F.col("d")).alias("k")).collect()]
    assert [x["evidence"] for x in got[0]] == ["0", "1", "3", "5"] and got[1] == [] and got[2] is None


def test_stage_folder(spark, monkeypatch):
    from gradeloom.sources import staging

    before = staging.staged()
    table = staging.stage(spark.range(3), "t")
    assert table.count() == 3 and staging.drop_staged(spark, before) == 1 and staging.staged() == before

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://far:7077", "_jsc": spark.sparkContext._jsc})  # noqa: N815

    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        with pytest.raises(ValueError):
            staging.folder(Far)


def test_stream(spark, root, tmp_path):
    query = streaming.score_runs(spark, str(root), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_cli(spark, root, tmp_path, monkeypatch, capsys):
    from gradeloom.plans import cli

    monkeypatch.chdir(tmp_path)
    assert cli.main(["--results-dir", str(root), "--dry-run", "--datasets", "D1,D2", "--models", "M1", "--output-dir", str(tmp_path / "o")]) == 0
    assert capsys.readouterr().out.split() == ["D1/M1", "D2/M1"]
    out = tmp_path / "o"
    assert cli.main(["--results-dir", str(root), "--dataset", "D1/M1", "--output-dir", str(out), "--rules-check", "--rules", "graph_consistency"]) == 0
    named = [p.name for p in (out / "rules_reports").iterdir()]
    assert len(named) == 2 and all(n.startswith("D1_M1__rules(graph_consistency)_") for n in named)
    assert cli.main(["--results-dir", str(tmp_path / "no"), "--output-dir", str(out)]) == 1
    # All that wait: D1/M1 has scores by now, and one of D3's files cannot be read while the other has no problems.
    assert cli.main(["--results-dir", str(root), "--output-dir", str(out)]) == 1
    summary = json.loads((out / "all_datasets_summary.json").read_text())
    assert summary["overall"]["num_datasets"] == 1 and {r["dataset_key"]: r["error"] for r in summary["results"]} == {"D2/M1": None, "D3/M1": "no readable problems"}
    (row,) = json.loads((out / "summary_table.json").read_text())
    assert set(row) == {"dataset_key", "total_questions", "total_score", "max_possible_score", "score_rate", "total_count", "fine_grained_score", "fine_grained_rate", "coarse_grained_score", "coarse_grained_rate"}
    many = ["--results-dir", str(root), "--output-dir", str(tmp_path / "m"), "--multi-runs", "--datasets", "D1", "--models", "M1", "--varconst-check"]
    assert cli.main(many) == 0
    assert json.loads((tmp_path / "m/all_datasets_multi_run_summary.json").read_text())[0]["num_runs"] == 2
    reports = sorted(p.name.split("_2")[0] for p in (tmp_path / "m/varconst_reports").iterdir())
    assert reports == [f"D1_M1__run{k}__varconst_{x}" for k in (1, 2) for x in ("full", "light")]
    assert cli.main(["--repair-statistics", str(tmp_path / "m")]) == 0


class Keyed(judge.ScriptedClient):
    def __init__(self, key=None):
        super().__init__(lambda p: key)


def test_judge_gate(monkeypatch):
    from gradeloom.plans import cli

    spec = "tests.test_operators:Keyed"
    assert cli.judge_of(cli.arguments(["--judge-model", spec]), "k")().generate("x") == "k"
    assert cli.judge_of(cli.arguments(["--judge-model", spec]), None) is None
    assert cli.judge_of(cli.arguments(["--judge-model", spec, "--no-judge"]), "k") is None
    assert cli.judge_of(cli.arguments(["--judge-model", "exact_matching"]), "k") is None
    assert cli.judge_of(cli.arguments(["--judge-model", "gradeloom.operators.judge:NoClient"]), "k") is None


def test_settings(tmp_path):
    (tmp_path / "e").write_text("# no\nA_B_C = 'x'\n")
    assert inference.settings(str(tmp_path / "e"))["A_B_C"] == "x"
    with pytest.raises(FileNotFoundError):
        inference.anchored("no/such/folder", str(tmp_path))


def test_words_are_bounded_symbols(spark):
    import random
    import re

    rng = random.Random(3)
    rows = [("".join(rng.choice("ab_1 é=中") for _ in range(12)), rng.choice(["a", "ab", "a_1", "b1"])) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string, s string").select(F.array_contains(S.words(F.col("t")), F.col("s"))).collect()
    assert [g[0] for g in got] == [bool(re.search(rf"(?<![A-Za-z0-9_]){s}(?![A-Za-z0-9_])", t)) for t, s in rows]
