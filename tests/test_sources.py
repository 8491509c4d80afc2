"""Names of folders, the keyed cache, statistics documents, workbooks, large arrays."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import judge
from gradeloom.plans import evaluate, repair, verify
from gradeloom.sources import documents, inference, statistics, store, workbooks
from gradeloom.sources.cache import ReplyCache

CACHE = "namespace string, key string, value string"
ODD = ["My Data", "a+b", "50%", "x[1]", "q?*", "{a,b}", "Größe é", "%20", "back\\slash"]


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")


def test_names_of_any_kind(spark, tmp_path):
    for name in ODD:
        for k in (1, 2):
            write(tmp_path / name / "M x+%" / f"run {k}+%.json", json.dumps([{"id": 1, "prediction": "\\boxed{2}", "answer": "2", "points": k}], indent=1))
    engine = evaluate.Engine(spark, str(tmp_path), str(tmp_path / "out"))
    assert sorted((r.dataset, r.model, r.run_id) for r in engine.files().collect()) == sorted((name, "M x+%", f"run {k}+%") for name in ODD for k in (1, 2))
    pairs = spark.createDataFrame([(name, "M x+%") for name in ODD], "dataset string, model string")
    assert {r.dataset: (r.error, r.total_count) for r in engine.evaluate_pairs(pairs)[1].collect()} == dict.fromkeys(ODD, (None, 1))
    for name in ODD:
        assert {r.dataset for r in engine.files(name, "M x+%").select("dataset").collect()} == {name}
    results, totals = engine.evaluate("x[1]", "M x+%", "run 2+%")
    assert totals.first().total_score == 2.0 and results.first().path.endswith("x[1]/M x+%/run 2+%.json")


def test_no_readable_run_is_an_error(spark, tmp_path):
    write(tmp_path / "D/M/a.json", "{")
    engine = evaluate.Engine(spark, str(tmp_path), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="D/M"):
        engine.evaluate("D", "M")
    with pytest.raises(ValueError, match="D/M"):
        engine.multi_run("D", "M")


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), CACHE)


def held(cache):
    return sorted((r.namespace, r.key, r.value) for r in cache.read().collect())


def test_cache_last_write_wins(spark, tmp_path):
    cache = ReplyCache(spark, str(tmp_path / "c d+"))
    assert held(cache) == [] and cache.compact() is None and cache.vacuum() == 0
    cache.append(rows(spark, ("n", "a", "1"), ("n", "b", "1"), ("m", "a", "x"), ("n", "z", None)))
    cache.append(rows(spark, ("n", "a", "2"), ("n", "a", "3")))
    want = [("m", "a", "x"), ("n", "a", "3"), ("n", "b", "1")]
    assert held(cache) == want
    assert cache.compact(4) == "000000000001" and held(cache) == want
    cache.append(rows(spark, ("n", "b", "0")))
    want[2] = ("n", "b", "0")
    assert held(cache) == want
    # A batch that was merged and is read once more changes nothing, nor does a version that was not written to its end.
    write(tmp_path / "c d+/versions/000000000009", "nowhere\nand so on")
    assert held(cache) == want and cache.compact(4) == "000000000002"
    assert cache.vacuum() == 4 and held(cache) == want and cache.compact() is None
    assert len(store.names(spark, f"{tmp_path}/c d+/base")) == 1


def test_cache_of_two_writers(spark, tmp_path):
    cache = ReplyCache(spark, str(tmp_path / "c"))
    threads = [threading.Thread(target=cache.append, args=(rows(spark, ("n", "k", str(i)), ("n", f"k{i}", "v")),)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(held(cache)) == 5
    (tmp_path / "c/versions").mkdir()
    write(tmp_path / "c/versions/000000000001", "half")  # another's claim to the next version
    assert cache.compact() is None and len(held(cache)) == 5 and len(store.names(spark, f"{tmp_path}/c/base")) == 0


def test_repeated_keys_give_one_report_row(spark, tmp_path):
    """Two appends of one key: the verifiers neither fail nor double rows, and the last reply counts."""
    samples = spark.createDataFrame([("s1", "d", "v = v0 + 3", None, "E = h * f1")], "id string, dataset string, question string, context string, prediction string")
    reply = lambda m: lambda: judge.ScriptedClient(lambda p: json.dumps([{"severity": "error", "message": m}]))
    cache = ReplyCache(spark, str(tmp_path / "c"))
    for run in (verify.by_model, lambda s, c, f, m, n: verify.by_rules(s, ["formula_correctness"], c, f, m, n)):
        for said in ("first", "second"):
            cache.append(run(samples, inference.read_cache(spark, None), reply(said), "m", 9)[1])
        report, fresh = run(samples, inference.read_cache(spark, str(tmp_path / "c")), judge.NoClient, "m", 9)
        (row,) = report.collect()
        assert [d["message"] for d in row.diagnostics] == ["second"] and fresh.count() == 0


# --- documents and workbooks


def fragments(spark, rows):
    return spark.createDataFrame(rows, "file string, section int, at long, name string, body string")


def put(spark, rows, folder):
    return documents.write(fragments(spark, rows).repartition(3), str(folder), statistics.ORDER)


def test_documents_are_renamed_backed_up_or_left(spark, tmp_path):
    base = tmp_path / "o u+t"
    one = [("a b/x.json", 0, 0, "", "["), *[("a b/x.json", 1, k, "", json.dumps({"k": k, "t": "é\n" * 3})) for k in range(500)], ("a b/x.json", 2, 0, "", "]"), ("é.json", 0, 0, "", "{}")]
    put(spark, one, base)
    path = base / "a b/x.json"
    assert [x["k"] for x in json.loads(path.read_text())] == list(range(500)) and (base / "é.json").read_text() == "{}"
    before = path.stat().st_mtime_ns
    put(spark, one, base)
    assert path.stat().st_mtime_ns == before and sorted(p.name for p in base.rglob("*.*")) == ["x.json", "é.json"]
    old = path.read_text()
    put(spark, [*one[:-1], ("a b/x.json", 3, 0, "", "\n")], base)
    assert (base / "a b/x.json.backup").read_text() == old and path.read_text() == old + "\n"


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = fragments(spark, [("x.xlsx", 0, 0, "", '{"columns": ["a"]}'), ("x.xlsx", 1, 0, "", "no json"), ("y.json", 0, 0, "", "{}")]).coalesce(1)
    with pytest.raises(Exception, match="Expecting value|JSONDecodeError"):
        documents.write(rows, str(tmp_path / "out"), statistics.ORDER)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".writing")]


def test_workbooks_round_trip(spark, tmp_path):
    texts = ["", "a\x00b\x1f", "_x0041_", "é😀", "<&>\"'", "x" * 40_000, " lead", "r\r\nn", "￾"]
    head = json.dumps({"columns": ["n", "t", "b", "x"], "spread": ["r1", "r 2"], "suffix": "_score", "blank": 0.0})
    rows = [("d/m.xlsx", 0, 0, "", head)]
    rows += [("d/m.xlsx", 1, k, "", json.dumps({"n": k, "t": t, "b": k % 2 == 0, "x": k / 4 if k else None, "spread": {"r 2": 1.5} if k else None})) for k, t in enumerate(texts)]
    put(spark, rows, tmp_path)
    table = inference.load(spark, f"{tmp_path}/d/m.xlsx")
    assert [(f.name, f.dataType.simpleString()) for f in table.schema] == [("n", "bigint"), ("t", "string"), ("b", "boolean"), ("x", "double"), ("r1_score", "double"), ("r 2_score", "double")]
    got = table.orderBy("n").collect()
    assert [r.t for r in got] == texts and [r.x for r in got][:3] == [None, 0.25, 0.5] and [r["r 2_score"] for r in got][:2] == [0.0, 1.5] and got[0].r1_score == 0.0


def test_workbooks_of_many_rows_go_on_in_another_sheet(monkeypatch):
    import io
    import zipfile

    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    out = io.BytesIO()
    book = workbooks.Writer(out, ["a"])
    for k in range(5):
        book.row([k])
    book.close()
    assert sorted(n for n in zipfile.ZipFile(out).namelist() if "sheets/" in n) == [f"xl/worksheets/sheet{k}.xml" for k in (1, 2, 3)]
    assert [r[0][1] for r in workbooks.rows(out.getvalue())] == ["a", "0", "1"]
    assert [workbooks.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and workbooks.column_number("ZZ12") == 701


def test_workbooks_of_other_programs(spark, tmp_path):
    """Shared texts with runs and notes, dates by format, formulas, errors, gaps, repeated names."""
    import zipfile

    main = workbooks.MAIN
    sheet = f"""<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row>
     <row r="3"><c r="A3" s="1"><v>45000.5</v></c><c r="B3" t="str"><f>1</f><v>said</v></c><c r="C3"><v>1.5E2</v></c></row>
     <row r="4"><c r="A4" s="2"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c></row></sheetData></worksheet>"""
    shared = f'<sst xmlns="{main}"><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t>t_x0041_</t></si></sst>'
    styles = f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    book = f'<workbook xmlns="{main}" xmlns:r="{workbooks.RELATIONS}"><sheets><sheet name="s" sheetId="1" r:id="rId7"/></sheets></workbook>'
    links = '<Relationships xmlns="x"><Relationship Id="rId7" Target="/xl/worksheets/other.xml"/></Relationships>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for name, body in {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/other.xml": sheet, "xl/sharedStrings.xml": shared, "xl/styles.xml": styles}.items():
            z.writestr(name, body)
    table = workbooks.read(spark, str(tmp_path / "b.xlsx"))
    assert table.columns == ["name", "tA", "name.1"]
    assert [tuple(map(str, r)) for r in table.collect()] == [("None", "None", "None"), ("2023-03-15 12:00:00", "said", "150.0"), ("1899-12-31 00:00:00", "None", "None")]


# --- statistics over runs


@pytest.fixture(scope="module")
def two_datasets(tmp_path_factory):
    root = tmp_path_factory.mktemp("two")
    problem = lambda i, said, points=2: {"id": i, "question": "Q" * 120, "context": "c", "prediction": f"\\boxed{{{said}}}", "answer": ["1"], "points": [points]}
    write(root / "D 1/M/a.json", json.dumps([problem("x", 1), problem("y", 5), {"id": "z", "answer": "1"}], indent=2))
    write(root / "D 1/M/b+.json", json.dumps([problem("x", 1), problem("y", 1)], indent=2))
    write(root / "E/M/only.json", [problem("x", 1, 3)])
    write(root / "F/M/bad.json", "[1")
    return root


def files_below(folder, ending):
    return {str(p.relative_to(folder)): p for p in folder.rglob(f"*{ending}")}


def test_statistics_round_trip(spark, two_datasets, tmp_path):
    """One job writes each dataset's document and workbooks; the repair reads them; a second repair changes nothing."""
    out = tmp_path / "eval"
    engine = evaluate.Engine(spark, str(two_datasets), str(out))
    pairs = spark.createDataFrame([("D 1", "M"), ("E", "M"), ("F", "M"), ("none", "M")], "dataset string, model string")
    found, told = engine.multi_run_pairs(pairs)
    assert {r.dataset: (r.num_runs, r.error) for r in told.collect()} == {"D 1": (2, None), "E": (1, None), "F": (None, "no readable problems"), "none": (None, "no readable problems")}
    engine.save_multi_run(found)
    assert sorted(files_below(out, ".json")) == ["D 1/M/multi_run_statistics.json", "E/M/multi_run_statistics.json"] and len(files_below(out, ".xlsx")) == 8
    one = json.loads((out / "D 1/M/multi_run_statistics.json").read_text())
    assert (one["dataset_key"], one["num_runs"], one["run_files"]) == ("D 1/M", 2, ["a", "b+"])
    assert list(one["question_statistics"]) == ["x", "y", "z"] and one["question_statistics"]["z"]["statistics"] == {} and one["question_statistics"]["z"]["runs"] == {}
    y = one["question_statistics"]["y"]
    assert y["runs"]["b+"]["earned_score"] == 2.0 and y["statistics"]["mean_score"] == 1.0 and y["points"] == [2.0] and y["context"] == "c" and len(y["question"]) == 120
    assert one["overall_statistics"]["num_runs"] == 2 and set(one["run_results"]) == {"a", "b+"} and one["run_results"]["a"]["total_score"] == 2.0
    table = inference.load(spark, f"{out}/D 1/M/question_statistics.xlsx")
    assert table.columns == [*statistics.QUESTION_COLUMNS, "a_score", "b+_score"] and [tuple(r)[-2:] for r in table.orderBy("question_id").collect()] == [(2, 2), (0, 2)]
    assert inference.load(spark, f"{out}/E/M/run_summary.xlsx").first().total_score == 3
    stored = spark.read.parquet(str(next(out.glob("question_statistics_*"))))
    assert {(r.dataset, r.model, r.question_id, r.num_runs) for r in stored.collect()} == {("D 1", "M", "x", 2), ("D 1", "M", "y", 2), ("D 1", "M", "z", 0), ("E", "M", "x", 1)}

    written = repair.write(spark, str(out))
    first = next(tmp_path.glob("eval_repaired_*"))
    assert sorted(files_below(first, "multi_run_statistics.json")) == sorted(files_below(out, "multi_run_statistics.json"))
    again = json.loads((first / "D 1/M/multi_run_statistics.json").read_text())
    assert again["question_statistics"]["y"]["statistics"]["median_score"] == 1.0 and again["question_statistics"]["y"]["runs"]["b+"]["prediction"] == "\\boxed{1}"
    assert again["overall_statistics"]["total_runs"] == 4 and again["run_results"] == one["run_results"] and again["question_statistics"]["z"] == one["question_statistics"]["z"]
    assert spark.read.parquet(written["summary"]).count() == 2
    repair.write(spark, str(first))
    second = next(tmp_path.glob("eval_repaired_*_repaired_*"))
    for name, path in files_below(first, "multi_run_statistics.json").items():
        assert (second / name).read_bytes() == path.read_bytes()
    assert inference.load(spark, f"{second}/E/M/question_statistics.xlsx").columns == ["question_id", "question", "max_points", "mean_score", "std_score", "min_score", "max_score", "median_score", "score_rate", "num_runs", "only_score"]


def test_repair_keeps_what_it_does_not_know(spark, tmp_path):
    document = {"dataset_key": "D", "other": {"a": [1, None, "é"]}, "question_statistics": {"q": {"max_points": 2, "note": None, "mean_score": 9, "statistics": {"own": 1, "mean_score": 9}, "runs": {"r": {"fine_grained_score": 1, "coarse_grained_score": 2, "earned_score": 0, "prediction": "p"}}}, "n": {"max_points": 1}}, "overall_statistics": {"mean_score": 9}}
    write(tmp_path / "in/a/x_multi_run_statistics.json", json.dumps(document, indent=4))
    write(tmp_path / "in/b/multi_run_statistics.json", {"dataset_name": "none", "overall_statistics": {"kept": 1}})
    write(tmp_path / "in/c/multi_run_statistics.json", "{broken")
    repair.write(spark, str(tmp_path / "in"))
    base = next(tmp_path.glob("in_repaired_*"))
    got = json.loads((base / "a/x_multi_run_statistics.json").read_text())
    assert got["other"] == document["other"] and got["question_statistics"]["n"] == {"max_points": 1}
    q = got["question_statistics"]["q"]
    assert q["runs"]["r"] == {"fine_grained_score": 1, "coarse_grained_score": 2, "earned_score": 2.0, "prediction": "p"}
    assert q["statistics"]["own"] == 1 and q["statistics"]["mean_score"] == 2.0 and q["mean_score"] == 2.0 and q["note"] is None and q["statistics"]["score_rate"] == 100.0
    assert got["overall_statistics"]["max_score"] == 2.0 and json.loads((base / "b/multi_run_statistics.json").read_text()) == {"dataset_name": "none", "overall_statistics": {"kept": 1}}
    assert not (base / "c").exists()


def test_detailed_workbooks(spark, two_datasets, tmp_path):
    engine = evaluate.Engine(spark, str(two_datasets), str(tmp_path))
    results, totals = engine.evaluate("D 1", "M", "a")
    engine.save(results, totals)
    table = inference.load(spark, f"{tmp_path}/D 1/M/a_detailed.xlsx")
    assert [(r.question_id, r.earned_points, r.extracted_prediction) for r in table.orderBy("question_id").collect()] == [("x", 2, "1"), ("y", 0, "5")] and "points" in table.columns
