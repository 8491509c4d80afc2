"""Registered queries that go through files: written from the driver's tables in the shared folder, then read as a user's files are."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import calls, catalog, judge, scores
from gradeloom.plans import evaluate, repair, verify
from gradeloom.queries import LINES, SOLUTIONS, TOKENS, _query, _samples
from gradeloom.sources import documents, inference, sinks, staging, statistics, workbooks
from gradeloom.sources.cache import ReplyCache


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging.folder(spark)}/gradeloom/{name} {uuid.uuid4().hex}"


def _run_files(spark: SparkSession, sf_dir: str) -> str:
    """Inference files of the parts, two runs of each: their size tells the dataset, their brand the model; names hold blanks and signs."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    runs = part.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    box = F.concat(F.lit("so \\boxed{"), F.when(F.col("run") == 1, F.col("p_size")).otherwise(F.col("p_size") % 7).cast("string"), F.lit("}"))
    fields = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), box.alias("prediction"), F.col("p_size").cast("string").alias("answer"), (F.col("p_partkey") % 3 + 1).alias("points"))
    file = F.concat(F.lit("set "), F.col("p_size") % 4, F.lit("/"), F.col("p_brand"), F.lit("/run+"), F.col("run"), F.lit(" %.json"))
    rows = statistics.rows(runs, file, 1, F.to_json(fields), at=F.col("p_partkey"))
    ends = [statistics.rows(runs.select(file.alias("file")).distinct(), F.col("file"), k, F.lit(s)) for k, s in ((0, "[\n"), (2, "\n]"))]
    return documents.write(statistics.union([*ends, rows]), _folder(spark, "inference"), statistics.ORDER)


#: Each part in each run: its place in the file and its score.
RUNS = """with x as (select concat('set ', cast(p_size % 4 as varchar)) as dataset, p_brand as model, concat('run+', cast(run as varchar), ' %') as run_id, row_number() over (partition by p_size % 4, p_brand, run order by p_partkey) - 1 as idx, p_partkey, p_name,
 case when run = 1 or p_size < 7 then p_partkey % 3 + 1 else 0 end::double as score, (p_partkey % 3 + 1)::double as points from part, (select unnest([1, 2]) as run))"""


@_query("files_scored", None, RUNS + " select dataset, model, run_id, cast(idx as integer) as idx, cast(p_partkey as varchar) as question_id, p_name as question, score as earned, points as max_points from x")
def _(spark, sf_dir):
    """Every run file through the engine's readers."""
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), "")
    found = evaluate.score_problems(inference.problems(engine.files()))
    return found.select("dataset", "model", "run_id", "idx", "question_id", "question", F.col("earned_points").alias("earned"), "max_points")


@_query("files_newest_scored", None, RUNS + " select dataset, model, sum(score) as total_score, sum(points) as max_possible_score, count(*) as total_count, '' as error from x where run_id = 'run+2 %' group by dataset, model")
def _(spark, sf_dir):
    """The newest run of each dataset; both runs are as old, so the greater name counts."""
    root = _run_files(spark, sf_dir)
    engine = evaluate.Engine(spark, root, "")
    same_time = engine.files().withColumn("modified", F.lit(0))
    chosen = inference.newest(same_time, ["dataset", "model"])
    results = evaluate.score_problems(inference.problems(chosen))
    pairs = catalog.found(same_time)
    totals = scores.dataset_score(results, ["dataset", "model"])
    return pairs.join(totals, ["dataset", "model"], "left").select("dataset", "model", "total_score", "max_possible_score", "total_count", F.when(F.col("total_count").isNull(), "no readable problems").otherwise("").alias("error"))


def _statistics(spark: SparkSession, sf_dir: str) -> str:
    """The folder of what the engine writes of all datasets' runs."""
    out = _folder(spark, "evaluation")
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), out)
    found, _told = engine.multi_run_pairs(catalog.found(engine.files()))
    engine.save_multi_run(found)
    return out


@_query("repaired_statistics", None, RUNS + " select concat(dataset, '/', model) as dataset, cast(p_partkey as varchar) as question_id, count(*) as num_runs, round_even(avg(score), 4) as mean_score, round_even(median(score), 4) as median_score, round_even(stddev_pop(score), 4) as std_score, max(points) as max_points, round_even(round_even(avg(score), 4) / max(points) * 100, 2) as score_rate, max(case when run_id = 'run+2 %' then score end) as second from x group by dataset, model, p_partkey")
def _(spark, sf_dir):
    """Statistics documents as they are written, repaired, and read from the repaired documents."""
    root = _statistics(spark, sf_dir)
    files, base = inference.statistics_files(spark, root), _folder(spark, "repaired")
    documents.write(repair.documents_of(files, repair.plain_root(spark, root)), base, statistics.ORDER)
    rows, get = repair.asked(inference.statistics_files(spark, base)), F.try_variant_get
    told = lambda name: get("q", f"$.statistics.{name}", "double").alias(name)
    runs = get("q", "$.runs", "map<string,variant>")
    second = get(F.try_element_at(runs, F.lit("run+2 %")), "$.earned_score", "double")
    return rows.select("dataset", "question_id", told("num_runs").cast("long").alias("num_runs"), told("mean_score"), told("median_score"), told("std_score"), get("q", "$.max_points", "double").alias("max_points"), told("score_rate"), second.alias("second"))


@_query("run_workbooks", None, RUNS + " select concat(dataset, '/', model) as dataset, cast(p_partkey as varchar) as question_id, p_name as question, round_even(avg(score), 2) as mean_score, max(case when run_id = 'run+1 %' then score end) as first, max(case when run_id = 'run+2 %' then score end) as second from x group by dataset, model, p_partkey, p_name")
def _(spark, sf_dir):
    """The workbook of questions of each dataset and model, from one plan; a column a run."""
    cells = workbooks.cells(spark, f"{_statistics(spark, sf_dir)}/*/*/question_statistics.xlsx")
    value = lambda k: F.col("cells")[k]["value"]
    key = F.regexp_extract(inference.decoded(F.col("path")), "([^/]+/[^/]+)/[^/]+$", 1)
    return cells.filter("row > 0").select(key.alias("dataset"), value(0).alias("question_id"), value(1).alias("question"), value(3).cast("double").alias("mean_score"), value(9).cast("double").alias("first"), value(10).cast("double").alias("second"))


@_query("cached_replies", None, "select event_type as namespace, cast(user_id as varchar) as key, cast(max_by(value, event_id % 4 * 1000000000 + event_id) as double) as value from events group by event_type, user_id")
def _(spark, sf_dir):
    """All events as replies in four appends, three of them merged before the last; of a key's replies the last counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cache = ReplyCache(spark, _folder(spark, "cache"))
    for k in range(4):
        own = events.filter(F.col("event_id") % 4 == k).groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("value"))
        cache.append(own.select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").alias("value")))
        if k == 2:
            cache.compact(8)
    return cache.read().select("namespace", "key", F.col("value").cast("double").alias("value"))


@_query("lookup_of_repeats", None, "select p_partkey as id, c.value from part p left join (select cast(user_id as varchar) as k, max_by(event_type, event_id % 2 * 1000000000 + event_id) as value from events group by user_id) c on c.k = cast(p.p_partkey as varchar)")
def _(spark, sf_dir):
    """Payloads looked up in a log in which keys are written twice: one row a payload."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cache = ReplyCache(spark, _folder(spark, "cache"))
    for k in range(2):
        own = events.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("value"))
        cache.append(own.select(F.lit("n").alias("namespace"), F.col("user_id").cast("string").alias("key"), "value"))
    payloads = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("n").alias("namespace"), F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("id"))
    return judge.lookup(payloads, cache.read()).select("id", "value")


@_query("large_arrays", None, RUNS + " select dataset, model, run_id, cast(idx as integer) as idx, cast(p_partkey as varchar) as question_id, score as earned from x")
def _(spark, sf_dir):
    """The same files cut in ranges of 400 bytes, as if they were large."""
    root = _run_files(spark, sf_dir)
    files = inference.keyed(inference.read_files(spark, root, recursive=True, split_bytes=0, span=400, piece=300))
    found = evaluate.score_problems(inference.problems(files))
    return found.select("dataset", "model", "run_id", "idx", "question_id", F.col("earned_points").alias("earned"))


BOX = "concat('so ', chr(92), 'boxed{', cast(case when run = 1 then p_size else p_size % 7 end as varchar), '}')"
WITH_TEXTS = RUNS.replace(" from part,", f", {BOX} as said, concat(chr(92), 'boxed{{', cast(p_size as varchar), '}}') as gold, cast(case when run = 1 then p_size else p_size % 7 end as varchar) as got from part,")


@_query("detailed_problems", None, WITH_TEXTS + """ select concat(dataset, '/', model) as source, cast(p_partkey as varchar) as id, '' as context, p_name as question, '' as solution, '' as marking, '[]' as marking_detailed_scores,
 gold as answer, 'Open-End' as answer_type, '' as unit, cast(points as varchar) as points, 'text' as modality, '' as field, '' as subfield, said as test_result, concat(chr(92), 'boxed{', got, '}') as test_answer, 0.0::double as fine_grained_score, score as coarse_grained_score, score as earned_points from x""")
def _(spark, sf_dir):
    """All 19 columns of the detailed table, as it is written and read again."""
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), "")
    results = evaluate.score_problems(inference.problems(engine.files()))
    table = sinks.detailed(results).withColumn("marking", F.coalesce(F.to_json("marking"), F.lit("")))
    again = spark.read.schema(table.schema).json(sinks.write_table(table, _folder(spark, "detailed"), "json"))
    joined = [F.array_join(c, "|").alias(c) for c in ("answer", "answer_type", "unit", "test_answer")] + [F.array_join(F.transform("points", lambda p: p.cast("string")), "|").alias("points")]
    plain = ["source", "id", "context", "question", "solution", "marking", "modality", "field", "subfield", "test_result", "fine_grained_score", "coarse_grained_score", "earned_points"]
    return again.select(*plain, F.to_json("marking_detailed_scores").alias("marking_detailed_scores"), *joined)


OVERALL = RUNS + """, d as (select dataset, model, run_id, sum(score) as t, sum(points) as m from x group by all), e as (select dataset, model, count(*) as num_runs, round_even(avg(t), 2) as mean_total_score, round_even(stddev_pop(t), 2) as std_total_score,
 round_even(min(t), 2) as min_total_score, round_even(max(t), 2) as max_total_score, round_even(avg(round_even(t / m * 100, 2)), 2) as mean_score_rate from d group by all), q as (select dataset, model, p_partkey, round_even(avg(score), 2) as a, max(points) as p from x group by all)
 select concat(dataset, '/', model) as dataset_key, num_runs, mean_total_score, std_total_score, min_total_score, max_total_score, mean_score_rate, num_questions, question_based_mean_score, question_based_max_score from e
 join (select dataset, model, count(*) as num_questions, round_even(sum(a), 2) as question_based_mean_score, round_even(sum(p), 2) as question_based_max_score from q group by all) using (dataset, model)"""


@_query("multi_run_report", None, OVERALL)
def _(spark, sf_dir):
    """The report over runs of all datasets, as it is written and read again."""
    out = _folder(spark, "evaluation")
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), out)
    found, _told = engine.multi_run_pairs(catalog.found(engine.files()))
    engine.save_multi_run_summary(found["overall"])
    again = spark.read.option("multiLine", True).json(f"{out}/all_datasets_multi_run_summary.json")
    own = ["mean_total_score", "std_total_score", "min_total_score", "max_total_score", "mean_score_rate", "question_based_mean_score", "question_based_max_score"]
    return again.select("dataset_key", "num_runs", "num_questions", *[F.col(c).cast("double").alias(c) for c in own])


@_query("summary_report", None, RUNS + """, d as (select dataset, model, sum(score) as t, sum(points) as m, count(*) as n from x where run_id = 'run+2 %' group by all) select concat(dataset, '/', model) as dataset_key, t as total_score, m as max_possible_score, round_even(t / m * 100, 2) as score_rate, n as total_questions, g as grand_total, num_datasets
 from d, (select round_even(sum(t), 2) as g, count(*) as num_datasets from d)""")
def _(spark, sf_dir):
    """K5, K6, M8, A5: the summary of all datasets and its table, as they are written and read again."""
    out = _folder(spark, "evaluation")
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), out)
    newest = inference.newest(engine.files().withColumn("modified", F.lit(0)), ["dataset", "model"])
    totals = scores.dataset_score(evaluate.score_problems(inference.problems(newest)), ["dataset", "model", "run_id"]).withColumn("error", F.lit(None).cast("string"))
    engine.save_summary(totals)
    read = lambda name: spark.read.option("multiLine", True).json(f"{out}/{name}.json")
    grand = read("all_datasets_summary").select(F.col("overall.grand_total_score").cast("double").alias("grand_total"), F.col("overall.num_datasets").alias("num_datasets"))
    table = read("summary_table")
    # One row of the report.
    return table.select("dataset_key", *[F.col(c).cast("double").alias(c) for c in ("total_score", "max_possible_score", "score_rate")], "total_questions").join(F.broadcast(grand))


@_query("run_logs", None, WITH_TEXTS + " select concat(dataset, '/', model) as dataset, concat('problem ', cast(idx + 1 as varchar), ' (', cast(p_partkey as varchar), '), ', cast(points as varchar), ' points') as first, concat('read as answers: ', got) as answers, concat('fine 0.0, coarse ', cast(score as varchar), ', earned ', cast(score as varchar)) as last from x")
def _(spark, sf_dir):
    """The log files of verbose runs, problem by problem."""
    out = _folder(spark, "evaluation")
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), out, verbose=True)
    engine.save_logs(engine._scored(engine.files()))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").text(out, wholetext=True).select(inference.decoded(F.col("_metadata.file_path")).alias("path"), "value")
    problems = text.select("path", F.explode(F.split("value", "\n\n")).alias("p")).filter("p <> ''").withColumn("lines", F.split("p", "\n"))
    line = lambda k: F.element_at("lines", k)
    return problems.select(F.regexp_extract("path", "([^/]+/[^/]+)/[^/]+$", 1).alias("dataset"), line(1).alias("first"), line(-2).alias("answers"), line(-1).alias("last"))


class Moody:
    """A client that refuses some prompts and answers others, as an example."""

    def working(self) -> bool:
        return True

    def generate(self, prompt: str) -> str:
        if prompt.endswith("3"):
            raise calls.Refused("not this one")
        return f" {prompt}! "


@_query("call_failures", None, "select p_partkey as id, case when p_partkey % 10 <> 3 then concat(p_brand, ' ', cast(p_partkey as varchar), '!') else '' end as reply, case when p_partkey % 10 = 3 then 'not this one' else '' end as error from part")
def _(spark, sf_dir):
    """Calls in pools with a journal; what was refused has an error and no reply."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_partkey").alias("prompt"))
    said = calls.call(asked, Moody, policy=calls.Policy(workers=8), parallelism=8)
    return said.select("id", F.coalesce("reply", F.lit("")).alias("reply"), F.coalesce("call_error", F.lit("")).alias("error"))


@_query("sample_files", None, WITH_TEXTS + " select concat(dataset, '/', model) as dataset, run_id, cast(idx as integer) as idx, cast(p_partkey as varchar) as id, p_name as question, said as prediction, cast(p_size as varchar) as answer from (select x.*, p.p_size from x join part p using (p_partkey))")
def _(spark, sf_dir):
    """The verifiers' samples of every run file; the rest is meta."""
    engine = evaluate.Engine(spark, _run_files(spark, sf_dir), "")
    found = inference.samples(engine.files())
    return found.select("dataset", "run_id", "idx", "id", "question", "prediction", F.try_element_at("meta", F.lit("answer")).alias("answer"))


@_query("loaded_workbook", None, "select p_partkey, p_name, p_size, p_retailprice, p_size > 25 as large from part")
def _(spark, sf_dir):
    """S3, K4: a table as a workbook and back, with the types of its columns."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large"))
    file = F.lit("a b/part.xlsx")
    head = statistics.rows(part.limit(1), file, 0, statistics.book_head(part.columns))
    rows = statistics.rows(part, file, 1, F.to_json(F.struct(*part.columns)), at=F.col("p_partkey"))
    out = documents.write(head.unionByName(rows), _folder(spark, "workbook"), statistics.ORDER)
    found = inference.load(spark, f"{out}/a b/part.xlsx")
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in part.schema.fields])


@_query("verifier_inputs", SOLUTIONS, """select r.id, concat(chr(10), chr(10), text_all) as text, cast(coalesce(s.n, 0) as integer) as symbols, cast(coalesce(l.n, 0) as integer) as formulas, cast(coalesce(s.n, 0) as integer) as counted from r left join (select id, count(*) as n from sym group by id) s using (id)
 left join (select id, count(*) filter (regexp_matches(raw, '[A-Za-z0-9_)\\]}]\\s*(=|≈|∝|~)\\s*[-+A-Za-z0-9_(\\[{]')) as n from ln group by id) l using (id)""", TOKENS + LINES)
def _(r):
    """What a rule that asks a model is given of each sample."""
    told = F.parse_json(verify.rule_inputs())
    rows = verify.prepared(_samples(r)).select(F.col("id").cast("long").alias("id"), told.alias("v"))
    size = lambda name: F.size(F.variant_get("v", f"$.{name}", "array<variant>"))
    return rows.select("id", F.variant_get("v", "$.text", "string").alias("text"), size("symbols").alias("symbols"), size("formulas_structured").alias("formulas"), size("sym_stats").alias("counted"))
