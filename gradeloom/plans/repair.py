"""Recomputing statistics that were written before (M9-M11): new versions beside the old ones, nothing overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import scores
from gradeloom.sources import documents, inference, sinks, statistics, store
from gradeloom.sources.staging import drop_staged, large, stage, staged

ENTRIES = "map<string,variant>"

def asked(statistics_files: DataFrame, *columns: str) -> DataFrame:
    """Statistics files (path, statistics variant, and columns of a whole file) as a row a question: its number in the file, its id and what is told of it.

    An outer explode, and what it makes of files without questions left out after: before an inner one Spark asks whether there are any, and reads the document again for that.
    """
    get = F.try_variant_get
    # What is told of a whole file is a column before the explode, so no row carries the document it is of.
    files = statistics_files.select("path", *columns, F.coalesce(get("statistics", "$.dataset_name", "string"), get("statistics", "$.dataset_key", "string"), F.lit("Unknown")).alias("dataset"), get("statistics", "$.question_statistics", ENTRIES).alias("all"))
    return files.select("path", *columns, "dataset", F.posexplode_outer("all").alias("at", "question_id", "q")).filter("question_id is not null")


def opened(statistics: DataFrame) -> DataFrame:
    """Statistics files (path, statistics variant) as result rows, with earned = max(fine, coarse)."""
    return run_rows(asked(statistics))


def run_rows(questions: DataFrame) -> DataFrame:
    """A row a run of each question of asked(), and one of questions without runs."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    questions = questions.select("path", "dataset", "question_id", get("q", "$.question", "string").alias("question"), F.coalesce(get("q", "$.max_points", "double"), F.lit(0.0)).alias("max_points"), get("q", "$.runs", ENTRIES).alias("all"))
    runs = questions.select("path", "dataset", "question_id", "question", "max_points", F.explode_outer("all").alias("run_id", "r"))
    fine, coarse = (F.coalesce(get("r", f"$.{n}", "double"), F.lit(0.0)) for n in ("fine_grained_score", "coarse_grained_score"))
    return runs.select("path", "dataset", "question_id", "question", "run_id", "max_points", fine.alias("fine_grained_score"), coarse.alias("coarse_grained_score"), scores.earned(fine, coarse).alias("earned_points"), F.when(F.col("run_id").isNull(), "no runs").alias("error"))


def repaired(rows: DataFrame) -> dict[str, DataFrame]:
    """A6, A7, A8 and A10 of opened statistics."""
    questions = rows.groupBy("dataset", "question_id").agg(F.max("max_points").alias("max_points"))
    real = rows.filter("run_id is not null")
    return {
        "questions": scores.question_stats(real, ["dataset", "question_id"], 4, True),
        "overall": scores.pooled_stats(real, ["dataset"]),
        "runs": scores.run_summary(real, questions),
        "summary": scores.summary_by_file(real, questions),
    }


def rewritten(rows: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """One row a question of each statistics file, with its runs and its statistics anew; questions without runs have none."""
    run = F.struct("fine_grained_score", "coarse_grained_score", F.col("earned_points").alias("earned_score"))
    questions = rows.groupBy("path", "dataset", "question_id").agg(F.first("question").alias("question"), F.max("max_points").alias("max_points"), F.array_sort(F.collect_list(F.when(F.col("run_id").isNotNull(), F.struct("run_id", run.alias("r"))))).alias("runs"))
    stats = found["questions"].select("dataset", "question_id", F.struct(*[c for c in found["questions"].columns if c not in ("dataset", "question_id")]).alias("statistics"))
    return questions.withColumn("runs", F.map_from_entries("runs")).join(large(stats), ["dataset", "question_id"], "left")


#: What a repair writes anew beside a question's own fields, besides its runs and statistics.
TOP = ["mean_score", "std_score", "min_score", "max_score", "median_score"]
NEW = [f"{m}{k}_score" for k in scores.SCORES for m in ("mean", "std", "min", "max", "median")]


def _inner(listed: Column) -> Column:
    """A JSON object's text without its braces."""
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _joined(*parts: Column) -> Column:
    """Parts of an object, those that are empty left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), ",")


def _without(entries: Column, names: list[str]) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(names))


def plain_root(spark: SparkSession, root: str) -> str:
    """A folder's path without its store, as it stands in the paths of the files below it."""
    return store.qualified(spark, root).rstrip("/").partition(":")[2].lstrip("/")


def documents_of(statistics_files: DataFrame, root: str) -> DataFrame:
    """Each statistics file anew, as rows for documents.write(): all its fields, with earned scores, each question's statistics and
    the overall ones recomputed. Questions without runs, and the overall statistics of a file without any, stay as they are."""
    get, entries = F.try_variant_get, ENTRIES
    file = F.substr(F.col("path"), F.instr(F.col("path"), F.lit(root)) + len(root) + 1)
    files = statistics_files.withColumn("file", file)
    # A document is read for its questions and for the rest; each later step reads rows of one question, not whole documents again.
    every = stage(asked(files, "file"), "asked")
    told = files.select("path", "file", F.col("statistics").isNotNull().alias("readable"), get("statistics", "$", entries).alias("top"), get("statistics", "$.overall_statistics", "variant").alias("before"))
    told = told.select("path", "file", "readable", _without(F.col("top"), ["question_statistics", "overall_statistics"]).alias("top"), F.map_contains_key("top", F.lit("question_statistics")).alias("has"), "before")
    top = stage(told, "told").filter("readable")
    real = run_rows(every).filter("run_id is not null")
    own = scores.question_stats(real, ["path", "question_id"], 4, True)
    overall = scores.pooled_stats(real, ["path"])
    earned = lambda r: scores.earned(*(F.coalesce(get(r[n], "$", "double"), F.lit(0.0)) for n in ("fine_grained_score", "coarse_grained_score")))
    again = lambda _, r: F.map_concat(_without(r, ["earned_score"]), F.create_map(F.lit("earned_score"), earned(r).cast("variant")))
    runs = F.to_json(F.transform_values(get("q", "$.runs", f"map<string,{entries}>"), again))
    before = F.coalesce(get("q", "$.statistics", entries), F.create_map().cast(entries))
    told = F.concat(F.lit("{"), _joined(_inner(F.to_json(_without(before, [*NEW, "score_rate", "num_runs"]))), _inner(F.to_json(F.struct(*NEW, "score_rate", "num_runs")))), F.lit("}"))
    rest = _inner(F.to_json(_without(get("q", "$", entries), ["runs", "statistics", *TOP])))
    anew = F.concat(F.lit("{"), _joined(rest, F.concat(F.lit('"runs":'), runs), F.concat(F.lit('"statistics":'), told), _inner(F.to_json(F.struct(*TOP)))), F.lit("}"))
    question = statistics.entry(F.col("question_id"), F.when(F.col("num_runs").isNull(), F.to_json("q")).otherwise(anew))
    questions = every.join(large(own), ["path", "question_id"], "left")
    all_ = top.join(overall.select("path", F.to_json(F.struct(*[c for c in overall.columns if c != "path"])).alias("overall")), "path", "left")
    kept, has = F.coalesce("overall", F.to_json("before")), F.col("has")
    opens = F.concat(F.lit("{\n"), _joined(_inner(F.to_json("top")), F.when(has, F.lit('\n"question_statistics": {\n')).otherwise("")))
    ends = F.concat(F.when(has, "\n}").otherwise(""), F.coalesce(F.concat(F.lit(',\n"overall_statistics": '), kept), F.lit("")), F.lit("\n}\n"))
    at = F.col("file")
    return statistics.union([statistics.rows(all_, at, 0, opens), statistics.rows(questions, at, 1, question, F.col("question_id"), F.col("at")), statistics.rows(all_, at, 2, ends)])


def books_of(rows: DataFrame, root: str) -> DataFrame:
    """The workbooks of each statistics file, in its folder, as rows for documents.write()."""
    file = F.substr(F.col("path"), F.instr(F.col("path"), F.lit(root)) + len(root) + 1)
    in_folder = lambda name: F.concat(F.regexp_extract("file", "^(.*/)?", 0), F.lit(name))
    rows = rows.withColumn("file", file)
    real, keys = rows.filter("run_id is not null"), ["file"]
    own = scores.question_stats(real, [*keys, "question_id"], 4, True)
    titles = rows.groupBy(*keys, "question_id").agg(F.max("max_points").alias("max_points"), F.first("question").alias("question"))
    questions = titles.join(large(own), [*keys, "question_id"]).join(large(statistics.by_run(real, keys)), [*keys, "question_id"]).withColumn("at", F.lit(0))
    runs = real.groupBy(keys).agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    table = scores.run_summary(real, titles, "file").withColumnRenamed("file", "of")
    table = table.withColumns({"file": F.col("of"), "run_dir": F.col("run_id")}).select("file", "run_dir", "run_id", "total_score", "max_possible_score", "score_rate")
    head = statistics.rows(runs, in_folder("run_summary.xlsx"), 0, statistics.book_head(["run_dir", "total_score", "max_possible_score", "score_rate"]))
    listed = statistics.rows(table, in_folder("run_summary.xlsx"), 1, F.to_json(F.struct("run_dir", "total_score", "max_possible_score", "score_rate")), F.col("run_id"))
    return statistics.union([statistics.books(questions, runs, in_folder, ["median_score"]), head, listed])


def write(spark: SparkSession, root: str) -> dict[str, str]:
    """Recomputes all statistics below a folder into a new folder beside it; the tables that were written.

    What was there stays as it is: it is the backup. Each statistics file and its workbooks stand in the new folder where they stood in the
    old one, so a repair of the new folder finds them and changes nothing. Beside them are the statistics as lines, three tables of
    questions, the runs, the overall statistics and the summary by file.
    """
    before = staged()
    plain = plain_root(spark, root)
    files = stage(inference.statistics_files(spark, root), "statistics-files")
    rows = stage(opened(files), "statistics")
    found = repaired(rows)
    base = sinks.versioned(*f"{root.rstrip('/')}_repaired".rpartition("/")[::2])
    out = {"statistics": sinks.write_table(rewritten(rows, found), f"{base}/statistics", "json")}
    documents.write(documents_of(files, plain).unionByName(books_of(rows, plain)), base, statistics.ORDER)
    real = rows.filter("run_id is not null")
    runs = sorted(r[0] for r in real.select("run_id").distinct().collect())
    titles = rows.groupBy("dataset", "question_id").agg(F.max("max_points").alias("max_points"), X.shorten(F.first("question")).alias("question"))
    for kind, column in scores.SCORES.items():
        pivot = scores.pivot_runs(real, runs, ["dataset", "question_id"], column).withColumnsRenamed({r: f"{r}_score" for r in runs})
        own = [F.col(f"{m}{kind}_score").alias(f"{m}_score") for m in ("mean", "std", "min", "max", "median")]
        table = titles.join(large(found["questions"].select("dataset", "question_id", "num_runs", *own, "score_rate")), ["dataset", "question_id"]).join(large(pivot), ["dataset", "question_id"])
        out[f"questions{kind}"] = sinks.write_table(table, f"{base}/question_statistics{kind}")
    for name in ("overall", "runs", "summary"):
        out[name] = sinks.write_table(found[name], f"{base}/{name}")
    drop_staged(spark, before)
    return out
