"""Statistics over runs as documents and workbooks, one of each kind for a dataset and model, made of rows in one plan.

`<dataset>/<model>/multi_run_statistics.json` holds dataset_key, num_runs, run_files, question_statistics (each with its texts, its runs
and their statistics), overall_statistics and run_results: what `inference.statistics_files` reads again. Beside it are the workbooks
question_statistics, fine_grained_question_statistics, coarse_grained_question_statistics (a column a run of that dataset) and run_summary.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.sources import sinks
from gradeloom.sources.staging import large

DOCUMENT = "multi_run_statistics.json"
#: Workbooks of questions by kind of score: the suffix of its statistics, the run's field.
BOOKS = {"question_statistics": ("", "earned_points"), "fine_grained_question_statistics": ("_fine", "fine_grained_score"), "coarse_grained_question_statistics": ("_coarse", "coarse_grained_score")}
QUESTION_COLUMNS = ["question_id", "question", "max_points", "mean_score", "std_score", "min_score", "max_score", "score_rate", "num_runs"]
FULL = {"ignoreNullFields": "false"}


def quoted(value: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def entry(name: Column, body: Column) -> Column:
    return F.concat(quoted(name), F.lit(": "), body)


def rows(df: DataFrame, file: Column, section: int, body: Column, name: Column | None = None, at: Column | None = None) -> DataFrame:
    """Rows for documents.write(), within a section by `at` and then by name."""
    return df.select(file.alias("file"), F.lit(section).alias("section"), (F.lit(0) if at is None else at).cast("long").alias("at"), (F.lit("") if name is None else name).alias("name"), body.alias("body"))


ORDER = ["at", "name"]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_folder(name: str) -> Column:
    return F.concat_ws("/", "dataset", "model", F.lit(name))


def documents(found: dict[str, DataFrame]) -> DataFrame:
    """The documents' rows, of evaluate.multi_run()'s tables."""
    keys = ["dataset", "model"]
    file, runs = in_folder(DOCUMENT), found["run_scores"]
    counts = runs.groupBy(keys).agg(F.count("*").alias("n"))
    head = F.concat(F.lit('{\n"dataset_key": '), quoted(F.concat_ws("/", *keys)), F.lit(',\n"num_runs": '), F.col("n").cast("string"), F.lit(',\n"run_files": ['))
    texts = found["results"].groupBy(*keys, "question_id").agg(F.min_by(F.struct("question", "context", "answer", "points", "idx"), "run_id").alias("t"))
    own = sinks.nested_runs(found["own"], [*keys, "question_id"])
    questions = found["questions"].join(large(texts), [*keys, "question_id"], "left").join(large(own), [*keys, "question_id"], "left")
    measured = [c for c in found["questions"].columns if c not in (*keys, "question_id", "question", "max_points")]
    no_runs = F.create_map().cast(own.schema["runs"].dataType)
    about = F.to_json(F.struct("question_id", F.col("t.question").alias("question"), F.col("t.context").alias("context"), F.col("t.answer").alias("answer"), F.col("t.points").alias("points"), "max_points", F.coalesce("runs", no_runs).alias("runs")), FULL)
    told = F.when(F.col("num_runs") > 0, F.to_json(F.struct(*measured), FULL)).otherwise("{}")
    question = F.concat(about.substr(F.lit(1), F.length(about) - 1), F.lit(',"statistics":'), told, F.lit("}"))
    overall = F.to_json(F.struct(*[c for c in found["overall"].columns if c not in keys]), FULL)
    result = F.to_json(F.struct(*[c for c in runs.columns if c not in (*keys, "run_id")]), FULL)
    return union([
        rows(counts, file, 0, head), rows(runs, file, 1, quoted(F.col("run_id")), F.col("run_id")), rows(counts, file, 2, F.lit('],\n"question_statistics": {\n')),
        rows(questions, file, 3, entry(F.col("question_id"), question), F.col("question_id"), F.col("t.idx")),
        rows(found["overall"], file, 4, F.concat(F.lit('\n},\n"overall_statistics": '), overall, F.lit(',\n"run_results": {\n'))),
        rows(runs, file, 5, entry(F.col("run_id"), result), F.col("run_id")), rows(counts, file, 6, F.lit("\n}\n}\n")),
    ])


def book_head(columns: list[str], spread: Column | None = None) -> Column:
    """A workbook's first row; with a column a run where spread has their names."""
    fields = [F.array(*[F.lit(c) for c in columns]).alias("columns")]
    if spread is not None:
        fields += [spread.alias("spread"), F.lit("_score").alias("suffix"), F.lit(0.0).alias("blank")]
    return F.to_json(F.struct(*fields))


def _column(name: str, kind: str) -> Column:
    """A column of a question's workbook: measures are those of the kind of score."""
    if name == "question":
        return X.shorten(F.col(name))
    return F.col(f"{name.removesuffix('_score')}{kind}_score") if name.endswith("_score") else F.col(name)


def _score_of(name: str) -> Callable[[Column, Column], Column]:
    return lambda _, run: run[name]


def books(questions: DataFrame, runs: DataFrame, file, measured: list[str] | None = None) -> DataFrame:
    """Rows of the three workbooks of questions: questions has by_run (run -> (earned_points, fine and coarse score)), runs the runs of each."""
    extra = measured or []
    parts = []
    for name, (kind, score) in BOOKS.items():
        columns = [*QUESTION_COLUMNS[:-2], *extra, *QUESTION_COLUMNS[-2:]]
        spread = F.transform_values("by_run", _score_of(score)).alias("spread")
        parts.append(rows(runs, file(f"{name}.xlsx"), 0, book_head(columns, F.col("runs"))))
        parts.append(rows(questions, file(f"{name}.xlsx"), 1, F.to_json(F.struct(*[_column(c, kind).alias(c) for c in columns], spread), FULL), F.col("question_id"), F.col("at")))
    return union(parts)


def run_book(run_scores: DataFrame, file: Column, keys: list[str]) -> DataFrame:
    """Rows of the workbook of runs."""
    columns = [c for c in run_scores.columns if c not in keys]
    return rows(run_scores.select(keys).distinct(), file, 0, book_head(columns)).unionByName(rows(run_scores, file, 1, F.to_json(F.struct(*columns), FULL), F.col("run_id")))


def by_run(own: DataFrame, keys: list[str]) -> DataFrame:
    """A question's scores in each run, one row a question; a question has one score in a run."""
    each = F.struct("run_id", F.struct("earned_points", "fine_grained_score", "coarse_grained_score").alias("r"))
    return own.groupBy(*keys, "question_id").agg(F.map_from_entries(F.collect_list(each)).alias("by_run"))


def workbooks(found: dict[str, DataFrame]) -> DataFrame:
    """The workbooks' rows, of evaluate.multi_run()'s tables; questions that no run scored are in none."""
    keys = ["dataset", "model"]
    scored = found["questions"].filter("num_runs > 0").join(large(by_run(found["own"], keys)), [*keys, "question_id"])
    places = found["own"].groupBy(*keys, "question_id").agg(F.min_by("idx", "run_id").alias("at"))
    runs = found["run_scores"].groupBy(keys).agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    table = sinks.run_table(found["run_scores"], keys)
    return books(scored.join(large(places), [*keys, "question_id"]), runs, in_folder).unionByName(run_book(table, in_folder("run_summary.xlsx"), keys))


def detailed_books(results: DataFrame) -> DataFrame:
    """K4: for each run a workbook of its problems: what was read, then the scores; problems that failed are not in it."""
    flat = sinks.flat(results, ["dataset", "model", "run_id", "idx", "context", "solution", "answer", "answer_type", "unit", "points", "modality", "field", "subfield"])
    columns = [c for c in flat.columns if c not in ("dataset", "model", "run_id", "idx")]
    file = F.concat_ws("/", "dataset", "model", F.concat(F.col("run_id"), F.lit("_detailed.xlsx")))
    return rows(flat.select("dataset", "model", "run_id").distinct(), file, 0, book_head(columns)).unionByName(rows(flat, file, 1, F.to_json(F.struct(*columns), FULL), None, F.col("idx")))


def logs(results: DataFrame, tag: str) -> DataFrame:
    """Rows of a log file for each run, a problem after the other; failed ones too."""
    file = F.concat_ws("/", "dataset", "model", F.concat(F.col("run_id"), F.lit(f"_{tag}.log")))
    body = F.concat(F.array_join("log", "\n"), F.lit("\n\n"))
    # Each problem is a section of its own, so nothing stands between them.
    return results.select(file.alias("file"), F.col("idx").cast("int").alias("section"), F.lit(0).cast("long").alias("at"), F.lit("").alias("name"), body.alias("body"))
