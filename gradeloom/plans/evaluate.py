"""Whole runs: scoring problems, one run or several, and the reports."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import answers, parse
from gradeloom.functions import text as X
from gradeloom.operators import catalog, judge, marking, scores
from gradeloom.sources import documents, inference, sinks, statistics, store
from gradeloom.sources.staging import large, stage

log = logging.getLogger(__name__)
KEY = ["dataset", "model", "run_id", "idx"]
DETAIL = "array<struct<index:int,criterion:string,score:double,judge_response:string>>"


def score_problems(problems: DataFrame, factory: Callable[[], judge.Client] | None = None, over_runs: bool = False, fallback: str = "fine", attempts: int = marking.ATTEMPTS, policy: judge.Policy = judge.JUDGE, journal: str | None = None, parallelism: int | None = None, verbose: bool = False) -> DataFrame:
    """M5, M6: problems (inference.problems()) with fine, coarse and earned scores; those with an error have null scores. verbose adds `log`."""
    rows = problems.withColumn("max_points", X.total(F.col("points")))
    if verbose:
        rows = rows.withColumn("log", sinks.row_log(
            F.format_string("problem %s (%s), %s points", (F.col("idx") + 1).cast("string"), F.col("question_id"), F.col("max_points").cast("string")),
            F.format_string("a prediction of %s characters, %s answers, %s marking sets", F.coalesce(F.length("prediction"), F.lit(0)).cast("string"), F.coalesce(F.size("answer"), F.lit(0)).cast("string"), F.coalesce(F.size("sets"), F.lit(0)).cast("string")),
            F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), F.col("error"))),
        ))
    if factory is not None:
        keyed = rows.filter("error is null and size(sets) > 0").select(F.to_json(F.struct(*KEY)).alias("problem_key"), "question", "prediction", "sets", "max_points")
        sets = judge.judge_criteria(keyed, factory, attempts, parallelism, policy, journal)
        best = marking.best_set(sets, ["problem_key"], "details")
        rows = rows.withColumn("problem_key", F.to_json(F.struct(*KEY))).join(best.withColumnRenamed("score", "__fine"), "problem_key", "left").drop("problem_key")
    else:
        rows = rows.withColumns({"__fine": F.lit(None).cast("double"), "details": F.lit(None).cast(DETAIL), "best_marking_set": F.lit(None).cast("long")})
    fine = X.half_even(X.no_nan(F.col("__fine")))
    n = F.when(F.size("answer") > 0, F.size("answer")).otherwise(answers.DEFAULT_ANSWERS)
    earned = F.when(F.size("answer") > 0, answers.earned_any(F.col("prediction"), F.col("answer"), F.col("points"))).otherwise(0.0)
    rows = rows.withColumn("fine_grained_score", fine).withColumn("coarse_grained_score", answers.coarse(earned, F.col("fine_grained_score"), fallback))
    total = scores.earned_over_runs(F.col("fine_grained_score"), F.col("coarse_grained_score"), F.col("valid_marking")) if over_runs else scores.earned(F.col("fine_grained_score"), F.col("coarse_grained_score"))
    rows = rows.withColumn("earned_points", total).withColumn("extracted_pred", answers.display(F.col("prediction"), n))
    nulled = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("fine_grained_score", "coarse_grained_score", "earned_points", "extracted_pred")}
    rows = rows.withColumns(nulled)
    if verbose:
        rows = rows.withColumn("log", F.when(F.col("error").isNotNull(), F.col("log")).otherwise(F.concat("log", _told())))
    return rows.withColumn("marking_detailed_scores", F.coalesce("details", F.array().cast(DETAIL))).drop("__fine", "details")


def _told() -> Column:
    """The lines of a problem that was scored: each criterion's, then the scores."""
    line = lambda d: F.format_string("criterion %s: %s", (d["index"] + 1).cast("string"), F.coalesce(d["score"].cast("string"), F.lit("no score")))
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    scored = sinks.row_log(
        F.when(F.col("best_marking_set").isNotNull(), F.format_string("best marking set: %s", of("best_marking_set"))), F.format_string("read as answers: %s", of("extracted_pred")),
        F.format_string("fine %s, coarse %s, earned %s", of("fine_grained_score"), of("coarse_grained_score"), of("earned_points")),
    )
    return F.concat(F.transform(F.coalesce("details", F.array().cast(DETAIL)), line), scored)


def wide(one_text: DataFrame) -> DataFrame:
    """Prompts' variant of problems whose marking is text: sets parsed from JSON."""
    return one_text.withColumn("sets", parse.marking_sets(F.try_parse_json("marking")))


@dataclass
class Engine:
    """Reads below infer_dir, writes below eval_dir. parallelism: tasks that call the judge, each `policy.workers` calls at once; journal: where replies are kept as they come."""

    spark: SparkSession
    infer_dir: str
    eval_dir: str
    client: Callable[[], judge.Client] | None = None
    parallelism: int | None = None
    policy: judge.Policy = judge.JUDGE
    journal: str | None = None
    verbose: bool = False

    def _scored(self, files: DataFrame, over_runs: bool = False) -> DataFrame:
        return score_problems(inference.problems(files, self.parallelism), self.client, over_runs, policy=self.policy, journal=self.journal, parallelism=self.parallelism, verbose=self.verbose)

    def files(self, dataset: str | None = None, model: str | None = None) -> DataFrame:
        named = lambda n: store.escaped(n) if n else "*"
        return inference.keyed(inference.read_files(self.spark, f"{store.escaped(self.infer_dir)}/{named(dataset)}/{named(model)}"))

    def evaluate(self, dataset: str, model: str, run: str | None = None) -> tuple[DataFrame, DataFrame]:
        """M1: (results, one row of A1) of a run, the newest unless one is named; an error where none can be read."""
        files = inference.require_runs(self.files(dataset, model), f"{dataset}/{model}")
        files = files.filter(F.col("run_id") == run) if run else inference.newest(files, ["dataset", "model"])
        results = self._scored(files)
        return results, scores.dataset_score(results, ["dataset", "model", "run_id"])

    def evaluate_all(self, datasets: list[str], models: list[str]) -> DataFrame:
        """M2: A1 of everything that waits, in one plan; a dataset that can't be read has an error in place of scores."""
        waiting = catalog.pending(catalog.listed(self.spark, datasets, models), catalog.found(self.files()), self.evaluated())
        return self.evaluate_pairs(waiting)[1].orderBy("dataset_no", "model_no")

    def evaluate_pairs(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """M1 and M2 for given pairs (dataset, model, ...) in one plan: (results, pairs with A1 of the newest run, or an error).

        Results are staged, so each criterion is judged once however often they are read.
        """
        keys = ["dataset", "model"]
        chosen = inference.newest(self.files().join(pairs, keys, "left_semi"), keys)
        results = stage(self._scored(chosen), "results")
        totals = scores.dataset_score(results, [*keys, "run_id"])
        return results, pairs.join(totals, keys, "left").withColumn("error", F.when(F.col("total_count").isNull(), "no readable problems"))

    def evaluated(self) -> DataFrame:
        """Datasets and models that have scores already; a table that is there but cannot be read is an error."""
        path = f"{self.eval_dir}/scores"
        if not sinks.exists(self.spark, path):
            return self.spark.createDataFrame([], "dataset string, model string")
        return self.spark.read.option("recursiveFileLookup", True).parquet(path).select("dataset", "model").distinct()

    def multi_run(self, dataset: str, model: str) -> dict[str, DataFrame]:
        """M3, M4: all runs of a dataset side by side; an error where none can be read."""
        return self._over_runs(inference.require_runs(self.files(dataset, model), f"{dataset}/{model}"))

    def multi_run_pairs(self, pairs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        """M3, M4 for given pairs (dataset, model) in one plan: the tables of all of them, and the pairs, with an error where nothing could be read."""
        keys = ["dataset", "model"]
        found = self._over_runs(self.files().join(pairs, keys, "left_semi"))
        read = found["overall"].select(*keys, "num_runs")
        return found, pairs.join(read, keys, "left").withColumn("error", F.when(F.col("num_runs").isNull(), "no readable problems"))

    def _over_runs(self, files: DataFrame) -> dict[str, DataFrame]:
        """results, run_scores, questions, overall and own (each question's last result in each run), by dataset and model."""
        keys = ["dataset", "model"]
        results = stage(self._scored(files, True), "results")
        first = large(scores.first_run_questions(results, keys))
        own = stage(scores.last_of_repeated(scores.scored(results), keys).drop("max_points").join(first, [*keys, "question_id"]), "own")
        texts = results.groupBy(*keys, "question_id").agg(F.min_by("question", "run_id").alias("question"))
        stats = first.drop("max_points").join(large(scores.question_stats(own, [*keys, "question_id"])), [*keys, "question_id"], "left").join(first.select(*keys, "question_id", "max_points"), [*keys, "question_id"]).join(large(texts), [*keys, "question_id"], "left")
        stats = stage(stats.withColumn("num_runs", F.coalesce("num_runs", F.lit(0))), "questions")
        runs = stage(scores.dataset_score(results, [*keys, "run_id"]), "runs")
        overall = scores.run_stats(runs, keys).join(scores.question_based(stats, keys), keys)
        return {"results": results, "run_scores": runs, "questions": stats, "overall": overall, "own": own}

    def save(self, results: DataFrame, totals: DataFrame) -> None:
        """K2-K4 (M8): tables, and a workbook for each run."""
        sinks.write_table(totals.filter("total_count is not null"), sinks.versioned(f"{self.eval_dir}/scores", "score"))
        sinks.write_table(sinks.detailed(results).withColumn("marking", F.to_json("marking")), sinks.versioned(self.eval_dir, "detailed_results"), "json")
        sinks.write_table(sinks.flat(results), sinks.versioned(self.eval_dir, "detailed"))
        documents.write(statistics.detailed_books(results), self.eval_dir, statistics.ORDER)
        self.save_logs(results)

    def save_logs(self, results: DataFrame) -> None:
        """For each run a file of its problems' log lines, in their order; for verbose engines."""
        if "log" in results.columns:
            documents.write(statistics.logs(results, sinks.versioned("logs", "log").partition("/")[2]), self.eval_dir, statistics.ORDER)

    def save_summary(self, totals: DataFrame) -> dict:
        """K5, K6, A5 (M8): all datasets, failed ones with nulls; the table of the others; the grand total, which is returned."""
        named = totals.withColumn("dataset_key", F.concat_ws("/", "dataset", "model"))
        total = scores.grand_total(named.filter("total_count is not null")).first().asDict()
        rows = named.select("dataset_key", "run_id", *[c for c in totals.columns if c not in ("dataset", "model", "run_id", "dataset_no", "model_no")]).orderBy("dataset_key")
        sinks.write_report(rows, f"{self.eval_dir}/all_datasets_summary.json", {"overall": total})
        sinks.write_report(sinks.summary_table(named).orderBy("dataset_key"), f"{self.eval_dir}/summary_table.json")
        log.info("overall: %s", total)
        return total

    def save_multi_run_summary(self, overall: DataFrame) -> None:
        """K12, K13 (M8): the statistics over runs of all datasets, as a report and as a table."""
        named = overall.withColumn("dataset_key", F.concat_ws("/", "dataset", "model")).drop("dataset", "model").orderBy("dataset_key")
        sinks.write_report(named, f"{self.eval_dir}/all_datasets_multi_run_summary.json")
        sinks.write_table(sinks.multi_run_table(named), sinks.versioned(self.eval_dir, "multi_run_summary_table"))

    def save_multi_run(self, found: dict[str, DataFrame]) -> None:
        """Below each dataset and model its statistics document and four workbooks; three tables partitioned by dataset and model."""
        keys = ["dataset", "model"]
        documents.write(statistics.documents(found).unionByName(statistics.workbooks(found)), self.eval_dir, statistics.ORDER)
        questions = found["questions"].join(large(statistics.by_run(found["own"], keys)), [*keys, "question_id"], "left")
        for name, table in {"question_statistics": questions, "run_summary": sinks.run_table(found["run_scores"], keys), "multi_run_summary": found["overall"]}.items():
            sinks.write_table(table, sinks.versioned(self.eval_dir, name), partitions=keys)
        self.save_logs(found["results"])
