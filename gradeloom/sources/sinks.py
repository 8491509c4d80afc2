"""Writing tables and reports (K1-K21). Tables go through Spark's writers; a report of bounded size becomes one JSON file."""

from __future__ import annotations

import json
import logging
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import answers
from gradeloom.functions import text as X
from gradeloom.sources import store
from gradeloom.sources.cache import ReplyCache
from gradeloom.sources.store import exists as exists

#: Bytes that a single-file report may have.
MOST_REPORT_BYTES = 64 << 20

log = logging.getLogger(__name__)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partitions: list[str] | None = None) -> str:
    """A table in a folder that must not exist yet (K16: versions instead of overwriting)."""
    df.write.format(kind).mode("error").partitionBy(*(partitions or [])).save(path)
    return path


def versioned(base: str, name: str) -> str:
    """A new folder or file name for each writing."""
    return f"{base.rstrip('/')}/{name}_{time.strftime('%Y%m%d_%H%M%S')}_{time.time_ns() % 1_000_000:06d}"


def write_report(df: DataFrame, path: str, head: dict | None = None, most_bytes: int = MOST_REPORT_BYTES, indent: int = 2) -> str:
    """One pretty JSON file, for reports of a row a dataset or run. More than most_bytes are an error: such tables go to write_table()."""
    spark = df.sparkSession
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    size = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a report of {size} bytes is more than {most_bytes}; write it as a table")
    body = [json.loads(r["line"]) for r in lines.collect()]
    if store.exists(spark, path):
        store.rename(spark, path, versioned(*path.rsplit("/", 1)) + ".backup")
    store.write_text(spark, path, json.dumps(head | {"results": body} if head is not None else body, ensure_ascii=False, indent=indent))
    return path


def append_cache(rows: DataFrame, path: str) -> None:
    """New replies, as one batch."""
    ReplyCache(rows.sparkSession, path).append(rows)


def detailed(results: DataFrame) -> DataFrame:
    """The 19 columns of each problem that was scored."""
    some = lambda c, default: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(default)))
    boxed = F.transform("answer", lambda a: F.concat(F.lit("\\boxed{"), a, F.lit("}")))
    return results.filter("error is null").select(
        F.col("question_id").alias("id"), "context", "question", "solution", "marking", "marking_detailed_scores", F.when(F.size("answer") > 0, boxed).otherwise(F.array(F.lit(""))).alias("answer"),
        some("answer_type", "Open-End").alias("answer_type"), some("unit", "").alias("unit"), some("points", 0.0).alias("points"), "modality", "field", "subfield", F.concat_ws("/", "dataset", "model").alias("source"),
        F.col("prediction").alias("test_result"), answers.shown_answers(F.col("extracted_pred")).alias("test_answer"), "fine_grained_score", "coarse_grained_score", "earned_points",
    )


def flat(results: DataFrame, also: list[str] | None = None) -> DataFrame:
    """K4: the detailed table with plain columns, row by row (Q14), behind those of `also`."""
    made = answers.plain_answers(answers.shown_answers(F.col("extracted_pred")))
    return results.filter("error is null").select(*(also or []), "question_id", "question", "prediction", "fine_grained_score", "coarse_grained_score", "earned_points", made.alias("extracted_prediction"), F.coalesce(F.to_json("marking_detailed_scores"), F.lit("[]")).alias("marking_detailed_scores"))


def summary_table(scores: DataFrame) -> DataFrame:
    """Ten columns of each dataset that was scored; two of them carry one value."""
    return scores.filter("total_count > 0").select("dataset_key", F.col("total_count").alias("total_questions"), "total_score", "max_possible_score", "score_rate", "total_count", *_kinds())


def _kinds() -> list[Column]:
    """Fine and coarse totals and rates under the names that tables have for them."""
    return [F.col(f"{k}_grained_{a}").alias(f"{k}_grained_{b}") for k in ("fine", "coarse") for a, b in (("total_score", "score"), ("score_rate", "rate"))]


def multi_run_table(overall: DataFrame) -> DataFrame:
    """P14, K13; no rows is a table too."""
    return overall.select("dataset_key", "num_runs", "num_questions", "mean_total_score", "std_total_score", "mean_score_rate", "std_score_rate", "question_based_mean_score", "question_based_max_score", "question_based_score_rate")


def run_table(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P15, K11; behind keys that tell datasets apart."""
    return scores.select(*(keys or []), "run_id", "total_score", "max_possible_score", "score_rate", "total_count", *_kinds())


def nested_runs(results: DataFrame, keys: list[str]) -> DataFrame:
    """Each question's runs as a map, for the statistics file alone."""
    run = F.struct("fine_grained_score", "coarse_grained_score", F.col("earned_points").alias("earned_score"), "prediction", F.col("extracted_pred").alias("extracted_prediction"), F.when(F.col("valid_marking"), "fine_grained").otherwise("coarse_grained").alias("evaluation_method"))
    return results.filter("error is null").groupBy(keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run_id", run.alias("r"))))).alias("runs"))


def light(report: DataFrame) -> DataFrame:
    """A report's rows without the graph."""
    return report.select("id", "dataset", "score", "diagnostics")


def row_log(*messages: Column) -> Column:
    """A row's log lines, for verbose runs only."""
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def log_to(folder: str, dataset: str | None = None) -> Path:
    """A log file beside the console."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{(dataset or 'all').replace('/', '_')}_{time.strftime('%Y%m%d_%H%M%S')}.log"
    logging.basicConfig(level=logging.INFO, handlers=[logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")], format="%(asctime)s %(message)s", force=True)
    return path
