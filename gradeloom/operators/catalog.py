"""Which datasets and models there are, have several runs, or wait for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, datasets: list[str], models: list[str]) -> DataFrame:
    """All pairs of two given lists, in their order. The lists are configuration, so the product is of few rows."""
    rows = [(i, d, j, m) for i, d in enumerate(datasets) for j, m in enumerate(models)]
    return spark.createDataFrame(rows, "dataset_no int, dataset string, model_no int, model string")


def found(files: DataFrame) -> DataFrame:
    return files.select("dataset", "model").distinct()


def pending(catalog: DataFrame, inferred: DataFrame, evaluated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of the catalog, what was inferred and not yet evaluated."""
    keys = keys or ["dataset", "model"]
    return catalog.join(inferred, keys, "left_semi").join(evaluated, keys, "left_anti")


def runs(files: DataFrame) -> DataFrame:
    """The run files of each dataset and model."""
    return files.groupBy("dataset", "model").agg(F.array_sort(F.collect_set("run_id")).alias("runs"))


def multi_run(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Those with more than one run."""
    keys = keys or ["dataset", "model"]
    return files.groupBy(keys).agg(F.countDistinct("run_id").alias("num_runs")).filter("num_runs > 1")


def succeeded(outcomes: DataFrame) -> DataFrame:
    """How many datasets were scored."""
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("*").alias("total"))
