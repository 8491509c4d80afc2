"""Run files as a stream: each new file is scored once, as it arrives (an addition; the batch form is plans.evaluate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.operators import scores
from gradeloom.plans import evaluate
from gradeloom.sources import inference, staging


def stream(spark: SparkSession, root: str) -> DataFrame:
    reader = spark.readStream.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    raw = reader.text(root, wholetext=True).select(inference.decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.from_json("value", "array<variant>").alias("items"))
    return inference.keyed(raw.withColumn("readable", F.col("items").isNotNull()))


def score_runs(spark: SparkSession, root: str, out: str, checkpoint: str, factory=None) -> StreamingQuery:
    """Appends one row of A1 for each run file; the checkpoint keeps files from being scored twice."""

    def batch(files: DataFrame, _: int) -> None:
        before = staging.staged()
        results = evaluate.score_problems(inference.problems(files), factory)
        scores.dataset_score(results, ["dataset", "model", "run_id"]).write.mode("append").parquet(out)
        staging.drop_staged(spark, before)

    return stream(spark, root).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
