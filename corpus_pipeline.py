"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread for the next.

1. quality classifier: documents that score below the threshold go.
2. n-gram Jaccard join: of each group of near copies one document stays.
3. benchmark decontamination: documents with a hit go.
4. PII: values become pseudonyms in the text, and n_chars follows it where there is such a column.
5. mixing: each document as often as the mix takes it, numbered by `copy`.

All but the last return the columns of documents, further ones of whatever name included; the last adds `copy`, which replaces a
column of that name. Empty tables, nulls, very long texts, ties and repeated rows are treated as the operators' docstrings say:
equal rows are near copies of one another, so one of them stays. SQL can express neither the classifier nor the permutations, so
ORACLE_SQL is None, and the tests hold each stage and the whole against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import _common as C
from gradeloom.llm import decontaminate, mixing, near_dups, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes | None = None) -> DataFrame:
    found = pii.pseudonymise(docs, key=key or pii.session_key(spark), report=False)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, copy_column="copy")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Applies the stages to the documents of sf_dir; key is the secret of the pseudonyms (without one, see pii.session_key()).

    What a stage has staged, and the documents that it has read, are dropped once its own are written, and all of them where it fails.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        with C.scope(spark) as own:
            own += last
            made = pii_stage(spark, docs, sf_dir, key) if name == "pii" else stage(spark, docs, sf_dir)
            docs = C.stage(made, f"pipeline-{name}")
            last = [own.pop()]
    C.outlive(last)
    return STAGES[-1][1](spark, docs, sf_dir)
