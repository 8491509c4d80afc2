"""Tables written in the shared folder between stages: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none a local session (tests) gets a temporary one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written once and read back: what it calls is called once, however often the result is read."""
    spark = df.sparkSession
    path = f"{folder(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input (a row a question, say): joined by sorting, never broadcast.

    Spark takes the size of a table read back for that of its compressed files, in proportion to the usual widths of the columns asked for (2048 bytes
    for a variant). So a few columns of millions of rows pass for a few MB, are broadcast, and are gathered on the driver for that.
    """
    return df.hint("merge")


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Deletes the staged tables of this process but the first `since`, once the results that read them are written; how many there were."""
    n = len(_staged) - since
    while len(_staged) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return max(0, n)


def staged() -> int:
    """How many staged tables there are: what drop_staged() keeps of them."""
    return len(_staged)
