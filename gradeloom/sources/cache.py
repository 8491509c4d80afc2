"""A cache of replies: a table keyed by (namespace, key) over an append log; of several writes of one key the last counts.

    <path>/log/batch=<time>-<name>/            rows (namespace, key, value) of one append
    <path>/base/<version>-<name>/bucket=<n>/   rows (namespace, key, value, batch), one a key
    <path>/versions/<version>                  the base's folder, the batches that it holds, and END

An append is written beside the log and renamed into it, so it is there whole or not at all, and two at once do not disturb each
other. A batch's name begins with its time, so names sort as they were written; a base keeps each row's batch, so it does not matter
whether a batch that was merged is read once more. Compaction writes a new base and then its list of batches under the next number,
which only one of several can take; `vacuum` deletes what the newest base has made superfluous, once nobody reads it any more.

A write of the same rows again changes nothing. Within one batch, the greatest value of a repeated key counts. Null values are not kept.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources import store

SCHEMA = "namespace string, key string, value string"
BUCKETS = 64
END = "end"


class ReplyCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame) -> str:
        """Adds rows (namespace, key, value) as one batch; its name."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        staged = f"{self.path}/.writing/{name}"
        rows.select("namespace", "key", "value").filter(F.col("value").isNotNull()).write.parquet(staged)
        store.make_folder(self.spark, f"{self.path}/log")
        store.rename(self.spark, staged, f"{self.path}/log/batch={name}")
        return name

    def _newest(self) -> tuple[str | None, str | None, set[str]]:
        """(version, folder of its base, batches it holds) of the newest version that is written to its end."""
        for version in sorted(store.names(self.spark, f"{self.path}/versions"), reverse=True):
            lines = store.read_text(self.spark, f"{self.path}/versions/{version}").split("\n") if version.isdigit() else []
            if lines and lines[-1] == END:
                return version, lines[0], set(lines[1:-1])
        return None, None, set()

    def _batches(self) -> list[str]:
        """The batches in the log that the newest base does not hold."""
        merged = self._newest()[2]
        return sorted(b for n in store.names(self.spark, f"{self.path}/log") if (b := n.removeprefix("batch=")) != n and b not in merged)

    def read(self) -> DataFrame:
        """(namespace, key, value, batch), one row a key: a batch newer than the base has the say."""
        folder, batches = self._newest()[1], self._batches()
        base = self.spark.createDataFrame([], f"{SCHEMA}, batch string")
        if folder:
            base = self.spark.read.schema(f"{SCHEMA}, batch string, bucket int").parquet(f"{self.path}/base/{folder}").drop("bucket")
        if not batches:
            return base
        # The partition column would be typed by its looks; its name begins with digits, but never is a number.
        log = self.spark.read.schema(f"{SCHEMA}, batch string").option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/batch={b}" for b in batches])
        last = F.max(F.struct("batch", "value")).alias("last")
        return base.unionByName(log).groupBy("namespace", "key").agg(last).select("namespace", "key", "last.value", "last.batch")

    def compact(self, buckets: int = BUCKETS) -> str | None:
        """Writes a new base, one row a key in buckets by key; its version, or None where there is nothing new or another came first."""
        batches, (before, _, merged) = self._batches(), self._newest()
        if not batches:
            return None
        version = f"{int(before or 0) + 1:012d}"
        folder = f"{version}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("namespace", "key"), F.lit(buckets)).cast("int").alias("bucket")
        rows = self.read().select("namespace", "key", "value", "batch", bucket).repartition(buckets, "bucket").sortWithinPartitions("namespace", "key")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/base/{folder}")
        try:
            store.write_text(self.spark, f"{self.path}/versions/{version}", "\n".join([folder, *sorted(merged | set(batches)), END]))
        except Exception:
            store.delete(self.spark, f"{self.path}/base/{folder}")
            if version in store.names(self.spark, f"{self.path}/versions"):
                return None
            raise
        return version

    def vacuum(self) -> int:
        """Deletes the batches and bases that the newest base replaces; how many there were."""
        _, folder, merged = self._newest()
        old = [f"{self.path}/log/batch={b}" for b in merged if store.exists(self.spark, f"{self.path}/log/batch={b}")]
        old += [f"{self.path}/base/{n}" for n in store.names(self.spark, f"{self.path}/base") if folder and n < folder]
        for path in old:
            store.delete(self.spark, path)
        return len(old)
