"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target.

Words are runs of digits, letters a-z (A-Z become a-z) and non-ASCII characters; features are all runs of `least` to `most`
consecutive words of a text, joined by one space, repeats counted, and a feature's bucket is its crc32 modulo `buckets`. Within a
partition DuckDB unnests words, makes n-grams by window, and counts by bucket through zlib's crc32, which is registered there as a
function: called once for each different feature of a step. A partition's counts, by document and in total, are written as
Parquet in the shared folder, by Spark, whose commit tells finished attempts of a task from lost ones. Spark then adds up the totals
of all partitions, makes the gain of each bucket, floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), and scores each
document: the floored mean of its features' gains, plus Gumbel noise floor(-1000 ln(-ln((h + 0.5) / 2**32))) where h are the first
8 hexadecimal digits of sha256 of `seed:doc_id`. The highest scores of documents with `min_words` words or more are drawn: a draw
without replacement by weight.

Defined cases: a null or empty text has no features and weight 0; texts of any length count in full, cut into pieces between words
that windows reach across; equal scores go by doc_id, a null id first (its noise is that of an empty id), then by a hash of the
text, and rows that are equal stand side by side in any order; repeated rows are rows of their own, with ranks of their own; an
empty table gives no rows; with an empty target every document is scored against zero counts; results replace columns of the same
names, and all others come through.

Scale: one scan of the texts, no shuffle of them. A task's totals are `buckets` rows at most and so is the merged table, which is
broadcast. The border of the draw comes from a count by score (whole numbers between -47,000 and 67,000, so bounded whatever the
corpus); only the rows above it are dealt by range, numbered within their range and raised by the ranges before, so no task sees
them all, and equal rows are split like any others. DuckDB holds STEP_BYTES of text at a time and spills to the task's folder.
"""

from __future__ import annotations

import shutil
import string
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

BUCKETS, LEAST, MOST = 10_000, 1, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
STEP_BYTES = 4 << 20
MEMORY = "384MB"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MADE = ["n_features", "weight", "score", "rank"]


def _crc32(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in features.to_pylist()], pa.int64())


def step_sql(least: int, most: int, buckets: int) -> str:
    """DuckDB SQL from `batch` (row, piece, text) to (row, n_words, buckets, counts)."""
    grams = []
    for n in range(least, most + 1):
        ahead = "".join(f" || ' ' || lead(word, {k}) OVER w" for k in range(1, n))
        window = " WINDOW w AS (PARTITION BY row ORDER BY piece, place)" if n > 1 else ""
        grams.append(f"SELECT row, feature FROM (SELECT row, word{ahead} AS feature FROM words{window}) WHERE feature IS NOT NULL")
    return f"""
WITH lists AS MATERIALIZED (SELECT row, piece, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD_PATTERN}') AS list FROM batch),
words AS (SELECT row, piece, generate_subscripts(list, 1) AS place, unnest(list) AS word FROM lists),
grams AS ({" UNION ALL ".join(grams)}),
counted AS MATERIALIZED (SELECT row, feature, count(*) AS n FROM grams GROUP BY row, feature),
hashed AS (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
filled AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY row, bucket),
sizes AS (SELECT row, sum(len(list))::BIGINT AS n_words FROM lists GROUP BY row)
SELECT row, any_value(n_words) AS n_words, list(bucket) FILTER (bucket IS NOT NULL) AS buckets, list(n) FILTER (bucket IS NOT NULL) AS counts
FROM sizes LEFT JOIN filled USING (row) GROUP BY row ORDER BY row"""


_IS_WORD = C.WORD | ((np.arange(256) >= 65) & (np.arange(256) <= 90))


def _pieces(data: np.ndarray, lo: int, hi: int, most: int):
    """Byte ranges of one text that end between words and at characters, of about `most` bytes where words allow it."""
    while hi - lo > most:
        gap = np.flatnonzero(~_IS_WORD[data[lo + most : min(hi, lo + 2 * most)]])
        at = most
        while not len(gap) and lo + at + most < hi:
            at += most
            gap = np.flatnonzero(~_IS_WORD[data[lo + at : min(hi, lo + at + most)]])
        if not len(gap):
            break
        yield lo, lo + at + int(gap[0])
        lo += at + int(gap[0])
    yield lo, hi


def bucket_counts(docs: DataFrame, keep: list[str], *, text: str = "text", least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """Staged rows: for each document (own: keep's columns, n_words, buckets, counts), and for each task one with a null own and its totals."""
    if not 1 <= least <= most:
        raise ValueError("features have from 1 up to any number of words")
    own = F.struct(*[F.col(f"`{c}`") for c in keep], F.xxhash64(F.col(f"`{text}`")).alias("__h"))
    source = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("own", source.schema["own"].dataType), *T.StructType.fromDDL("n_words long, buckets array<int>, counts array<long>").fields])
    sql = step_sql(least, most, buckets)

    def step(batches):
        import duckdb

        folder = tempfile.mkdtemp(prefix="features-")
        db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder})
        try:
            db.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            totals, own_type = np.zeros(buckets, np.int64), None
            for big in batches:
                own_type = big.column(0).type
                data, offs = C.buffers(big.column(1))
                for lo, hi in C.chunks(offs, step_bytes):
                    ranges = [(k - lo, piece, *span) for k in range(lo, hi) for piece, span in enumerate(_pieces(data, int(offs[k]), int(offs[k + 1]), step_bytes))]
                    texts = pa.array([data[a:b].tobytes().decode() for _, _, a, b in ranges], pa.string())
                    batch = pa.table({"row": pa.array([r[0] for r in ranges], pa.int32()), "piece": pa.array([r[1] for r in ranges], pa.int32()), "text": texts})
                    db.register("batch", batch)
                    found = db.sql(sql).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    ids, counts = (found.column(c).combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("buckets", "counts"))
                    np.add.at(totals, ids.flatten().to_numpy(), counts.flatten().to_numpy())
                    yield pa.RecordBatch.from_arrays([big.column(0).slice(lo, hi - lo), found.column("n_words").combine_chunks(), ids.cast(pa.list_(pa.int32())), counts.cast(pa.list_(pa.int64()))], names=schema.names)
            if own_type is not None:
                some = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, own_type), pa.nulls(1, pa.int64()), pa.array([some.tolist()], pa.list_(pa.int32())), pa.array([totals[some].tolist()], pa.list_(pa.int64()))], names=schema.names)
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    return C.stage(source.mapInArrow(step, schema), "bucket-counts")


def gains(counted: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the staged counts of the documents and of the target."""

    def merged(held: DataFrame, n: str) -> DataFrame:
        cell = F.explode(F.arrays_zip("buckets", "counts")).alias("c")
        return held.filter("own is null").select(cell).groupBy(F.col("c.buckets").cast("long").alias("bucket")).agg(F.sum("c.counts").alias(n))

    table = counted.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(merged(counted, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").fillna(0)
    all_s, all_t = (int(x or 0) for x in table.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(all_s + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(all_t + buckets)))
    return table.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id, seed: int = SEED):
    """Gumbel noise in thousandths, a function of the id alone."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    unit = (F.conv(first, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", keep: list[str] | None = None, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """docs' columns (or those of `keep`) with n_features, weight, score, and rank: 1, 2, ... for those drawn, else null."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    features = {"least": least, "most": most, "buckets": buckets}
    inner = [f"k{i}" for i in range(len(keep))]
    named = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)], F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counted = bucket_counts(named, [*inner, "doc_id"], **features)
    wanted = bucket_counts(target.select(F.col(f"`{target_text}`").alias("text")), [], **features)
    # `buckets` rows, a parameter.
    table = np.zeros(buckets, np.int64)
    for r in gains(counted, wanted, buckets).collect():
        table[r["bucket"]] = r["gain"]
    shared = spark.sparkContext.broadcast(table)
    schema = T.StructType([counted.schema["own"], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def weigh(batches):
        for b in batches:
            own, n_words, ids, counts = b.columns
            sizes = np.diff(ids.fill_null([]).offsets.to_numpy()) if ids.null_count else np.diff(ids.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            per, each = counts.flatten().to_numpy(), ids.flatten().to_numpy()
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n, row, per)
            np.add.at(total, row, per * shared.value[each])
            yield pa.RecordBatch.from_arrays([own, n_words, pa.array(n), pa.array(total // np.maximum(n, 1))], names=schema.names)

    weighed = counted.filter("own is not null").mapInArrow(weigh, schema)
    scored = C.stage(weighed.withColumn("score", F.col("weight") + noise(F.col("own.doc_id"), seed)), "importance-scores")
    fit = scored.filter(F.col("n_words") >= min_words)
    # Scores are whole numbers in a fixed range, so these are at most some 114,000 rows.
    by_score = sorted(((r["score"], r["count"]) for r in fit.groupBy("score").count().collect()), reverse=True)
    left = drawn = sum(n for _, n in by_score) * percent // 100
    border = None
    for score, n in by_score:
        if left <= 0:
            break
        border, left = score, left - n
    columns = [*[F.col(f"own.{k}").alias(c) for k, c in zip(inner, keep, strict=True)], "n_features", "weight", "score"]
    if border is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = (F.col("n_words") >= min_words) & (F.col("score") >= border)
    placed = _in_order(scored.filter(above), [F.col("score").desc(), F.col("own.doc_id").asc(), F.col("own.__h").asc()])
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    return ranked.select(*columns, "rank").unionByName(scored.filter(~above | F.col("n_words").isNull()).select(*columns, F.lit(None).cast("long").alias("rank")))


def _in_order(rows: DataFrame, order: list) -> DataFrame:
    """rows with their place, from 1, in that order: numbered range by range, ranges split rows that are equal in it."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*order, F.col("nth")]
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part long, within long").fields])

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(b.num_rows, part, np.int64)), pa.array(np.arange(at + 1, at + 1 + b.num_rows, dtype=np.int64))], names=schema.names)
            at += b.num_rows

    held = C.stage(dealt.mapInArrow(number, schema), "importance-order")
    # A row a range, of which there are as many as shuffle partitions.
    ranges = held.groupBy("part").agg(F.max("within").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("part").alias("in_part"), ahead.alias("ahead"))
    return held.join(F.broadcast(ranges), F.col("part") == F.col("in_part")).withColumn("place", F.col("ahead") + F.col("within"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns, in no order; options are resample's."""
    return resample(docs, target, **options).filter("rank is not null").select(*[F.col(f"`{c}`") for c in C.others(docs, MADE)])


def op11_importance(spark, sf_dir: str) -> DataFrame:
    docs, wanted = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, wanted, keep=["doc_id"])


SQL = f"""
WITH words AS MATERIALIZED (
  SELECT true AS own, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD_PATTERN}') AS list FROM documents
  UNION ALL SELECT false, item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD_PATTERN}') FROM benchmark
),
rows AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM words),
grams AS MATERIALIZED (SELECT row, own, feature, count(*) AS n FROM (SELECT row, own, unnest(list) AS feature FROM rows) GROUP BY ALL),
crc_table AS MATERIALIZED (
  WITH RECURSIVE steps(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8)
  SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
),
bytes AS MATERIALIZED (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM grams)),
hashed AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc_table
),
cells AS MATERIALIZED (SELECT row, own, bucket, sum(n)::BIGINT AS n FROM grams JOIN hashed USING (feature) GROUP BY ALL),
sums AS MATERIALIZED (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM cells GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM cells JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(list) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM rows LEFT JOIN weights USING (row) WHERE own
),
fit AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM scored WHERE n_words >= {MIN_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= {PERCENT} * total // 100 THEN rank END AS rank
FROM scored s LEFT JOIN fit ON fit.doc_id = s.doc_id"""

QUERIES = {"op11_importance": op11_importance}
ORACLES = {"op11_importance": SQL}
