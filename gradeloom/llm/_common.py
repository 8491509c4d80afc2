"""Helpers shared by the training-data operators: Arrow buffers, byte-level words and hashes, staging."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on; a longer text makes a step of its own.
CHUNK_BYTES = 1 << 19
SEED = 20240607
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_B = np.arange(256)
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
#: Bytes that make words once A-Z are lower-cased: digits, a-z, and every byte of a non-ASCII character.
WORD = ((_B >= 48) & (_B <= 57)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
#: For bytes.translate: all that is not of a word becomes a space.
TO_SPACE = bytes(int(b) if WORD[b] else 32 for b in range(256))
_BYTE_CODES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_staged: list[str] = []
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none a local session (tests) gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"
    _held().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _held() -> list[str]:
    """The paths of the tables that are staged in the scope that is open, or in none."""
    return _staged if _open.get() is None else _open.get()


def _drop(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths[-1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        paths.pop()


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables that are staged within are dropped when the block ends, by an error too; results that read them are written by then.

    Gives the list of their paths: one that is taken out of it outlives the block, and outlive() hands it to the scope around. Other
    results' tables are left alone. A scope is of one thread.
    """
    own: list[str] = []
    token = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(token)
        _drop(spark, own)


def outlive(paths: list[str]) -> None:
    _held().extend(paths)


def drop_staged(spark: SparkSession) -> int:
    """Deletes the tables of this process that were staged in no scope, once the results that read them are written; how many there were."""
    n = len(_staged)
    _drop(spark, _staged)
    return n


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table that is written, as values take them in memory: 8 for a number, an array's by its elements."""

    def width(column, kind):
        if isinstance(kind, T.ArrayType):
            inner = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
            return F.greatest(F.size(column), F.lit(0)) * inner + 16
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        return F.lit(8)

    rows, size = df.agg(F.count("*"), F.sum(sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)))).first()
    return rows, size or 0


#: Bytes of a join's build side that a partition may hold in a hash table, and bytes of keys that are broadcast.
MOST_HASHED, MOST_KEYS = 32 << 20, 16 << 20


def hashed_side(side: DataFrame) -> DataFrame:
    """A written table as the build side of a hash join, where a partition of it is small; else as it is, so that Spark sorts and can spill."""
    parts = max(1, int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return side.hint("shuffle_hash") if measured(side)[1] / parts <= MOST_HASHED else side


def row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text"):
    """Two longs that name a row by its content; equal rows share them, which every operator here allows."""
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("\x00"))
    return F.xxhash64(F.lit(1), ident, F.col(f"`{text}`")), F.xxhash64(F.lit(2), F.col(f"`{text}`"), ident)


def others(df: DataFrame, made: list[str]) -> list[str]:
    """df's columns without those that an operator makes: its own results replace columns of the same name."""
    low = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in low]


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its rows, from 0; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [lo, hi) of at most that many bytes, but of one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (the finisher of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each word in lower-cased bytes; words end at the ends of rows."""
    is_word = WORD[low]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    first[inner] = is_word[inner]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[inner - 1] = is_word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offs, begin, "right") - 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum over all of them; spans are in order and do not overlap.

    Long data is hashed in parts of about CHUNK_BYTES, so the tables stay small; a hash does not depend on the span's place.
    """
    m = len(begin)
    out = np.zeros(m, np.uint64)
    at = 0
    while at < m:
        to = m if len(data) <= 2 * CHUNK_BYTES else max(at + 1, int(np.searchsorted(end, begin[at] + CHUNK_BYTES, "right")))
        lo, hi = int(begin[at]), int(end[to - 1])
        part, b, e = data[lo:hi], begin[at:to] - lo, end[at:to] - lo
        n = len(part)
        up, down = _powers(max(CHUNK_BYTES * 2 + 2, 1 << (n + 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[part] * up[:n], out=total[1:])
        out[at:to] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64))
        at = to
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive word hashes, rows not regarded."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        h *= _GRAM
        h += words[k : k + m]
    return mix(h)


def shingles(low: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-word shingle, repeats kept, in the order of rows; a row of 1 to n - 1 words is one shingle."""
    begin, end, row = word_spans(low, offs)
    words = span_hashes(low, begin, end)
    h = gram_hashes(words, n)
    full = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
    hashes, rows = [h[full]], [row[: len(h)][full]]
    counts = np.bincount(row, minlength=len(offs) - 1)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            at = firsts[few]
            g = np.full(len(few), np.uint64(k), np.uint64)
            for j in range(k):
                g *= _GRAM
                g += words[at + j]
            hashes.append(mix(g))
            rows.append(few)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    if len(rows) and (np.diff(rows) < 0).any():
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def least(keyed: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """The distinct (by, h) of the `most` least hashes h of each value of `by`: cut below a bound first, which about twice as many pass."""
    unit = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    if by is None:
        n = keyed.agg(F.approx_count_distinct("h", 0.02)).first()[0] or 0
        return keyed.filter(unit * n <= 2.0 * most + 20).select("h").distinct().orderBy("h").limit(most)
    sizes = keyed.groupBy(F.col(by).alias("of")).agg(F.approx_count_distinct("h", 0.02).alias("n"))
    near = keyed.join(F.broadcast(sizes), F.col(by) == F.col("of")).filter(unit * F.col("n") <= 2.0 * most + 20).select(by, "h").distinct()
    return near.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("h"))).filter(F.col("r") <= most).select(by, "h")


def pack_text(df: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """df with its text column replaced by `__body`, the last column: the bytes compressed for a shuffle, null where the text is.

    A task copies the texts of `most` rows at a time, or those of a whole batch.
    """
    keep = [c for c in df.columns if c != text]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__body", T.BinaryType())])

    def step(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in (big.slice(lo, most) for big in batches for lo in range(0, big.num_rows, most or max(1, big.num_rows))):
            body = b.column(b.num_columns - 1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if x is None else z.compress(x) for x in body.to_pylist()], pa.binary())], names=schema.names)

    return source.mapInArrow(step, schema)


def unpack(bodies: list[bytes | None]) -> list[bytes]:
    """The bytes of packed texts; null is empty."""
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) if x else b"" for x in bodies]


def bucket_of_id(name: str = "doc_id"):
    """crc32 of the id as text, mod 5: 0 marks the held-out rows. A null id counts as an empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % 5
