"""Product-quantised codes of vectors by Lloyd's rounds over heaps.

Components become integers, floor(scale * x), so sums, means and distances are exact. A vector is cut into `parts` equal consecutive
parts; each part position has a codebook that starts as that part of the rows of the smallest ids. A round assigns every part to its
nearest entry (ties: the lower index) and then moves each entry to the componentwise floored mean of its parts; entries without parts
stay. After the last round parts are assigned once more.

Heaps: with each part goes a lower bound of its distance to all other entries and an upper bound of that to its own. In a block of
BLOCK vectors each entry of each part position has a heap of its parts, keyed by the lower minus the upper bound, plus what the entry
had drifted in all when the key was made (its own moves and, each time, the largest move of another entry). A part can only have changed
its entry if its key is not above the entry's drift by now; those are popped, scanned anew against all entries, and pushed with a new
key. All others are not looked at. A heap is kept as a run sorted by key, which is a heap whose pops come off its front, so it is
written and read as it is. Only parts that moved change the sums: a task hands on differences.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped; a null id sorts last when codebooks
start; of rows with one id the lesser vectors come first; with fewer rows than entries there are as many entries as rows; an empty
table gives no rows and an empty codebook; equal rows get equal codes; labels are compared with null as a value; vectors of a length
that is not the first's, or not a multiple of the number of parts, and components so large that a squared distance overflows a long
are errors; inner columns are renamed, so none of the input's clash.

Scale: no shuffle of vectors. Blocks (vectors, heaps) are written in the shared folder after each pass and read by the next, a row a
block; the shuffle has one row a task and codebook component, and the driver holds codebooks, sums and drifts: parts x entries x
length numbers each, whatever the number of vectors. Totals of labels are joined by Spark's choice, which broadcasts them by measured size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 4096
#: At most so many components stand in a block.
BLOCK_VALUES = 1 << 20
#: Keys this close to an entry's drift are scanned anew: far above what rounding of the bounds can do.
MARGIN = 1e-6


@dataclass
class Codebooks:
    """entries[p, k]: entry k of part position p; drift[p, k]: what a key of its heap must exceed."""

    entries: np.ndarray
    drift: np.ndarray

    @classmethod
    def first(cls, rows: np.ndarray, parts: int) -> Codebooks:
        n, d = rows.shape if rows.ndim == 2 else (0, 0)
        if d % parts:
            raise ValueError(f"vectors of {d} components can't be cut into {parts} equal parts")
        entries = np.ascontiguousarray(rows.reshape(n, parts, d // parts).transpose(1, 0, 2)) if n else np.zeros((parts, 0, 0), np.int64)
        return cls(entries, np.zeros(entries.shape[:2]))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The codebooks after a round with these sums and counts of parts."""
        some = counts > 0
        entries = np.where(some[:, :, None], sums // np.maximum(counts, 1)[:, :, None], self.entries)
        step = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        k = step.shape[1]
        if k > 1:
            top = np.sort(step, axis=1)[:, -2:]
            others = np.where((np.arange(k) == step.argmax(axis=1)[:, None]), top[:, :1], top[:, 1:])
        else:
            others = np.zeros_like(step)
        return Codebooks(entries, self.drift + step + others)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each entry; as float64 where that is exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    top = 4 * most * most * max(1, x.shape[1])
    if top < 1 << 53:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(axis=1)
    if top >= 1 << 63:
        raise ValueError("components are too large: squared distances overflow a long")
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in entries], axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry (the lower index of equals), and the second least distance minus the least."""
    d = distances(x, entries)
    at = d.argmin(axis=1)
    least = np.sqrt(d[np.arange(len(d)), at].astype(np.float64))
    if d.shape[1] < 2:
        return at, np.full(len(d), np.inf)
    return at, np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) - least


class Heaps:
    """The heaps of one part position in a block: for each entry a run of (key, row), least key first."""

    def __init__(self, entries: int):
        self.keys = [np.zeros(0)] * entries
        self.rows = [np.zeros(0, np.uint16)] * entries

    def push(self, at: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        """Adds rows to the heaps of their entries."""
        order = np.lexsort((keys, at))
        at, keys, rows = at[order], keys[order], rows[order]
        found, first = np.unique(at, return_index=True)
        for k, lo, hi in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            place = np.searchsorted(self.keys[k], keys[lo:hi])
            self.keys[k] = np.insert(self.keys[k], place, keys[lo:hi])
            self.rows[k] = np.insert(self.rows[k], place, rows[lo:hi])

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes off (entry, row) of all whose key is not above the entry's drift."""
        at, rows = [], []
        for k, keys in enumerate(self.keys):
            if len(keys) and keys[0] <= drift[k] + MARGIN:
                n = int(np.searchsorted(keys, drift[k] + MARGIN, "right"))
                at.append(np.full(n, k))
                rows.append(self.rows[k][:n])
                self.keys[k], self.rows[k] = keys[n:], self.rows[k][n:]
        return (np.concatenate(at), np.concatenate(rows)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint16))

    def codes(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for k, rows in enumerate(self.rows):
            out[rows] = k
        return out

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return np.concatenate(self.keys).tobytes(), np.concatenate(self.rows).tobytes(), np.array([len(k) for k in self.keys], np.uint32).tobytes()

    @classmethod
    def load(cls, keys: bytes, rows: bytes, sizes: bytes) -> Heaps:
        cuts = np.cumsum(np.frombuffer(sizes, np.uint32))[:-1]
        out = cls(0)
        out.keys, out.rows = np.split(np.frombuffer(keys), cuts), np.split(np.frombuffer(rows, np.uint16), cuts)
        return out


def assign(x: np.ndarray, heaps: list[Heaps] | None, books: Codebooks) -> tuple[list[Heaps], np.ndarray, np.ndarray, int]:
    """x[n, parts, length] by the codebooks: heaps, how sums and counts change, and how many parts were scanned.

    Without heaps every part is scanned and all of them count; with heaps those popped are, and those that moved count.
    """
    parts, k, d = books.entries.shape
    sums, counts, scanned = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64), 0
    fresh = heaps is None
    heaps = [Heaps(k) for _ in range(parts)] if fresh else heaps
    for p in range(parts):
        was, rows = (None, np.arange(len(x), dtype=np.uint16)) if fresh else heaps[p].pop(books.drift[p])
        if not len(rows):
            continue
        scanned += len(rows)
        own = x[rows, p]
        at, slack = nearest(own, books.entries[p])
        heaps[p].push(at, slack + books.drift[p][at], rows)
        if not fresh:
            changed = at != was
            np.subtract.at(sums[p], was[changed], own[changed])
            np.subtract.at(counts[p], was[changed], 1)
            at, own = at[changed], own[changed]
        np.add.at(sums[p], at, own)
        np.add.at(counts[p], at, 1)
    return heaps, sums, counts, scanned


def kept(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows whose vector is there and finite throughout."""
    x = F.col(f"`{embedding}`")
    return vectors.filter(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    found = np.floor(values.astype(np.float64) * scale)
    if np.abs(found).max(initial=0) >= 1 << 31:
        raise ValueError("components are too large: squared distances overflow a long")
    return found.astype(np.int64)


def _narrow(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in the least width that holds them."""
    for width in (1, 2, 4, 8):
        kind = np.dtype(f"<i{width}")
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind).tobytes(), width
    raise AssertionError


@dataclass
class Codes:
    """codes: (vec_id, label, code, error), staged; error is the sum over parts of squared distances to their entries."""

    codes: DataFrame
    books: Codebooks
    #: How many parts each pass scanned against all entries.
    scanned: list[int]


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Learns codebooks from all vectors and encodes them."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    own = kept(vectors, embedding).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").alias("x"))
    rows = [r["x"] for r in own.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    books = Codebooks.first(_whole(np.array(rows), scale) if rows else np.zeros((0, 0)), parts)
    id_type, label_type = own.schema["vec_id"].dataType, own.schema["label"].dataType
    n_books, length = books.entries.shape[1], books.entries.shape[2]
    shape = (parts, length)
    block = max(1, min(BLOCK, BLOCK_VALUES // max(1, parts * length)))
    state = T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), *T.StructType.fromDDL("n int, width int, x binary, keys array<binary>, rows array<binary>, sizes array<binary>").fields,
        *T.StructType.fromDDL("cells array<long>, changes array<long>, scanned long").fields,
    ])
    result = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def blocks(batches):
        """(ids, labels, x) of the input, a block at a time."""
        for big in batches:
            for lo in range(0, big.num_rows, block):
                b = big.slice(lo, block)
                lists = b.column(2)
                if (np.diff(lists.offsets.to_numpy()) != parts * length).any():
                    raise ValueError("vectors differ in length")
                yield b.column(0), b.column(1), _whole(lists.flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, *shape)

    def as_list(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def passed(shared, source):
        """Each block of source after an assignment, then one row with the task's changes."""
        sums, counts, scanned = np.zeros((parts, n_books, length), np.int64), np.zeros((parts, n_books), np.int64), 0
        id_arrow = label_arrow = None
        for ids, labels, x, heaps in source:
            heaps, s, c, n = assign(x, heaps, shared.value)
            sums, counts, scanned = sums + s, counts + c, scanned + n
            keys, rows, sizes = zip(*[h.dump() for h in heaps], strict=True)
            body, width = _narrow(x)
            id_arrow, label_arrow = ids.type, labels.type
            yield pa.RecordBatch.from_arrays([as_list(ids), as_list(labels), pa.array([len(x)], pa.int32()), pa.array([width], pa.int32()), pa.array([body]), *(pa.array([list(v)], pa.list_(pa.binary())) for v in (keys, rows, sizes)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64())], names=state.names)
        if id_arrow is not None:
            changes = np.concatenate([sums.reshape(-1), counts.reshape(-1)])
            some = np.flatnonzero(changes)
            none = [pa.nulls(1, t) for t in (pa.list_(id_arrow), pa.list_(label_arrow), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.binary())] * 3)]
            yield pa.RecordBatch.from_arrays([*none, pa.array([some.tolist()], pa.list_(pa.int64())), pa.array([changes[some].tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())], names=state.names)

    def loaded(batches):
        for b in batches:
            ids, labels = b.column(0), b.column(1)
            for i in range(b.num_rows):
                n, width, body = (b.column(c)[i].as_py() for c in (2, 3, 4))
                heaps = [Heaps.load(*h) for h in zip(*(b.column(c)[i].as_py() for c in (5, 6, 7)), strict=True)]
                yield ids[i].values, labels[i].values, np.frombuffer(body, f"<i{width}").reshape(n, *shape).astype(np.int64), heaps

    def first_pass(shared):
        return lambda batches: passed(shared, ((i, lab, x, None) for i, lab, x in blocks(batches)))

    def next_pass(shared):
        return lambda batches: passed(shared, loaded(batches))

    def last_pass(shared):
        def step(batches):
            for ids, labels, x, heaps in loaded(batches):
                heaps, _, _, _ = assign(x, heaps, shared.value)
                codes = np.stack([h.codes(len(x)) for h in heaps], axis=1)
                picked = shared.value.entries[np.arange(parts), codes]
                error = ((x - picked) ** 2).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=result.names)

        return step

    if not rows:
        return Codes(own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books, [])
    held, sums, counts, scanned = None, np.zeros((parts, n_books, length), np.int64), np.zeros((parts, n_books), np.int64), []
    for _ in range(max(1, rounds)):
        shared = spark.sparkContext.broadcast(books)
        source, step = (own, first_pass(shared)) if held is None else (held.filter("cells is null").select(state.names[:8]), next_pass(shared))
        held = C.stage(source.mapInArrow(step, state), "vector-blocks")
        told = held.filter("cells is not null")
        # parts x entries x (length + 1) cells at most, however many vectors there are.
        changes = told.select(F.explode(F.arrays_zip("cells", "changes")).alias("c")).groupBy("c.cells").agg(F.sum("c.changes").alias("change")).collect()
        flat = np.zeros(sums.size + counts.size, np.int64)
        for r in changes:
            flat[r["cells"]] = r["change"]
        sums, counts = sums + flat[: sums.size].reshape(sums.shape), counts + flat[sums.size :].reshape(counts.shape)
        scanned.append(told.agg(F.sum("scanned")).first()[0])
        if rounds:
            books = books.moved(sums, counts)
    shared = spark.sparkContext.broadcast(books)
    codes = held.filter("cells is null").select(state.names[:8]).mapInArrow(last_pass(shared), result)
    return Codes(C.stage(codes, "vector-codes"), books, scanned)


def reconstruct(codes: DataFrame, books: Codebooks, *, code: str = "code", out: str = "embedding", scale: int = SCALE) -> DataFrame:
    """codes with a column of the vectors that the codes stand for: the middle of each component's step."""
    entries, keep = books.entries, C.others(codes, [out])
    source = codes.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{code}`").alias("__code"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__x", T.ArrayType(T.DoubleType()))])

    def step(batches):
        for b in batches:
            found = [None if c is None else ((entries[np.arange(len(entries)), np.frombuffer(bytes.fromhex(c), np.uint8)] + 0.5) / scale).reshape(-1).tolist() for c in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return source.mapInArrow(step, schema).toDF(*keep, out)


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = found.codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(found.books.sha256()).alias("codebooks_sha256"))


def _round_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (
  SELECT rid, p, x, arg_min(k, d * 256 + k) AS k, min(d) AS d
  FROM (SELECT rid, parts.p, k, parts.x, list_sum(list_transform(list_zip(parts.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c{r} ON parts.p = c{r}.p)
  GROUP BY rid, p, x
),
m{r} AS (SELECT p, k, i, floor(sum(x[i]) / count(*))::BIGINT AS v FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, k, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.k, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT p, k, list(v ORDER BY i) AS x FROM m{r} GROUP BY p, k) m ON m.p = c{r}.p AND m.k = c{r}.k)"""


def _sql() -> str:
    rounds = ",".join(_round_sql(r) for r in range(ROUNDS))
    last = _round_sql(ROUNDS).split(",\nm")[0]
    return f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
parts AS MATERIALIZED (SELECT rid, p, e[p * (len(e) // {PARTS}) + 1 : (p + 1) * (len(e) // {PARTS})] AS x FROM whole, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x FROM parts WHERE rid <= {ENTRIES}),{rounds},{last},
found AS (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, k, i)) FROM (SELECT p, k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c{ROUNDS})) AS codebooks_sha256
FROM whole JOIN found USING (rid)"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}
