"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

Each distinct 5-word shingle of a text is hashed once; the upper bits of its hash name a bin and the least hash in a bin is
its value. An empty bin takes the value of a filled one, found by a sequence of probes that depends on the empty bin alone
(the same in every document). Of each value the low BITS bits are kept and packed. The share of equal bins of two fingerprints,
less the share 2**-BITS that equals by chance, estimates the Jaccard similarity of the shingle sets.

Defined cases: `bins` must be a power of two; a null text is empty; a very long text is hashed in a step of its own; an empty table gives none; a text without words has the fingerprint "", which is like another such with 1 and like
any other with 0; equal texts have equal fingerprints; repeated rows each get their own; a table of one document is followed
by itself; documents are ordered by doc_id (null first), then by content hashes; result columns replace input columns of the same name.

Scale: fingerprints need one scan and no shuffle. The report, which compares each document with the next, deals the texts out
by range of doc_id once and sorts each range; a task carries the last text over to the next batch. Where two ranges meet, the
outer rows are set aside with their texts, two a range, and paired by a join on the number of the range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

N_WORDS = 5
BINS = 512
BITS = 4


def _bins(text: pa.Array, n_words: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of each bin of each text, and which texts have shingles at all."""
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    data, offs = C.buffers(text)
    n, shift = len(offs) - 1, np.uint64(64 - (bins - 1).bit_length())
    out, some = np.zeros((n, bins), np.uint64), np.zeros(n, bool)
    none = np.uint64(2**64 - 1)
    for lo, hi in C.chunks(offs):
        h, r = C.shingles(C.LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], n_words)
        least = np.full((hi - lo) * bins, none, np.uint64)
        np.minimum.at(least, r * bins + (h >> shift).astype(np.int64), h << np.uint64(64) - shift)
        least = least.reshape(hi - lo, bins)
        filled = least != none
        own = filled.any(axis=1)
        row, empty = np.nonzero(~filled & own[:, None])
        probe, turn = empty.astype(np.uint64), 0
        while len(row):
            turn += 1
            at = (C.mix(probe * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
            found = filled[row, at]
            least[row[found], empty[found]] = least[row[found], at[found]]
            row, empty, probe = row[~found], empty[~found], probe[~found]
        out[lo:hi], some[lo:hi] = least, own
    return out, some


def packed(text: pa.Array, *, n_words: int = N_WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of the bins (rows x bins, uint8), and which texts have any."""
    values, some = _bins(text, n_words, bins)
    # With the bin's number mixed in, a value that fills many bins meets another's by chance in each bin anew.
    place = C.mix(np.arange(1, bins + 1, dtype=np.uint64))
    return (C.mix(values ^ place) & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def as_text(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints in hexadecimal digits, the bits of consecutive bins side by side."""
    spread = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), low.shape[1] * bits)
    return [bytes(x).hex() if s else "" for x, s in zip(np.packbits(spread, axis=1), some, strict=True)]


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, without what low bits share by chance."""
    chance = 2.0**-bits
    near = np.clip(((a == b).mean(axis=1) if a.shape[1] else np.zeros(len(a))) - chance, 0, None) / (1 - chance)
    return np.where(has_a & has_b, near, (has_a == has_b).astype(np.float64))


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint", **options) -> DataFrame:
    """docs with a column of fingerprints."""
    keep = C.others(docs, [out])
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))

    def step(batches):
        for b in batches:
            low, some = packed(b.column(1), **options)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_text(low, some, options.get("bits", BITS)), pa.string())], names=["row", "print"])

    schema = T.StructType([own.schema["row"], T.StructField("print", T.StringType())])
    return own.mapInArrow(step, schema).select("row.*", F.col("print").alias(out))


def _edited(texts: list[str], following: list[str]) -> list[str]:
    return [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]


def compare(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_words: int = N_WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, and the likeness to it and to the next document's."""
    k1, k2 = C.row_key(docs, doc_id, text)
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows that equal one another are told apart by their place in the input, so that they can be dealt to several ranges.
    order = ["doc_id", "k1", "k2", "place"]
    dealt = C.pack_text(own, "text").withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "__body")
    id_type = own.schema["doc_id"].dataType.simpleString()
    made = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", *(x.split()[0] for x in made.split(", "))]

    def results(ids, texts: list[str], following: list[str]) -> list:
        """Columns; following[i] comes after texts[i]."""
        edited = _edited(texts, following)
        n = len(texts)
        low, some = packed(pa.array([*texts, *following[-1:]], pa.large_string()), n_words=n_words, bins=bins, bits=bits)
        low_e, some_e = packed(pa.array(edited, pa.large_string()), n_words=n_words, bins=bins, bits=bits)
        if n and following[:-1] != texts[1:]:
            low_f, some_f = packed(pa.array(following, pa.large_string()), n_words=n_words, bins=bins, bits=bits)
        else:
            low_f, some_f = low[1:], some[1:]
        low, some = low[:n], some[:n]
        return [
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(as_text(low, some, bits), pa.string()), pa.array(as_text(low_e, some_e, bits), pa.string()),
            pa.array(likeness(low, some, low_e, some_e, bits), pa.float64()), pa.array(likeness(low, some, low_f, some_f, bits), pa.float64()),
        ]

    def pieces(batch, most=2_000):
        for lo in range(0, batch.num_rows, most):
            yield batch.slice(lo, most)

    def step(batches):
        part = TaskContext.get().partitionId()
        last_id, last_text, first = None, None, None
        for big in batches:
            for b in pieces(big):
                texts = [x.decode() for x in C.unpack(b.column(1).to_pylist())]
                ids = b.column(0)
                if first is None:
                    first = (ids[:1], texts[0])
                    before = ids[:0]
                else:
                    before = last_id
                    texts = [last_text, *texts]
                all_ids = pa.concat_arrays([before, ids])
                last_id, last_text = all_ids[-1:], texts[-1]
                done = results(all_ids[:-1], texts[:-1], texts[1:])
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names=[*names, "part", "first", "text"])
        if first is not None:
            ids = pa.concat_arrays([first[0], last_id])
            blank = [pa.nulls(2, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([ids, *blank, pa.array([part] * 2, pa.int64()), pa.array([True, False]), pa.array([first[1], last_text], pa.string())], names=[*names, "part", "first", "text"])

    staged = C.stage(dealt.mapInArrow(step, f"doc_id {id_type}, {made}, part long, first boolean, text string"), "fingerprints")
    outer = staged.filter("part is not null").select("doc_id", "part", "first", "text")
    follows = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turns = outer.filter("first").select("part").withColumn("next_part", follows)
    firsts = outer.filter("first").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    pairs = outer.filter("not first").join(turns, "part").join(firsts, "next_part").select("doc_id", "text", "following")

    def meet(batches):
        for big in batches:
            for b in pieces(big):
                yield pa.RecordBatch.from_arrays(results(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()), names=names)

    met = pairs.mapInArrow(meet, f"doc_id {id_type}, {made}")
    return staged.filter("part is null").select(names).unionByName(met)


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_fingerprint": op6_fingerprint}
ORACLES: dict[str, str] = {}
