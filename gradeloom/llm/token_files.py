"""Token ids in binary files: fixed-width bit packing, with block offsets for random access.

Each id takes the bits that the vocabulary needs and no more, so 32 ids of w bits fill w 32-bit words exactly; packing and unpacking
shift 32 columns at once in numpy. A file (`.tok`) holds, in this order: blocks of BLOCK ids, the last one shorter; the documents'
ids as an Arrow stream; the end of each document, counted in ids, as 64-bit integers; the byte offset of each block; a tail of
TAIL's fields (magic, bits, ids a block, documents, ids, places of the three sections, crc32 of the tables). All integers are
little-endian. Any document is read by its two ends, the offsets of its blocks, and those blocks alone (`TokenFile.ids`).

`write_tokens` writes a corpus in ascending order of its ids as a folder of such files and a manifest, a Parquet table of one row a
file. Files get names of their own in each attempt of a task, and Spark's commit of the manifest says which count, so attempts that
are lost or run twice leave at most files that no reader looks at; `sweep` deletes those. `read_tokens` and `read_digests` read the
files that the manifest names, a file a row, in tasks.

Tokens are those of the `tokenizers` library. Its file's normaliser and pre-tokenizer drop white space and no token reaches across
it, so texts are cut at spaces, tabs and line breaks and words that were met before are remembered; `Encoder` refuses a tokenizer for
which that is not so and encodes whole texts then. Tests hold ids against the library's for whole texts.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; rows of one doc_id are ordered by their texts'
hashes, and rows equal in both stand together in any order, which no output can tell; texts of any length are encoded in parts; an
empty table gives a manifest without rows; inner columns are renamed, so none of the input's clash.

Scale: the scan encodes, and what it makes is written packed in the shared folder, since dealing by range samples its rows first; then
one shuffle of the packed ids by range of (doc_id, hash, place of the row), which also splits the rows of one id, and each task writes
its range block by block. A worker holds two blocks, a file's table of documents (at most FILE_DOCS) and CACHED words.
"""

from __future__ import annotations

import array
import functools
import io
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK = 1 << 14
#: A file ends with the document that reaches one of these.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
CACHED, LONGEST_CACHED = 400_000, 40
#: Signs that may end a word of letters, and the end of the letters that every Unicode version has.
SIGNS, LATIN_END = ".,;:!?", "\u0250"
PART = 1 << 20
MAGIC = b"GLTOKEN1"
TAIL = struct.Struct("<8sIIQQQQQI")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bits_for(vocabulary: int) -> int:
    """The bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits (bits up to 32), little-endian bit by bit, filled up to a multiple of 32 ids."""
    n = -(-len(ids) // 32)
    rows = np.zeros((n, 32), np.uint32)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, bits), np.uint32)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, word] |= rows[:, j] << np.uint32(shift)
        if shift + bits > 32:
            out[:, word + 1] |= rows[:, j] >> np.uint32(32 - shift)
    return out.astype("<u4", copy=False).tobytes()


def unpack(body: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    words = np.frombuffer(body, "<u4").reshape(-1, bits)
    out = np.empty((len(words), 32), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, j] = words[:, word] >> np.uint32(shift)
        if shift + bits > 32:
            out[:, j] |= words[:, word + 1] << np.uint32(32 - shift)
    out &= mask
    return out.reshape(-1)[:n]


def _known_rules(config: dict) -> bool:
    """Whether the tokenizer normalises by NFC, white space and case alone, and makes words of letters alone and of signs alone."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    plain = {"NFC", "Replace", "Lowercase"}
    if {n["type"] for n in steps} != plain or any(n["type"] == "Replace" and (n["pattern"], n["content"]) != ({"Regex": r"\s+"}, " ") for n in steps):
        return False
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"] or not (cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"):
        return False
    runs = cuts[0]["pattern"].get("Regex", "").split("|")
    return runs[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] and all(r.startswith("'") for r in runs[:-3])


class Encoder(dict):
    """Ids of texts; maps a word to its ids' bytes. Words live in two generations, so those in use stay when one is full.

    Where the rules are known, a word that ends in a sign is what stands before and the sign, and a word of ASCII letters goes to the
    library's model as it is: normaliser and pre-tokenizer would but lower it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.old: dict[str, bytes] = {}
        # Where white space yields ids, or changes those beside it, words can't be encoded apart.
        probe = ["a", "ab's", "1", "é!", "  "]
        apart = [i for w in probe for i in self._ids(w)]
        self.by_rule = _known_rules(json.loads(self.tokenizer.to_str()))
        self.by_word = self.by_rule and all(self._ids(sep.join(probe)) == apart for sep in (" ", "\n", "\t", " \n ")) and not self._ids(" \t\n")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isascii() and word.isalpha():
                found = array.array(self.code, [t.id for t in self.model.tokenize(word.lower())]).tobytes()
            elif word[-1:] in SIGNS and word[:-1].lower().isalpha() and max(word) < LATIN_END:
                return self[word[:-1]] + self[word[-1]]
            else:
                found = array.array(self.code, self._ids(word)).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian integers of `dtype`."""
        if not text:
            return b""
        if not self.by_word:
            return np.array(self._ids(text), self.dtype).tobytes()
        out, at = [], 0
        while at < len(text):
            to = len(text) if len(text) - at <= 2 * PART else max(text.find(" ", at + PART), 0) or len(text)
            words = text[at:to].replace("\n", " ").replace("\t", " ").split(" ")
            out.append(b"".join(map(self.__getitem__, words)))
            at = to
        return b"".join(out)


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, which remembers words from task to task."""
    return Encoder(path)


class TokenFile:
    """One file, by random access."""

    def __init__(self, path: str, filesystem: pafs.FileSystem | None = None):
        if filesystem is None:
            filesystem, path = pafs.FileSystem.from_uri(path)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(TAIL.size, size - TAIL.size) if size >= TAIL.size else b""
        if len(tail) < TAIL.size or tail[:8] != MAGIC:
            raise ValueError(f"no token file: {path}")
        _, self.bits, self.block, self.n_docs, self.n_ids, self.docs_at, self.ends_at, self.offsets_at, crc = TAIL.unpack(tail)
        tables = self.file.read_at(size - TAIL.size - self.docs_at, self.docs_at)
        if zlib.crc32(tables) != crc:
            raise ValueError(f"damaged token file: {path}")
        self.doc_ids = pa.ipc.open_stream(tables[: self.ends_at - self.docs_at]).read_all().column(0)
        self.ends = np.frombuffer(tables, "<u8", self.n_docs, self.ends_at - self.docs_at).astype(np.int64)
        self.offsets = np.frombuffer(tables, "<u8", -(-self.n_ids // self.block) + 1, self.offsets_at - self.docs_at).astype(np.int64)

    def close(self) -> None:
        self.file.close()

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1 of the file, from the blocks that hold them."""
        lo, hi = max(0, lo), min(hi, self.n_ids)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        body = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        # All blocks but the last are full and a multiple of 32 ids, so neighbours unpack as one.
        return unpack(body, self.bits, min(self.n_ids, (last + 1) * self.block) - first * self.block)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, the end id included."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def parts(self, most: int = BLOCK * 64):
        """(lo, hi, ids, document of id lo) of the whole file, `most` ids at a time."""
        lo = k = 0
        while lo < self.n_ids:
            hi = min(self.n_ids, lo + most)
            yield lo, hi, self.ids(lo, hi), k
            k = int(np.searchsorted(self.ends, hi, "right"))
            lo = hi


class _Writer:
    """Appends documents to a file until it is closed."""

    def __init__(self, filesystem: pafs.FileSystem, path: str, bits: int, block: int):
        self.out, self.bits, self.block = filesystem.open_output_stream(path), bits, block
        self.name = os.path.basename(path)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_docs = self.at = 0
        self.offsets, self.ends, self.doc_ids = [0], [], []

    def add(self, doc_ids: pa.Array, bodies: list[np.ndarray]) -> None:
        for ids in bodies:
            self.n_ids += len(ids)
            self.ends.append(self.n_ids)
            self.waiting.append(ids)
            self.n_waiting += len(ids)
            if self.n_waiting >= self.block:
                self._blocks()
        self.doc_ids.append(doc_ids)
        self.n_docs += len(bodies)

    def _blocks(self, rest: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        full = len(ids) if rest else len(ids) - len(ids) % self.block
        for lo in range(0, full, self.block):
            body = pack(ids[lo : min(lo + self.block, full)], self.bits)
            self.out.write(body)
            self.at += len(body)
            self.offsets.append(self.at)
        self.waiting = [ids[full:]]
        self.n_waiting = len(ids) - full

    def close(self) -> tuple[str, int, int, int]:
        """(name, documents, ids, bytes)"""
        self._blocks(rest=True)
        sink = io.BytesIO()
        table = pa.table({"doc_id": pa.chunked_array(self.doc_ids)})
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        docs, ends, offsets = sink.getvalue(), np.array(self.ends, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes()
        tables = docs + ends + offsets
        tail = TAIL.pack(MAGIC, self.bits, self.block, self.n_docs, self.n_ids, self.at, self.at + len(docs), self.at + len(docs) + len(ends), zlib.crc32(tables))
        self.out.write(tables + tail)
        self.out.close()
        return self.name, self.n_docs, self.n_ids, self.at + len(tables) + len(tail)


def encoded(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, h, __body): each text's ids with the end id, as compressed integers; h is a hash of the text."""
    path = path or tokenizer_path()
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__body", T.BinaryType())])

    def step(batches):
        encoder = _encoder(path)
        if end_id >= encoder.size:
            raise ValueError(f"the end id {end_id} is not below the vocabulary's size {encoder.size}")
        end, z = np.array([end_id], encoder.dtype).tobytes(), zstandard.ZstdCompressor(level=3)
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                bodies = [z.compress(encoder.encode(t) + end) for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bodies, pa.binary())], names=schema.names)

    return source.mapInArrow(step, schema)


MANIFEST = "part long, k long, name string, n_docs long, n_ids long, n_bytes long, bits int"


def write_tokens(docs: DataFrame, folder: str, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = END_ID, block: int = BLOCK, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes docs' ids below folder (a path that all executors share) in ascending order of doc_id; the manifest."""
    if block % 32:
        raise ValueError("a block holds a multiple of 32 ids")
    spark = docs.sparkSession
    path = path or tokenizer_path()
    size = Encoder(path).size
    bits, kind = bits_for(size), np.dtype("<u2" if size <= 1 << 16 else "<u4")
    filesystem, root = pafs.FileSystem.from_uri(_uri(folder))
    filesystem.create_dir(f"{root}/files", recursive=True)
    staged = C.stage(encoded(docs, text=text, doc_id=doc_id, path=path, end_id=end_id), "token-ids")
    order = ["doc_id", "h", "place"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "__body")

    def step(batches):
        part, writer, done = TaskContext.get().partitionId(), None, []
        attempt = uuid.uuid4().hex

        def close():
            done.append((part, len(done), *writer.close(), bits))

        z = zstandard.ZstdDecompressor()
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                b = big.slice(lo, 500)
                bodies = [np.frombuffer(z.decompress(x), kind) for x in b.column(1).to_pylist()]
                at = 0
                while at < len(bodies):
                    if writer is None:
                        writer = _Writer(filesystem, f"{root}/files/{part:06d}-{len(done):04d}-{attempt}.tok", bits, block)
                    total = writer.n_ids + np.cumsum([len(x) for x in bodies[at:]])
                    n = min(len(bodies) - at, int(np.searchsorted(total, file_ids)) + 1, file_docs - writer.n_docs)
                    writer.add(b.column(0).slice(at, n), bodies[at : at + n])
                    at += n
                    if writer.n_ids >= file_ids or writer.n_docs >= file_docs:
                        close()
                        writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], schema=_MANIFEST_ARROW)

    dealt.mapInArrow(step, MANIFEST).write.parquet(f"{_uri(folder)}/manifest")
    return manifest(spark, folder)


_MANIFEST_ARROW = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("bits", pa.int32())])


def _uri(folder: str) -> str:
    return folder.rstrip("/") if ":/" in folder else f"file://{os.path.abspath(folder)}"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row a file, with start and first_doc: how many ids and documents the files before it hold."""
    # A row a file of up to file_ids ids: few enough for one task.
    earlier = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.schema(MANIFEST).parquet(f"{_uri(folder)}/manifest")
    return found.withColumns({"start": F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)), "first_doc": F.coalesce(F.sum("n_docs").over(earlier), F.lit(0))})


def _over_files(spark: SparkSession, folder: str, each, doc_type: T.DataType, made: str) -> DataFrame:
    """Rows of each(file, start) for every file of the manifest, a file at a time in tasks."""
    files = manifest(spark, folder).select("name", "start")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    filesystem, root = pafs.FileSystem.from_uri(_uri(folder))
    schema = T.StructType([T.StructField("doc_id", doc_type), *T.StructType.fromDDL(made).fields])

    def step(batches):
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = TokenFile(f"{root}/files/{name}", filesystem)
                try:
                    yield from each(found, start, schema.names)
                finally:
                    found.close()

    return files.repartition(parts, "name").mapInArrow(step, schema)


def _digests(found: TokenFile, start: int, names: list[str]):
    ends = found.ends
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    crcs = np.zeros(found.n_docs, np.int64)
    for lo, hi, ids, k in found.parts():
        data = memoryview(ids.astype("<u4", copy=False)).cast("B")
        while k < found.n_docs and starts[k] < hi:  # a document that goes on in the next part is taken up there again
            a, b = max(int(starts[k]), lo) - lo, min(int(ends[k]), hi) - lo
            crcs[k] = zlib.crc32(data[4 * a : 4 * b], int(crcs[k]))
            k += 1
    doc_ids = found.doc_ids.combine_chunks()
    for lo in range(0, found.n_docs, 20_000):
        at = slice(lo, lo + 20_000)
        yield pa.RecordBatch.from_arrays([doc_ids[at], pa.array(starts[at] + start), pa.array(ends[at] - starts[at]), pa.array(crcs[at])], names=names)


def read_digests(spark: SparkSession, folder: str, doc_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; a task holds a part of 2**20 ids at a time."""
    return _over_files(spark, folder, _digests, doc_type, "start long, n_tokens long, ids_crc32 long")


def _documents(found: TokenFile, start: int, names: list[str], most: int = 1 << 20):
    doc_ids, ends = found.doc_ids.combine_chunks(), found.ends
    k = 0
    while k < found.n_docs:
        first = int(ends[k - 1]) if k else 0
        to = max(k + 1, int(np.searchsorted(ends, first + most, "right")))
        offsets = np.concatenate([[first], ends[k:to]]) - first
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.ids(first, int(ends[to - 1])).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([doc_ids[k:to], pa.array(offsets[:-1] + first + start), ids], names=names)
        k = to


def read_tokens(spark: SparkSession, folder: str, doc_type: T.DataType) -> DataFrame:
    """(doc_id, start, ids) of each document, the end id last."""
    return _over_files(spark, folder, _documents, doc_type, "start long, ids array<int>")


def sweep(spark: SparkSession, folder: str) -> int:
    """Deletes the files below folder that its manifest does not name, once it is written; how many there were."""
    filesystem, root = pafs.FileSystem.from_uri(_uri(folder))
    named = {r["name"] for r in manifest(spark, folder).select("name").toLocalIterator()}
    stray = [f.path for f in filesystem.get_file_info(pafs.FileSelector(f"{root}/files")) if f.base_name not in named]
    for path in stray:
        filesystem.delete_file(path)
    return len(stray)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{C.checkpoint_dir(spark)}/gradeloom/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder)
    return read_digests(spark, folder, docs.schema["doc_id"].dataType)


QUERIES = {"op13_token_files": op13_token_files}
ORACLES: dict[str, str] = {}
