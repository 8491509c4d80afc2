"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams, scanned over training windows.

Words are maximal runs of digits, letters a-z (A-Z are lower-cased first) and non-ASCII characters. A window is n consecutive
words of an item; an item of 1 to n - 1 words is one window. A document word inside any occurrence of a window is hit.
Every match of hashes is verified on the words themselves, so results are exact.

Defined cases: a very long text is scanned in a step of its own; a null or wordless text has no words and is clean; a null or wordless item has no windows; an item whose id is
null marks hits but is neither listed nor counted; items that share an id count once; repeated documents each get their own
row; with an empty benchmark all is clean; result columns replace input columns of the same name.

Scale: documents are scanned once, without a shuffle. The benchmark is split by hash into blocks of at most `max_windows`
windows, as its measured size demands. One block is broadcast at a time; with more than one, the passes are chained through
staged tables, and each pass adds its hits, so the broadcast stays bounded for a benchmark of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

N_WORDS = 10
MAX_WINDOWS = 200_000
HITS = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MADE = ["n_words", "hits", "items"]


def _windows(items: list[tuple[str | None, str]], n: int) -> dict[int, dict]:
    """For each window length the sorted hashes, the words of each window, and the ids of its items."""
    found: dict[int, dict[bytes, set]] = {}
    for item, text in items:
        words = bytes(text.encode()).translate(bytes(C.LOWER)).translate(C.TO_SPACE).split()
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            found.setdefault(k, {}).setdefault(b" ".join(words[i : i + k]), set()).add(item)
    out = {}
    for k, windows in found.items():
        texts = list(windows)
        data = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        begin, end, _ = C.word_spans(data, offs)
        h = C.gram_hashes(C.span_hashes(data, begin, end), k)[::k]
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[h >> np.uint64(44)] = True
        out[k] = {"hash": h[order], "bits": bits, "texts": [texts[i] for i in order], "items": [sorted(x for x in windows[texts[i]] if x is not None) for i in order]}
    return out


class _Scanner:
    def __init__(self, tables: dict[int, dict]):
        self.tables, self.known = tables, {}

    def verified(self, raw: bytes, k: int, at: int) -> int:
        """The window with these words among those of equal hash from `at` on, or -1."""
        key = (raw, k)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            t, words, i = self.tables[k], b" ".join(raw.translate(C.TO_SPACE).split()), at
            while i < len(t["texts"]) and t["hash"][i] == t["hash"][at] and t["texts"][i] != words:
                i += 1
            self.known[key] = i if i < len(t["texts"]) and t["texts"][i] == words else -1
        return self.known[key]

    def scan(self, data: np.ndarray, offs: np.ndarray):
        """n_words per row; hit intervals as (row, first word, words, begin, end in characters); (row, item) pairs."""
        low = C.LOWER[data]
        begin, end, row = C.word_spans(low, offs)
        n_words = np.bincount(row, minlength=len(offs) - 1)
        words = C.span_hashes(low, begin, end)
        edges, pairs = np.zeros(len(begin) + 1, np.int32), set()
        for k, t in self.tables.items():
            h = C.gram_hashes(words, k)
            if not len(h):
                continue
            at = np.flatnonzero(t["bits"][h >> np.uint64(44)] & (row[: len(h)] == row[k - 1 :]))
            where = np.minimum(np.searchsorted(t["hash"], h[at]), len(t["hash"]) - 1)
            same = t["hash"][where] == h[at]
            for i, w in zip(at[same].tolist(), where[same].tolist(), strict=True):
                w = self.verified(low[begin[i] : end[i + k - 1]].tobytes(), k, w)
                if w >= 0:
                    edges[i] += 1
                    edges[i + k] -= 1
                    pairs.update((int(row[i]), item) for item in t["items"][w])
        return n_words, begin, end, row, np.cumsum(edges[:-1]) > 0, pairs


def _results(scanner: _Scanner, text: pa.Array, old_hits: list | None, old_items: list | None):
    data, offs = C.buffers(text)
    counts, hits, items = [], [], []
    for lo, hi in C.chunks(offs):
        part, po = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        n_words, begin, end, row, hit, pairs = scanner.scan(part, po)
        first_of = np.concatenate([[0], np.cumsum(n_words)])
        own_items: list[set] = [set() for _ in range(hi - lo)]
        for r, item in pairs:
            own_items[r].add(item)
        if old_hits is not None:
            for r in range(hi - lo):
                own_items[r].update(old_items[lo + r] or ())
                for x in old_hits[lo + r] or ():
                    hit[first_of[r] + x["first_word"] : first_of[r] + x["first_word"] + x["n_words"]] = True
        runs: list[list] = [[] for _ in range(hi - lo)]
        if hit.any():
            new = np.concatenate([[True], row[1:] != row[:-1]])
            head = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]])))
            tail = np.flatnonzero(hit & (np.concatenate([new[1:], [True]]) | ~np.concatenate([hit[1:], [False]])))
            chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            for a, b in zip(head.tolist(), tail.tolist(), strict=True):
                r = int(row[a])
                runs[r].append({"first_word": a - int(first_of[r]), "n_words": b - a + 1, "begin": int(chars[begin[a]] - chars[po[r]]), "end": int(chars[end[b]] - chars[po[r]])})
        counts += n_words.tolist()
        hits += runs
        items += [sorted(x) for x in own_items]
    return counts, hits, items


def _blocks(benchmark: DataFrame, n: int, item_id: str, text: str, max_windows: int) -> list:
    """Broadcasts of at most about max_windows windows each; an item of more than that is cut with n - 1 words of overlap."""
    spark = benchmark.sparkSession
    words = F.expr("filter(split(translate(coalesce(`%s`, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), x -> x <> '')" % text)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    step = max(1, max_windows)
    pieces = items.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(0, size(words) - {n}), {step}), i -> array_join(slice(words, i + 1, {step + n - 1}), ' '))")).alias("text"))
    total = items.select(F.sum(F.greatest(F.lit(1), F.size("words") - (n - 1)))).first()[0] or 0
    count = max(1, -(-int(total) // max_windows))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    out = []
    for block in range(count):
        rows = [(r["item"], r["text"]) for r in pieces.filter(F.col("block") == block).select("item", "text").distinct().toLocalIterator()]
        out.append(spark.sparkContext.broadcast(_windows(rows, n)))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = N_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs' columns (or those of `keep`) with n_words, hits (runs of hit words, with word and character positions) and items (ids, sorted)."""
    keep = C.others(docs, MADE) if keep is None else [c for c in keep if c.lower() not in MADE]
    blocks = _blocks(benchmark, n, item_id, item_text, max_windows)
    inner = [f"c{k}" for k in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).toDF(*inner, "__text")
    made = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType()))]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        fields = [*source.schema.fields[: len(keep)], *([] if last else [T.StructField("__text", T.StringType())]), *made]
        out = T.StructType(fields)

        def step(batches, block=block, last=last, width=len(keep)):
            scanner = _Scanner(block.value)
            for b in batches:
                names = [f.name for f in b.schema]
                before = names[width + 1 :] == MADE
                body = b.column(width)
                counts, hits, items = _results(scanner, body, b.column(width + 2).to_pylist() if before else None, b.column(width + 3).to_pylist() if before else None)
                hit_type = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
                cols = [b.column(i) for i in range(width)] + ([] if last else [body]) + [pa.array(counts, pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=names[:width] + ([] if last else ["__text"]) + MADE)

        source = source.mapInArrow(step, out)
        if not last:
            source = C.stage(source, "decontaminate")
    return source.toDF(*keep, *MADE)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit word; docs' columns as they are."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(options.pop("text", "text")).alias("text"))
    found = scan(own, benchmark, keep=["__row"], **options)
    return found.filter(F.size("hits") == 0).select("__row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with every run of hit words cut from the text, and nothing else changed."""
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("text")), benchmark, keep=["__row", "text"], **options)
    cut = F.expr("concat(aggregate(hits, named_struct('at', 0, 'out', ''), (s, h) -> named_struct('at', h.end, 'out', concat(s.out, substring(text, s.at + 1, h.begin - s.at))), s -> s.out), substring(text, coalesce(try_element_at(hits, -1).end, 0) + 1))")
    found = found.withColumn("__cut", F.when(F.size("hits") == 0, F.col("text")).otherwise(cut))
    return found.select(*[(F.col("__cut") if c == text else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def digest(found: DataFrame, *more: Column) -> DataFrame:
    """The report's columns, from those of scan()."""
    return found.select(
        *more,
        "n_words",
        F.expr("aggregate(hits, 0L, (a, h) -> a + h.n_words)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]), F.col("doc_id"))


ORACLE = r"""
with d as (
  select doc_id, rowid as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (select *, row_number() over () as rowid from documents)
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), ks as (select distinct k from bw), dw as (
  select rid, k, i, array_to_string(w[i : i + k - 1], ' ') as g
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)
), h as (select rid, dw.k, i, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
n as (select rid, count(distinct j) as n_hit from (select rid, unnest(range(i, i + k)) as j from h) group by rid),
m as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join n using (rid) left join m using (rid)
"""
QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": ORACLE}
