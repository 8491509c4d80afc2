"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else.

Texts are UTF-8 bytes; strings never cross texts; occurrences may overlap and may be in one text.

Suffixes are put in buckets first. Of all k-byte strings within the `length` bytes from a place, the one of the least hash,
leftmost if several, is the place's anchor; equal strings have equal anchors at equal distance, so a bucket is the set of places
whose anchor has one content. Consecutive places of one anchor are a run. Three cases settle all places:
1. an anchor's content occurs once: none of its run's strings repeats;
2. a run's whole extent (its first place to the end of its last string) occurs again, by 192 bits of hashes: all of it is covered;
3. the bucket's distinct extents are sorted as suffixes, a block of whole buckets at a time, by difference-cover construction:
   the cover sample's ranks are computed first by prefix doubling; the block's suffixes are sorted by their first COVER bytes,
   and ties by the rank of the sample suffix within the next COVER bytes. Neighbours that share `length` bytes repeat. A block's
   memory is bounded by BLOCK_BYTES and one bucket of at most MAX_EXTENTS extents.
A bucket of more distinct extents than that is split into buckets that fit, and those are sorted: its places, by their distance to
the anchor, are cut into aligned ranges, and in a range those extents share a bucket that have the same bytes in the core that
all strings of the range contain; so equal strings stay together. Equal cuts are one (pre-aggregated before the shuffle; covered,
if any occurs again). A core that still has too many cuts is split by narrower ranges, whose cores are longer. A level makes at
most SPLIT rows of one, so the work stays in proportion to the bucket.

Defined cases: a null text is empty; a text shorter than `length` loses nothing; equal rows are copies of each other, so all
their strings of `length` bytes go; very long texts are searched in overlapping pieces; of strings that tie all go; empty tables
give none; result columns replace input columns of the same name. `length` may be 32 to 1023, `anchor` a power of two of at most
half of it; other values raise an error.

Scale: what is shuffled of all runs (one in about (length - k) / 2 bytes) is five longs; texts are shuffled by a content key
twice, packed: once for the extents to be sorted and once to cut. Equal rows are one as soon as a task has seen one of them, but
where each is written out. Nothing is gathered but the extents of a bounded bucket.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

LENGTH = 200
ANCHOR = 32
COVER = 32
BLOCK_BYTES = 1 << 20
MAX_EXTENTS = 4096
#: Parts that a range of distances is cut into at a time.
SPLIT = 4
#: Keys that a task remembers to skip equal rows.
SEEN = 20_000
#: Longer texts are cut into overlapping pieces of so many places.
PIECE = 1 << 21
MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
_LEVELS = np.random.default_rng(C.SEED + 3).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def difference_cover(v: int) -> list[int]:
    """Residues of which every difference mod v occurs, chosen greedily: with them, for any two places there is a step below v that takes both into the cover."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = {c: {d for x in cover for d in ((c - x) % v, (x - c) % v)} & missing for c in range(v) if c not in cover}
        best = max(sorted(gain), key=lambda c: len(gain[c]))
        cover.append(best)
        missing -= gain[best]
    return sorted(cover)


def _anchor_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes from each place, k a power of two; the last k - 1 places have none."""
    h, step = C._BYTE_CODES[data], 1
    while step < k:
        h = h[:-step] * _LEVELS[step.bit_length()] + h[step:]
        h = h ^ (h >> np.uint64(29))
        step *= 2
    return C.mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def runs(data: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, first place in the row, number of places, distance of the anchor from it, anchor hash and two extent hashes of each run."""
    size = np.diff(offs)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if not (size >= length).any():
        return empty
    h = _anchor_hashes(data, k)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    order = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(order, length - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    rows = np.flatnonzero(size >= length)
    count = size[rows] - length + 1
    row = np.repeat(rows, count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offs[row]
    a = anchor[place]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.append(head, len(a)))
    first, a, row = place[head], a[head], row[head]
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    extent = np.frombuffer(b"".join([digest(raw[b:e]) for b, e in zip(first.tolist(), (first + n - 1 + length).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return row, first - offs[row], n, a - first, h[a], C.mix(extent[:, 0] ^ (a - first).astype(np.uint64)), extent[:, 1].copy()


def _refine(group: np.ndarray, value: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Splits groups by value; what is alone in its group is left out. The new groups, in order, and the rest of the arrays."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]) if len(g) else np.zeros(0, bool)
    ids = np.cumsum(new) - 1
    keep = np.bincount(ids)[ids] > 1 if len(g) else new
    return ids[keep], *(m[order][keep] for m in more)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair, equal pairs equal."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ((x[1:] != x[:-1]) | (y[1:] != y[:-1])).astype(np.int64)]))
    return out


def sort_block(extents: list[tuple[int, int, int, bytes]], length: int, cover: int = COVER) -> np.ndarray:
    """extents: (bucket, distance of the anchor, places, bytes). For every place of every extent in turn: does its string occur twice?"""
    # Anchors lie on multiples of the cover's period, so places that can be equal have one residue.
    starts, at = [], 0
    for _, off, _, body in extents:
        begin = -(-(at + off) // cover) * cover - off
        starts.append(begin)
        at = begin + len(body)
    size = at + length + 4 * cover + 264
    text = np.zeros(size + 8, np.uint8)
    for s, (_, _, _, body) in zip(starts, extents, strict=True):
        text[s : s + len(body)] = np.frombuffer(body, np.uint8)
    eight = np.ndarray(size, ">u8", text.data, 0, (1,)).astype(np.uint64)
    # Ranks of the cover sample by their first `reach` bytes; places beyond the end count as rank 0.
    residues = np.array(difference_cover(cover))
    sample = np.flatnonzero(np.isin(np.arange(size - 2 * cover) % cover, residues))
    rank = np.zeros(size + 512, np.int64)
    own = np.zeros(len(sample), np.int64)
    for step in range(0, cover, 8):
        own = _ranks(own, eight[sample + step])
    reach = cover
    rank[sample] = own + 1
    while reach < length:
        own = _ranks(rank[sample], rank[np.minimum(sample + reach, size + 511)])
        rank[sample] = own + 1
        reach *= 2
    ahead = np.array([min((int(c) - r) % cover for c in residues) for r in range(cover)])
    # Suffixes, by bucket and distance to the anchor, then by their first bytes, then by the sample's ranks.
    places = np.array([e[2] for e in extents])
    which = np.repeat(np.arange(len(extents)), places)
    j = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    place = np.array(starts)[which] + j
    number = np.arange(len(place))
    group, place, number = _refine(np.array([e[0] for e in extents])[which], np.array([e[1] for e in extents])[which] - j, place, number)
    for step in range(0, cover, 8):
        group, place, number = _refine(group, eight[place + step], place, number)
    twice = np.zeros(int(places.sum()), bool)
    if not len(place):
        return twice
    order = np.lexsort((rank[place + ahead[place % cover]], group))
    group, place, number = group[order], place[order], number[order]
    same = group[1:] == group[:-1]
    for step in range(cover, length, 8):
        step = min(step, length - 8)
        some = np.flatnonzero(same)
        same[some] = eight[place[some] + step] == eight[place[some + 1] + step]
    pair = np.flatnonzero(same)
    twice[number[pair]] = True
    twice[number[pair + 1]] = True
    return twice


def _intervals(twice: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Runs of repeated places as [begin, end) of the bytes they cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
    return [(first + a, first + b - 1 + length) for a, b in edge.reshape(-1, 2).tolist()]


def _packed_once(docs: DataFrame, key, text: str) -> DataFrame:
    """(k1, k2, body): the packed texts, of equal rows one a task."""
    source = docs.select(key[0].alias("k1"), key[1].alias("k2"), F.col(f"`{text}`").cast("binary").alias("body"))

    def step(batches):
        seen, z = set(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            new = []
            for k, key in enumerate(keys):
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    new.append(k)
            b = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([None if x is None else z.compress(x) for x in b.column(2).to_pylist()], pa.binary())], names=["k1", "k2", "body"])

    return source.mapInArrow(step, source.schema)


def _split_wide(wide: DataFrame, length: int, max_extents: int) -> tuple[DataFrame | None, DataFrame | None]:
    """wide: (ah, open, uid, place, n, off, body), extents of large buckets. Rows of the same kind in buckets that fit, and (uid, span) of cuts that occur again."""
    fields = "c1 long, c2 long, f1 long, f2 long, ah long, open boolean, uid long, place long, n long, off long, body binary"
    names = [f.split()[0] for f in fields.split(", ")]
    todo, spans, ready = wide.select(names[4:]), None, None
    size = SPLIT ** math.ceil(math.log(length, SPLIT))
    while size > 1:
        size //= SPLIT

        def cut(batches, size=size):
            for b in batches:
                rows, hashes = [], []
                for ah, is_open, uid, place, n, off, body in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                    # Places j = 0 to n - 1 have distances off - j; a range is [low, low + size) of distances.
                    for low in range((off - n + 1) // size * size, off + 1, size):
                        far, near = min(off, low + size - 1), max(off - n + 1, low)
                        begin, end = off - far, off - near + length
                        mark = b"%d|%d|%d|" % (size, ah, low)
                        core = body[max(0, off - low) : max(0, off - low - size + 1 + length)]
                        hashes.append(xxhash.xxh3_128_digest(mark + core) + xxhash.xxh3_128_digest(mark + b"%d|%d|" % (far, near) + body[begin:end]))
                        rows.append((ah, is_open, uid, place + begin, far - near + 1, far, body[begin:end]))
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 4)
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(h[:, k].copy()) for k in range(4)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

        parts = C.stage(todo.mapInArrow(cut, fields), "suffix-cuts")
        whole = C.stage(parts.groupBy("f1", "f2").agg(F.count("*").alias("c"), F.min(F.struct("uid", "place")).alias("one")), "suffix-cut-kinds")
        covered = parts.filter("open").join(whole.filter("c > 1").select("f1", "f2"), ["f1", "f2"], "left_semi").select("uid", F.struct(F.col("place").alias("begin"), (F.col("place") + F.col("n") - 1 + length).alias("end")).alias("span"))
        spans = covered if spans is None else spans.unionByName(covered)
        if size == 1:  # a cut is a string, so those that are left differ
            break
        ones = parts.join(whole.select(F.col("f1").alias("w1"), F.col("f2").alias("w2"), "c", F.col("one.uid").alias("u"), F.col("one.place").alias("p")), (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2")) & (F.col("uid") == F.col("u")) & (F.col("place") == F.col("p")))
        ones = C.stage(ones.withColumn("open", F.col("open") & (F.col("c") == 1)).select(names), "suffix-cut-ones")
        cores = C.stage(ones.groupBy("c1", "c2").agg(F.count("*").alias("k"), F.max("open").alias("any_open")).filter("k > 1 and any_open").select("c1", "c2", "k"), "suffix-cores")
        kept = C.stage(ones.join(cores, ["c1", "c2"]).withColumn("ah", F.col("c1")).select(*names[4:], "k"), "suffix-todo")
        fits = kept.filter(F.col("k") <= max_extents).drop("k")
        ready = fits if ready is None else ready.unionByName(fits)
        todo = kept.filter(F.col("k") > max_extents).drop("k")
        if todo.isEmpty():
            break
    return ready, spans


def find_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR, max_extents: int = MAX_EXTENTS) -> DataFrame:
    """(k1, k2, spans): for the rows that lose something, by content key, the [begin, end) they lose; spans may overlap."""
    if not COVER <= length <= 1023 or anchor < 2 or anchor & (anchor - 1) or anchor * 2 > length:
        raise ValueError(f"length must be {COVER} to 1023, and anchor a power of two of at most half of it")
    k1, k2 = C.row_key(docs, doc_id, text)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.monotonically_increasing_id().alias("uid"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text"))

    def scan(batches):
        for b in batches:
            data, offs = C.buffers(b.column(3))
            ids = [b.column(k).to_numpy() for k in range(3)]
            for lo, hi in C.chunks(offs):
                base = int(offs[lo])
                if offs[hi] - base > PIECE + length:  # one long text, in pieces that share length - 1 bytes
                    end = int(offs[hi])
                    pieces = [(s, min(s + PIECE + length - 1, end)) for s in range(base, max(base + 1, end - length + 1), PIECE)]
                    found = [(lo, s - base, runs(data[s:e], np.array([0, e - s]), length, anchor)) for s, e in pieces]
                else:
                    found = [(lo, 0, runs(data[base : offs[hi]], offs[lo : hi + 1] - base, length, anchor))]
                for first_row, shift, (row, place, n, off, ah, ch, dh) in found:
                    at = row + first_row
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in ids), pa.array((place + shift) << 20 | n << 10 | off), *(pa.array(x.view(np.int64)) for x in (ah, ch, dh))], names=["uid", "k1", "k2", "at", "ah", "ch", "dh"])

    staged = C.stage(source.mapInArrow(scan, "uid long, k1 long, k2 long, at long, ah long, ch long, dh long"), "suffix-runs")
    place, n, off = F.shiftright("at", 20), F.shiftright("at", 10).bitwiseAND(F.lit(1023)), F.col("at").bitwiseAND(F.lit(1023))
    whole = F.struct(place.alias("begin"), (place + n - 1 + length).alias("end"))
    # Case 1 goes: what is left are the buckets of anchors that occur again.
    # What a join filters by is staged, so that both of its sides come from exchanges, and a hot anchor's rows can be split.
    again = C.stage(staged.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah"), "suffix-again")
    repeated = C.stage(staged.select("uid", "at", "ah", "ch", "dh").join(again, "ah"), "suffix-repeated")
    kinds = repeated.groupBy("ah", "ch", "dh").agg(F.count("*").alias("c"), F.min(F.struct("uid", "at")).alias("one"))
    kinds = C.stage(kinds, "suffix-kinds")
    # Case 2: the extent occurs again.
    case_2 = repeated.join(C.stage(kinds.filter("c > 1").select("ah", "ch", "dh"), "suffix-twice"), ["ah", "ch", "dh"], "left_semi").select("uid", whole.alias("span"))
    # Case 3: buckets of several extents of which one at least occurs once.
    mixed = kinds.groupBy("ah").agg(F.count("*").alias("extents"), F.min("c").alias("least")).filter("extents > 1 and least = 1").select("ah", "extents")
    mixed = C.stage(mixed, "suffix-mixed")
    wanted = kinds.join(mixed, "ah").select("ah", "extents", (F.col("c") == 1).alias("open"), "one.uid", "one.at")
    # Of equal rows the first stands for all: what one loses all lose, and the one occurrence that a kind keeps is in it.
    of = C.stage(staged.groupBy("k1", "k2").agg(F.min("uid").alias("uid")), "suffix-docs")
    by_doc = wanted.groupBy("uid").agg(F.collect_list(F.struct("ah", "extents", "open", "at")).alias("wanted")).join(of.withColumnsRenamed({"k1": "d1", "k2": "d2"}), "uid")
    by_doc = C.stage(by_doc, "suffix-wanted")
    texts = _packed_once(docs, (k1, k2), text).join(C.hashed_side(by_doc), (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2"))).select("uid", "wanted", "body")

    def cut(batches):
        seen = set()
        for b in batches:
            out = []
            for uid, wants, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), C.unpack(b.column(2).to_pylist()), strict=True):
                if uid in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(uid)
                for w in wants:
                    p, m, d = w["at"] >> 20, w["at"] >> 10 & 1023, w["at"] & 1023
                    out.append((w["ah"], w["extents"], w["open"], uid, p, m, d, raw[p : p + m - 1 + length]))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["ah", "extents", "open", "uid", "place", "n", "off", "body"])

    extents = C.stage(texts.mapInArrow(cut, "ah long, extents long, open boolean, uid long, place long, n long, off long, body binary"), "suffix-extents")

    def blocks(batches):
        def settle(block):
            twice = sort_block([(x[0], x[5], x[4], x[6]) for x in block], length)
            at = 0
            for _, is_open, uid, p, m, _, _ in block:
                if is_open:
                    out.extend((uid, s, e) for s, e in _intervals(twice[at : at + m], p, length))
                at += m

        block, held = [], 0
        for b in batches:
            out = []
            for x in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if held > BLOCK_BYTES and x[0] != block[-1][0]:
                    settle(block)
                    block, held = [], 0
                block.append(x)
                held += len(x[6])
            yield spans_of(out)
        out = []
        if block:
            settle(block)
        yield spans_of(out)

    def spans_of(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "begin", "end"])

    rows = ["ah", "open", "uid", "place", "n", "off", "body"]
    narrow = extents.filter(F.col("extents") <= max_extents).select(rows)
    wide, case_2b = extents.filter(F.col("extents") > max_extents), None
    if not wide.isEmpty():
        ready, case_2b = _split_wide(wide, length, max_extents)
        if ready is not None:
            narrow = narrow.unionByName(ready)
    case_3 = narrow.repartition(parts, "ah").sortWithinPartitions("ah").mapInArrow(blocks, "uid long, begin long, end long").select("uid", F.struct("begin", "end").alias("span"))
    spans = case_2.unionByName(case_3) if case_2b is None else case_2.unionByName(case_3).unionByName(case_2b)
    # Staged, so that rows that are equal can be split where they are joined.
    return C.stage(spans.join(of, "uid").groupBy("k1", "k2").agg(F.collect_list("span").alias("spans")), "suffix-spans")


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, keep: list[str] | None = None, outputs: bool = True, **options) -> DataFrame:
    """docs' columns (or those of `keep`) with n_bytes, n_removed, n_spans, kept_sha256 and, as outputs, removed (byte spans) and kept (the bytes left)."""
    made = MADE if outputs else MADE[:4]
    keep = C.others(docs, made) if keep is None else keep
    key = C.row_key(docs, doc_id, text)
    spans = find_spans(docs, text=text, doc_id=doc_id, length=length, **options)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), key[0].alias("k1"), key[1].alias("k2"), F.col(f"`{text}`").alias("text"))
    spans = spans.withColumnsRenamed({"k1": "s1", "k2": "s2"})
    joined = C.pack_text(own, "text").join(C.hashed_side(spans), (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("row", "__body", "spans")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    types = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), span, T.BinaryType()]
    schema = T.StructType([joined.schema["row"], *(T.StructField(n, t) for n, t in zip(made, types, strict=False))])

    def step(batches):
        for b in batches:
            rows = []
            for raw, found in zip(C.unpack(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted((s["begin"], s["end"]) for s in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                left, at = [], 0
                for s, e in merged:
                    left.append(raw[at:s])
                    at = e
                left = b"".join([*left, raw[at:]])
                rows.append((len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), [{"begin": s, "end": e} for s, e in merged], left)[: len(made)])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=schema.names)

    found = joined.mapInArrow(step, schema)
    return found.select(*[F.col(f"row.`{c}`") for c in keep], *made)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], outputs=False)


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE = r"""
with d as (select doc_id, row_number() over () as rid, hex(encode(coalesce(text, ''))) as b from documents),
c as (select rid, k * 500 as off, substr(b, 1000 * k + 1, 1398) as b from (select rid, b, unnest(range(0, (length(b) // 2 - 200) // 500 + 1)) as k from d where length(b) >= 400)),
p as (select rid, off + i as i, md5(substr(b, 2 * i - 1, 400)) as h from (select rid, off, b, unnest(range(1, least(500, length(b) // 2 - 199) + 1)) as i from c)),
k as (select h from p group by h having count(*) > 1),
x as (select rid, i, coalesce(max(i + 200) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as before from p where h in (select h from k)),
g as (select rid, i, sum(case when i > before then 1 else 0 end) over (partition by rid order by i) as run from x),
m as (select rid, run, min(i) as a, max(i) + 200 as z from g group by rid, run),
o as (select rid, list(struct_pack(a := a, z := z) order by a) as runs, count(*) as n_spans, sum(z - a) as n_removed from m group by rid)
select doc_id, length(b) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(case when runs is null then b else array_to_string(list_transform(range(1, len(runs) + 2), lambda k: substr(b, 2 * (case when k = 1 then 1 else runs[k - 1].z end) - 1, 2 * ((case when k > len(runs) then length(b) // 2 + 1 else runs[k].a end) - (case when k = 1 then 1 else runs[k - 1].z end)))), '') end)) as kept_sha256
from d left join o using (rid)
"""
ORACLES: dict[str, str] = {"op3_suffix_dedup": ORACLE}
