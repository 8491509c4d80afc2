"""N-gram Jaccard join by MinHash banding: bands found for a target recall, shuffled on band hashes, verified on full sets.

A document is the set of its 5-word shingles (1 to 4 words: one shingle; no words: no set, never linked). Two documents are
linked if the Jaccard similarity of their sets is at least the threshold. Documents of equal sets are one class, stood for by
one of them, by a hash of 128 bits. Rows per band and the number of bands are chosen so that a pair at the threshold shares a band with the target
recall; every pair that shares a band is verified on the whole sets, so no pair below the threshold is linked.

Defined cases: a null or wordless text has no links and is its own group; exact copies are linked with one another; a null
doc_id is kept, and a group whose ids are all null has a null id; repeated rows are copies; an empty table gives none; result
columns replace input columns of the same name.

very long texts are sets like any other.

Scale: no pair is emitted. Documents of one set are one class before anything else, so a text with very many copies counts once.
In each band bucket every class is tied to the bucket's least class (aggregated before the shuffle, so a bucket may be of
any size); of these ties each class keeps one, as `stars` tells, and connected components are clusters. What is verified are the pairs that share a band, each once. A
cluster of bounded size is one block; a larger one is split into blocks by each class's largest bucket, and only two blocks that
meet in a band bucket are brought together, so the work follows the candidate pairs and not the cluster's square. A step holds
two blocks of bounded numbers of classes and shingles; it counts common shingles by matrix products and returns one row a class:
its links, and its component within the step. Text is read twice: once for hashes, and once, shuffled by a content key, for the
sets of classes that have candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import _common as C

THRESHOLD = 0.8
N_WORDS = 5
RECALL = 0.9999
MAX_HASHES = 400
#: Classes and shingles of a block: a larger group is dealt into about MANY blocks, of MOST classes at most.
BLOCK, MANY, MOST = 64, 32, 1024
BLOCK_GRAMS = 1 << 19
MADE = ["class_id", "n_links"]


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall at the threshold within that many hashes."""
    best = (most, 1)
    for rows in range(1, 65):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return hashes, rows
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    return h[new], r[new]


def _signed(data: np.ndarray, offs: np.ndarray, n_words: int, bands: int, rows_each: int, seeds: np.ndarray):
    """Per row with a set: its number, two hashes of the set, the set's size and a hash for each band."""
    h, r = _distinct(*C.shingles(C.LOWER[data], offs, n_words))
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, bands), np.uint64)
    head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(head, len(r)))
    whole = [C.mix(np.add.reduceat(C.mix(h ^ np.uint64(salt)), head) + size.astype(np.uint64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(head), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(head), np.uint64(b + 1), np.uint64)
        for k in range(rows_each):
            a, c = seeds[b * rows_each + k]
            low = np.minimum.reduceat((x ^ c) * a, head)
            key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64))
        out[:, b] = key
    return r[head], *whole, size, out


def hashed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_words: int = N_WORDS, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, c1, c2, size, bands): c1 and c2 name the class of the document's set, null where it has none."""
    k1, k2 = C.row_key(docs, doc_id, text)
    seeds = np.random.default_rng(C.SEED).integers(1, 2**32, (bands * rows, 2), dtype=np.uint64).astype(np.uint32)
    seeds[:, 0] |= 1
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def step(batches):
        for b in batches:
            data, offs = C.buffers(b.column(3))
            n = b.num_rows
            own, has, keys = np.zeros((3, n), np.int64), np.zeros(n, bool), np.zeros((n, bands), np.int64)
            for lo, hi in C.chunks(offs):
                r, c1, c2, size, found = _signed(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n_words, bands, rows, seeds)
                own[:, lo + r], has[lo + r], keys[lo + r] = (c1.view(np.int64), c2.view(np.int64), size), True, found.view(np.int64)
            width = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, mask=~has) for x in own), pa.ListArray.from_arrays(width, pa.array(keys[has].ravel()))], names=["doc_id", "k1", "k2", "c1", "c2", "size", "bands"])

    return source.mapInArrow(step, f"doc_id {id_type}, k1 long, k2 long, c1 long, c2 long, size long, bands array<long>")


def stars(edges: DataFrame) -> DataFrame:
    """Edges of the same components, of (a, b) edges with a bounded number of b for each a, none above it.

    Each a keeps the edge to the least of its b alone, and that one takes the others: members of a group have these in common, so a group
    has about one edge a member in place of one a member and band. An a without another b has no edge.
    """
    met = edges.groupBy("a").agg(F.collect_set("b").alias("all")).withColumn("b", F.array_min("all"))
    return met.select(F.explode(F.array_union("all", F.array("a"))).alias("a"), "b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of (a, b) edges the least vertex it is connected with."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = C.stage(both.unionByName(both.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = C.stage(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        # One step along the edges, then along the labels: a path of labels halves.
        jumped = near.join(labels.withColumnsRenamed({"v": "near", "label": "far"}), "near").join(labels.withColumnsRenamed({"v": "a", "label": "old"}), "a").select(F.col("a").alias("v"), F.least("near", "far").alias("label"), "old")
        jumped = C.stage(jumped, "labels")
        labels = jumped.select("v", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels


def _verify(members: dict[int, tuple[int, int, np.ndarray, np.ndarray]], cross: bool, threshold: float) -> list[tuple[int, int, int]]:
    """members: cid -> (block, documents, bands, set). (cid, linked documents, least cid it is connected with here), if linked."""
    cids = sorted(members)
    m = len(cids)
    if m < 2:
        return []
    block, docs, bands, sets = zip(*(members[c] for c in cids), strict=True)
    block, docs, bands, size = np.array(block), np.array(docs), np.stack(bands), np.array([len(s) for s in sets])
    # Candidates are the pairs that share a band and whose sizes allow the similarity.
    wanted = np.zeros((m, m), bool)
    for k in range(bands.shape[1]):
        wanted |= bands[:, k][:, None] == bands[:, k][None, :]
    wanted &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    np.fill_diagonal(wanted, False)
    if cross:
        wanted &= block[:, None] != block[None, :]
    some = np.flatnonzero(wanted.any(axis=1))
    if not len(some):
        return []
    cids, sets, docs, size, wanted, m = [cids[k] for k in some], [sets[k] for k in some], docs[some], size[some], wanted[np.ix_(some, some)], len(some)
    h, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], col[shared]
    if not len(col):
        return []
    col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)]))
    common, wide = np.zeros((m, m), np.float32), max(256, (1 << 21) // m)
    for c in range(0, int(col[-1]) + 1, wide):
        a, b = np.searchsorted(col, [c, c + wide])
        grid = np.zeros((m, min(wide, int(col[-1]) + 1 - c)), np.float32)
        grid[owner[a:b], col[a:b] - c] = 1
        common += grid @ grid.T
    inter = common.astype(np.float64)
    linked = wanted & (inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9)
    label = np.arange(m)
    while True:
        near = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
        if (near == label).all():
            break
        label = near
    links = linked @ docs
    return [(cids[k], int(links[k]), cids[label[k]]) for k in np.flatnonzero(links)]


def _blocks(classes: DataFrame, clusters: DataFrame, block: int, many: int, most: int, grams: int) -> DataFrame:
    """(cid, block, cluster, steps, wide): a class's block, and the pairs of blocks (i, j) it is brought into."""
    members = classes.select("cid", "size", "bands").join(clusters.withColumnsRenamed({"v": "cid", "label": "cluster"}), "cid")
    sizes = C.stage(members.groupBy("cluster").agg((F.count("*") <= block) & (F.sum("size") <= grams)).toDF("of", "small"), "near-clusters")
    members = C.stage(members.join(sizes, F.col("cluster") == F.col("of")).drop("of"), "near-members")
    alone = members.filter("small").select("cid", F.col("cluster").alias("block"), F.array(F.struct(F.col("cluster").alias("i"), F.col("cluster").alias("j"))).alias("steps"), F.lit(False).alias("wide"))
    large = members.filter("not small")
    if large.isEmpty():
        return alone
    banded = C.stage(large.select("cid", "size", F.explode("bands").alias("band")), "near-bands")
    buckets = banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    banded = C.stage(banded.join(buckets, "band"), "near-buckets")
    homes = C.stage(banded.groupBy("cid").agg(F.max(F.struct("k", "band")).alias("home"), F.max("size").alias("size")).select("cid", "size", "home.band"), "near-homes")
    each = F.least(F.lit(most), F.greatest(F.lit(block), F.ceil(F.col("n") / F.lit(many))))
    parts = homes.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("w")).select("band", F.greatest(F.ceil(F.col("n") / each), F.ceil(F.col("w") / F.lit(grams))).alias("parts"))
    dealt = C.stage(homes.join(parts, "band").select("cid", F.xxhash64("band", F.pmod(F.xxhash64("cid"), "parts")).alias("block")), "near-dealt")
    meeting = C.stage(banded.select("cid", "band").join(dealt, "cid").select("band", "block").distinct(), "near-meeting")
    pairs = meeting.select("band", F.col("block").alias("i")).join(meeting.select("band", F.col("block").alias("j")), "band").filter("i <= j").select("i", "j").distinct()
    both = pairs.withColumn("block", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j")))).groupBy("block").agg(F.collect_list(F.struct("i", "j")).alias("steps"))
    return alone.unionByName(dealt.join(both, "block").select("cid", "block", "steps", F.lit(True).alias("wide")))


def _verified(wanted: DataFrame, docs: DataFrame, text: str, doc_id: str, n_words: int, threshold: float) -> DataFrame:
    """wanted: (cid, block, steps, wide, docs, bands, k1, k2). (cid, links, root, wide) of each step that links it."""
    k1, k2 = C.row_key(docs, doc_id, text)
    wanted = C.stage(wanted.withColumnsRenamed({"k1": "w1", "k2": "w2"}), "near-wanted")
    same_row = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    own = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text"))
    # Where the keys of candidates are few enough, texts of others are left out before anything is packed or moved.
    if wanted.count() * 16 <= C.MOST_KEYS:
        own = own.join(F.broadcast(wanted.select("w1", "w2")), same_row, "left_semi")
    texts = C.pack_text(own, "text", most=500).join(C.hashed_side(wanted), same_row).select("cid", "block", "docs", "wide", "bands", "steps", "__body")
    kept = "cid long, block long, docs long, wide boolean, bands array<long>, steps array<struct<i: long, j: long>>"

    def sets(batches):
        def shingled(bodies: list[bytes]) -> list[bytes]:
            data, offs, out = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]), []
            for lo, hi in C.chunks(offs):
                h, r = _distinct(*C.shingles(C.LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], n_words))
                ends = np.searchsorted(r, np.arange(hi - lo + 1))
                out += [h[ends[k] : ends[k + 1]].tobytes() for k in range(hi - lo)]
            return out

        def told(b, lo, bodies):
            part = b.slice(lo, len(bodies))
            return pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(shingled(bodies), pa.binary())], names=["cid", "block", "docs", "wide", "bands", "steps", "grams"])

        # Handed on as soon as a step is full, so neither side holds the sets of a whole batch.
        for b in batches:
            lo, held, size = 0, [], 0
            for packed in b.column(6):
                held += C.unpack([packed.as_py()])
                size += len(held[-1])
                if size >= C.CHUNK_BYTES:
                    yield told(b, lo, held)
                    lo, held, size = lo + len(held), [], 0
            if held:
                yield told(b, lo, held)

    def verify(batches):
        key, members = None, {}
        for b in batches:
            found = []
            cols = [b.column(k).to_pylist() for k in range(6)]
            bands, grams = b.column(6), b.column(7)
            for k, (i, j, wide, block, cid, n) in enumerate(zip(*cols, strict=True)):
                if (i, j, wide) != key:
                    if key:
                        found += [(*x, key[2]) for x in _verify(members, key[0] != key[1], threshold)]
                    key, members = (i, j, wide), {}
                # A row that repeats, as its text does, is the same member.
                members[cid] = (block, n, bands[k].values.to_numpy(), np.frombuffer(grams[k].as_py(), np.uint64))
            yield out(found)
        if key:
            yield out([(*x, key[2]) for x in _verify(members, key[0] != key[1], threshold)])

    def out(rows):
        x = np.array(rows, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)), pa.array(x[:, 3] > 0)], names=["cid", "links", "root", "wide"])

    found = texts.mapInArrow(sets, f"{kept}, grams binary").withColumn("step", F.explode("steps"))
    found = found.select("step.i", "step.j", "wide", "block", "cid", "docs", "bands", "grams")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "wide").mapInArrow(verify, "cid long, links long, root long, wide boolean")


def link(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_words: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK, many: int = MANY, most: int = MOST, block_grams: int = BLOCK_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row a document (doc_id, k1, k2, c1, c2), and one of each class of a set: (c1, c2, cid, docs, links, component, first).

    links counts documents outside the class; component is the least cid that a chain of links reaches; first is its first
    document, as (null id, doc_id, k1, k2).
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    slim = C.stage(hashed(docs, text=text, doc_id=doc_id, n_words=n_words, bands=bands, rows=rows), "near-hashes")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    classes = slim.filter("c1 is not null").groupBy("c1", "c2").agg(F.count("*").alias("docs"), F.min(first).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # Numbered once, in a table that is written: the numbers stay.
    classes = C.stage(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    banded = classes.select("cid", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least < most").select("band", "least")
    clusters = components(stars(banded.join(least, "band").select(F.col("cid").alias("a"), F.col("least").alias("b"))))
    steps = _blocks(classes, clusters, block, many, most, block_grams)
    wanted = steps.join(classes.select("cid", "docs", "bands", "first.k1", "first.k2"), "cid")
    found = C.stage(_verified(wanted, docs, text, doc_id, n_words, threshold), "near-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    wide = found.filter("wide")
    if not wide.isEmpty():
        joined = components(stars(wide.select(F.col("cid").alias("a"), F.col("root").alias("b")))).withColumnsRenamed({"v": "cid", "label": "whole"})
        links = links.join(joined, "cid", "left").withColumn("root", F.coalesce("whole", "root"))
    classes = classes.drop("bands").join(links, "cid", "left")
    return slim.drop("size", "bands"), classes.select("c1", "c2", "cid", "docs", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("component"), "first")


def join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id that chains of links reach) and n_links (documents linked with it)."""
    slim, classes = link(docs, text=text, doc_id=doc_id, **options)
    classes = C.stage(classes.filter("docs > 1 or links > 0"), "near-groups")
    groups = classes.groupBy("component").agg(F.min("first.doc_id").alias("class_id"))
    # Staged, so that a class of very many copies can be split where it is joined.
    told = C.stage(classes.join(groups, "component").select("c1", "c2", "class_id", (F.col("links") + F.col("docs") - 1).alias("n_links")), "near-told")
    return slim.join(told, ["c1", "c2"], "left").select(F.col("doc_id").alias(doc_id), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each group of near copies, that of the least doc_id; columns as they are."""
    slim, classes = link(docs, text=text, doc_id=doc_id, **options)
    classes = C.stage(classes.filter("docs > 1 or links > 0").select("c1", "c2", "component", "first"), "near-groups")
    firsts = classes.groupBy("component").agg(F.min("first").alias("stays"))
    groups = C.stage(classes.join(firsts, "component").select("c1", "c2", F.col("stays.k1").alias("s1"), F.col("stays.k2").alias("s2")), "near-firsts")
    stays = (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    told = C.stage(slim.join(groups, ["c1", "c2"]).groupBy(F.col("k1").alias("t1"), F.col("k2").alias("t2"), stays.alias("stays")).agg(F.count("*").alias("same")).filter("not stays or same > 1"), "near-told")
    k1, k2 = C.row_key(docs, doc_id, text)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    same_row = (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    once = own.join(C.hashed_side(told), same_row, "left_anti").select("row.*")
    twice = told.filter("stays and same > 1")
    if twice.isEmpty():
        return once
    # Rows that equal one another in id and text: the least by all their columns stays; one a task is left before the shuffle.
    one = own.join(twice, same_row).groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.unionByName(one.select("row.*"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
#: Brute force over shared shingles, for tables whose doc_id is a key.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(v, u) as (select a, a from e union select r.v, e.b from r join e on r.u = e.a)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0) as n_links from documents
left join (select v as doc_id, min(u) as class_id from r group by v) using (doc_id) left join (select a as doc_id, count(*) as n_links from e group by a) using (doc_id)
"""
ORACLES: dict[str, str] = {"op8_ngram_jaccard": ORACLE}
