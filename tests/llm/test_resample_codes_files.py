"""Importance resampling, vector codes and token files against brute force, round trips, and the defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import importance, token_files, vector_codes

DOCS = "doc_id long, text string, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéB") for _ in range(rng.randrange(1, 5)))
    out = [" ".join(word() for _ in range(rng.choice([0, 3, 19, 20, 21, 60]))) for _ in range(80)]
    out += [None, "", "\x00\x01", "Don't STOP, İ! don't", "日本語 テキスト　と é", "x" * 5000, " ".join(word() for _ in range(9000)), out[4], "a\tb\nc\r\nd <|endoftext|> e\x1cf"]
    rows = [(k, t, "mine") for k, t in enumerate(out)]
    return rows + [rows[2], rows[3], rows[3], (None, "a null id " * 12, "mine"), (None, None, None)]


ROWS = texts()
TARGET = [(0, "ab ab cab dé"), (1, None), (2, "bad cab ab " * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id long, text string")


# --- importance


def brute_importance(rows, target, least, most, buckets, percent=10, min_words=20):
    def cells(text):
        w = WORD.findall((text or "").translate(UPPER))
        grams = [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for r in rows:
        np.add.at(s, cells(r[1])[1], 1)
    for r in target:
        np.add.at(t, cells(r[1])[1], 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text, *_ in rows:
        n_words, own = cells(text)
        weight = sum(gain[c] for c in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    fit = sorted((o for o in out if o[4] >= min_words), key=lambda o: (-o[3], -1 if o[0] is None else o[0]))
    return out, fit[: len(fit) * percent // 100]


@pytest.mark.parametrize("least,most,buckets,percent", [(1, 1, 10_000, 10), (1, 3, 97, 50), (2, 2, 1000, 100), (1, 1, 50, 0)])
def test_importance_against_brute_force(spark, docs, target, least, most, buckets, percent):
    got = importance.resample(docs, target, keep=["doc_id"], least=least, most=most, buckets=buckets, percent=percent).collect()
    want, drawn = brute_importance(ROWS, TARGET, least, most, buckets, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key(r[:4]) for r in got)) == sorted(key(r[:4]) for r in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(d[0], d[3]) for d in drawn]


def test_importance_pieces_and_columns(spark, docs, target):
    named = docs.withColumnsRenamed({"doc_id": "score"}).withColumn("weight", F.lit("w"))
    found = importance.resample(named, target, doc_id="score", keep=["rank", "text"])
    assert found.columns == ["text", "n_features", "weight", "score", "rank"] and found.count() == len(ROWS)
    drawn = importance.draw(docs.withColumn("own", F.lit(1)), target, percent=100)
    assert drawn.columns == ["doc_id", "text", "own"] and drawn.count() == len(brute_importance(ROWS, TARGET, 1, 1, 10, 100)[1])
    whole, cut = (importance.bucket_counts(docs, ["doc_id"], least=1, most=3, step_bytes=n).filter("own is not null").select("own.doc_id", "n_words", F.sort_array(F.arrays_zip("buckets", "counts")).alias("c")) for n in (1 << 22, 64))
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_importance_of_equal_rows_and_of_none(spark, docs, target):
    same = spark.createDataFrame([(7, "one two three four five " * 5, None)] * 400, DOCS).repartition(5)
    ranks = [r["rank"] for r in importance.resample(same, target, keep=["doc_id"]).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 41)) and ranks.count(None) == 360
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0), keep=["doc_id"]).count() == len(ROWS)


# --- vector codes


def brute_codes(rows, parts, entries, rounds):
    """Plain Lloyd's rounds: (code, error) by row, and the codebooks."""
    keep = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in keep], dtype=np.int64).reshape(len(keep), parts, -1)
    books = x[:entries].copy().transpose(1, 0, 2)
    assign = lambda p: ((x[:, p, None, :] - books[p]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            at = assign(p).argmin(axis=1)
            for k in range(books.shape[1]):
                if (at == k).any():
                    books[p, k] = x[at == k, p].sum(axis=0) // (at == k).sum()
    d = [assign(p) for p in range(parts)]
    codes = np.stack([v.argmin(axis=1) for v in d], axis=1)
    return [(r[0], r[2], bytes(c.tolist()).hex(), int(sum(d[p][i, c[p]] for p in range(parts)))) for i, (r, c) in enumerate(zip(keep, codes, strict=True))], books


def vectors(n=700, d=8, seed=3, scale=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    rows = [(k, [float(np.float32(v)) for v in centres[k % 30] + scale * rng.normal(size=d)], [None, "a", "b"][k % 3]) for k in range(n)]
    rows += [(n + k, rows[5][1], "c") for k in range(200)]  # a group of copies
    return rows + [rows[9], rows[9], (None, rows[1][1], None), (n + 900, None, "a"), (n + 901, [1.0] * (d - 1) + [None], "a"), (n + 902, [float("nan")] * d, "a"), (n + 903, [float("inf")] + [0.0] * (d - 1), None)]


SCHEMA = "vec_id long, embedding array<float>, label string"


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 2), (8, 5, 6), (1, 64, 3), (2, 1, 2), (4, 256, 1), (4, 16, 0)])
def test_codes_against_plain_rounds(spark, parts, entries, rounds):
    rows = vectors()
    found = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, books = brute_codes(rows, parts, entries, rounds)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert (found.books.entries == books).all()
    assert sorted(map(key, found.codes.collect())) == sorted(map(key, want))


def test_only_violated_parts_are_scanned(spark):
    rows = vectors(n=3000)
    found = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(2), parts=4, entries=30, rounds=8)
    assert found.scanned[0] == 4 * (len(rows) - 4)
    assert found.scanned[-1] < found.scanned[0] / 2 and all(n <= found.scanned[0] for n in found.scanned)


def test_heaps_pop_and_push():
    h = vector_codes.Heaps(3)
    h.push(np.array([0, 2, 0, 2]), np.array([5.0, 1.0, 3.0, 1.0]), np.arange(4, dtype=np.uint16))
    at, rows = h.pop(np.array([3.0, 9.0, 0.5]))
    assert (at.tolist(), rows.tolist()) == ([0], [2])
    h.push(np.array([1]), np.array([7.0]), np.array([2], np.uint16))
    again = vector_codes.Heaps.load(*h.dump())
    assert [k.tolist() for k in again.keys] == [[5.0], [7.0], [1.0, 1.0]] and again.codes(4).tolist() == [0, 2, 1, 2]
    assert again.pop(np.zeros(3) - 1)[0].size == 0


def test_large_components_are_exact_or_an_error(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.integers(-(2**18), 2**18, 4)], "a") for k in range(50)]
    found = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), parts=2, entries=8)
    assert sorted(tuple(r) for r in found.codes.select("vec_id", "code", "error").collect()) == sorted((r[0], r[2], r[3]) for r in brute_codes(rows, 2, 8, 2)[0])
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30, 0.0], "a")], "vec_id long, embedding array<double>, label string"), parts=2)


def test_code_edges(spark):
    none = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.codes.count() == 0 and none.codes.columns == ["vec_id", "label", "code", "error"]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a")], SCHEMA), parts=2)
    with pytest.raises(Exception, match="length"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0], "a")], SCHEMA).coalesce(1), parts=2).codes.count()
    clash = spark.createDataFrame([(k, [k / 8, 1.0], "a", k) for k in range(6)], "x long, cells array<float>, ids string, code long")
    found = vector_codes.compress(clash, vec_id="x", embedding="cells", label="ids", parts=2, entries=6)
    back = vector_codes.reconstruct(found.codes, found.books).orderBy("vec_id").collect()
    assert [round(r["embedding"][0] * 8) for r in back] == list(range(6)) and all(r["error"] == 0 for r in back)


# --- token files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


def test_packing_round_trips():
    rng = np.random.default_rng(2)
    for bits in range(1, 33):
        for n in (0, 1, 31, 32, 33, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            body = token_files.pack(ids, bits)
            assert len(body) == 4 * bits * -(-n // 32) and (token_files.unpack(body, bits, n) == ids).all()
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_words_apart_equal_whole_texts():
    encoder, plain, rng = token_files.Encoder(token_files.tokenizer_path()), library(), random.Random(4)
    bits = ["a", "Be", "é", "É", "Σ", "ς", "İ", "'s", "'", "n't", ".", ",", "!", "?!", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "́", "ë", "<|endoftext|>", "<|", "9", "日本", "‍", "😀", "ﬁ", "\x00", "Å", "ß", "ª", "ᵃ", "_", "the", "\r\n"]
    assert encoder.by_word
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 20)))
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    long = " ".join(rng.choice(bits) for _ in range(400_000))
    assert np.frombuffer(encoder.encode(long), encoder.dtype).tolist() == plain.encode(long, add_special_tokens=False).ids
    other = token_files.Encoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_word and np.frombuffer(other.encode("a b"), other.dtype).tolist() == other.tokenizer.encode("a b", add_special_tokens=False).ids


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("options", [{}, {"block": 32, "file_ids": 500, "file_docs": 7}])
def test_files_against_the_library(spark, docs, tmp_path, options):
    plain = library()
    folder = f"file://{tmp_path}/tokens"
    held = token_files.write_tokens(docs, folder, **options)
    got = sorted((r.start, r.doc_id, list(r.ids)) for r in token_files.read_tokens(spark, folder, docs.schema["doc_id"].dataType).collect())
    digests = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, folder, docs.schema["doc_id"].dataType).collect())
    encode = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 2]
    assert [g[1] for g in got] == [r[0] for r in in_order(ROWS)]
    assert sorted((str(g[1]), g[2]) for g in got) == sorted((str(r[0]), encode(r[1])) for r in ROWS)
    assert [g[0] for g in got] == list(np.cumsum([0, *[len(g[2]) for g in got]])[:-1])
    assert digests == [(s, d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, d, i in got]
    names = [r["name"] for r in held.orderBy("part", "k").collect()]
    if options:
        assert len(names) > 8
    at = 0
    for name in names:  # random access in a file
        f = token_files.TokenFile(f"{folder}/files/{name}")
        for k in range(f.n_docs):
            assert f.document(k).tolist() == got[at][2]
            at += 1
        everything = [i for g in got[at - f.n_docs : at] for i in g[2]]
        for lo, hi in ((0, f.n_ids), (5, 6), (f.n_ids - 1, f.n_ids + 9), (31, 65), (4, 4)):
            assert f.ids(lo, hi).tolist() == everything[lo:hi]
        f.close()
    assert at == len(ROWS)


def test_stray_and_damaged_files(spark, docs, tmp_path):
    folder = f"{tmp_path}/tokens"
    token_files.write_tokens(docs.limit(5), folder)
    stray = tmp_path / "tokens" / "files" / "000000-0000-lost.tok"
    stray.write_bytes(b"half a file")
    assert token_files.read_digests(spark, folder, docs.schema["doc_id"].dataType).count() == 5
    with pytest.raises(ValueError, match="no token file"):
        token_files.TokenFile(f"file://{stray}")
    assert token_files.sweep(spark, folder) == 1 and not stray.exists()
    one = next((tmp_path / "tokens" / "files").glob("*.tok"))
    body = bytearray(one.read_bytes())
    body[-token_files.TAIL.size - 3] ^= 1
    one.write_bytes(body)
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(f"file://{one}")


def test_files_of_odd_tables(spark, docs, tmp_path):
    kind = docs.schema["doc_id"].dataType
    token_files.write_tokens(docs.limit(0), f"{tmp_path}/none")
    assert token_files.read_digests(spark, f"{tmp_path}/none", kind).count() == 0
    same = spark.createDataFrame([(7, "one two", None)] * 3000, DOCS).repartition(4)
    token_files.write_tokens(same, f"{tmp_path}/same")
    got = token_files.read_digests(spark, f"{tmp_path}/same", kind)
    assert got.select("start").distinct().count() == 3000 and got.agg(F.max("start")).first()[0] == 2999 * 3
    named = docs.select(F.col("doc_id").cast("string").alias("h"), F.col("text").alias("place"), F.lit(1).alias("__body"))
    token_files.write_tokens(named, f"{tmp_path}/named", text="place", doc_id="h")
    assert token_files.read_digests(spark, f"{tmp_path}/named", named.schema["h"].dataType).count() == len(ROWS)
    with pytest.raises(ValueError, match="multiple"):
        token_files.write_tokens(docs, f"{tmp_path}/bad", block=33)
