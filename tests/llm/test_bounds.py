"""Bounds of memory and keys: languages, hash joins, pseudonyms, hidden elements."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import _common as C
from gradeloom.llm import html_text, language, near_dups, pii

DOCS = "doc_id long, text string"


def model(k: int, seed: int = 1) -> language.Model:
    """A third of the languages is Cyrillic, the others Latin, some Greek as well."""
    rng = np.random.default_rng(seed)
    counts = (rng.integers(0, 50, (k, language.BUCKETS)) * (rng.random((k, language.BUCKETS)) < 0.05)).astype(float)
    scripts = np.zeros((k, len(language.SCRIPTS) + 1))
    names = ["", *language.SCRIPTS]
    for j in range(k):
        scripts[j, names.index("latin" if j % 3 else "cyrillic")] = 100
        scripts[j, names.index("greek")] = 50 * (j % 7 == 0)
    return language.Model([f"l{j:03d}" for j in range(k)], counts, scripts, np.ones(k))


def mixed_texts(n: int) -> list[str | None]:
    rng = random.Random(2)
    letters = ["abcdefgh", "абвгдежз", "αβγδ", "日本語", "12"]
    word = lambda: "".join(rng.choice(letters[rng.choice([0, 0, 1, 1, 2, 3, 4])]) if rng.random() < 0.05 else c for c in rng.choices(letters[rng.choice([0, 0, 1, 1, 2, 3, 4])], k=rng.randrange(1, 9)))
    return [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(n)] + ["", None, "...", "日本", "a" * 5000]


def plain_labels(m: language.Model, text: str) -> list[int]:
    """Viterbi over all languages, those that a word's script rules out included, word by word."""
    w = language.Words([text])
    bucket, word = w.features()
    best, back = None, []
    for k in range(len(w.begin)):
        s = m.odds[bucket[word == k]].sum(axis=0, dtype=np.float64)
        allowed = m.allowed[w.script[k]]
        s = np.where(allowed, s, language.RULED_OUT) if allowed.any() else np.zeros(len(s))
        if best is None:
            best = s
            continue
        top = int(best.argmax())
        stay = best >= best[top] - m.penalty
        back.append(np.where(stay, np.arange(len(s)), top))
        best = np.where(stay, best, best[top] - m.penalty) + s
    out = [int(best.argmax())] if best is not None else []
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


@pytest.mark.parametrize("k,cells", [(1, 1 << 21), (9, 50), (130, 1 << 21)])
def test_candidates_give_the_same_labels_as_all_languages(monkeypatch, k, cells):
    monkeypatch.setattr(language, "CELLS", cells)
    m, texts = model(k), mixed_texts(40)
    w = language.Words(texts)
    label, _ = m.label(w)
    for t, text in enumerate(texts):
        known = m.allowed[w.script[w.text == t]].any(axis=1)
        if known.any():
            assert label[w.text == t].tolist() == plain_labels(m, text or ""), text


def test_memory_does_not_grow_with_languages():
    text = [" ".join(random.Random(3).choices(["alpha", "beta", "gamma", "delta", "eps"], k=60_000))] + ["one two"] * 2000
    peaks = []
    for k in (4, 256):
        m = model(k)
        m.predict(text[-5:])
        tracemalloc.start()
        m.predict(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 200 << 20 and peaks[1] < 2 * peaks[0] + (64 << 20)


def test_sides_are_hashed_by_their_measured_size(spark, monkeypatch):
    side = C.stage(spark.range(1000).select("id", F.array(F.col("id"), F.col("id")).alias("a"), F.lit("xyz").alias("s")))
    assert C.measured(side) == (1000, 1000 * (16 + 8 + 32 + 19))
    joined = lambda: spark.range(9).join(C.hashed_side(side), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_hash" in joined()
    monkeypatch.setattr(C, "MOST_HASHED", 100)
    assert "shuffle_hash" not in joined()


def near_copies(n: int):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(n):
        own = list(base)
        own[rng.randrange(80)] = f"x{k % 50}"
        rows.append((k, " ".join(own)))
    return rows + [(n + k, f"quite other words number {k} " * 5) for k in range(20)]


def test_joins_agree_however_they_are_made(spark, monkeypatch):
    """With keys broadcast and hashed, and with neither."""
    docs = spark.createDataFrame(near_copies(60), DOCS).repartition(3)
    first = sorted(map(tuple, near_dups.join(docs).collect()))
    kept = sorted(r.doc_id for r in near_dups.keep_one(docs).collect())
    monkeypatch.setattr(C, "MOST_HASHED", 0)
    monkeypatch.setattr(C, "MOST_KEYS", 0)
    assert sorted(map(tuple, near_dups.join(docs).collect())) == first
    assert sorted(r.doc_id for r in near_dups.keep_one(docs).collect()) == kept


def test_a_key_is_needed_on_a_cluster(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "write to ann@example.org")], DOCS)
    own, demo = (pii.pseudonymise(docs, key=k, report=False).first().text for k in (b"secret", pii.DEMO_KEY))
    assert own != demo and pii.pseudonymise(docs, report=False).first().text == demo
    spark.conf.set(pii.KEY_SETTING, "secret")
    try:
        assert pii.pseudonymise(docs, report=False).first().text == own
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert corpus_pipeline.pii_stage(spark, docs, "", b"secret").first().text == own

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://far:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="secret key"):
        pii.secret_key(Far)


@pytest.mark.parametrize("style,hidden", [("display:none", True), ("color: red; DISPLAY : none !important;", True), ("visibility:hidden", True), ("text-decoration:none", False), ("list-style: none; margin:0", False), ("x-display:none", False), ("display:nonesuch", False), ("border:none;display:block", False)])
def test_hidden_elements(style, hidden):
    nodes, _ = html_text.parse(f'<html><body><p style="{style}">text</p></body></html>')
    assert any("hidden" in n.parts for n in nodes if n.name == "p") == hidden


def test_a_group_of_near_copies_has_about_an_edge_a_member(spark, monkeypatch):
    rng, n = random.Random(3), 200
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join([*words[: (k := rng.randrange(200))], f"x{i}", *words[k + 1 :]]) for i in range(n)]
    counts, components = [], near_dups.components
    monkeypatch.setattr(near_dups, "components", lambda edges: (counts.append(edges.count()), components(edges))[1])
    got = near_dups.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16, many=4, most=32).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, n - 1)}
    assert len(counts) == 2 and max(counts) <= 3 * n  # 2198 before: one a member and least of a band


def test_stars_connect_what_the_edges_do(spark):
    rng = random.Random(4)
    edges = [(a, rng.randrange(a + 1)) for a in range(1, 400) for _ in range(rng.randrange(3))]
    df = spark.createDataFrame(edges, "a long, b long")
    least = {r.v: r.label for r in near_dups.components(df).collect()}
    got = {r.v: r.label for r in near_dups.components(near_dups.stars(df)).collect()}
    assert {v: label for v, label in least.items() if v in got} == got and all(least[v] == v for v in set(least) - set(got))
