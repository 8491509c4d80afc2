"""Operators against computations of another kind: page texts by the standard parser, quality features one text at a time, finders, mixes."""

from __future__ import annotations

import collections
import html.parser
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import html_text, mixing, pii, quality
from tests.oracle import SF_DIR

# --- op5: pages whose article is marked, by the standard library's parser


class Article(html.parser.HTMLParser):
    """The words of the blocks inside <article>, block by block; a paragraph that is not closed ends where the next begins."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "div", "section", "table", "tr"}
    OUT = {"script", "style", "form", "aside", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.out = 0
        self.blocks = [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out += tag in self.OUT
        if tag in self.BLOCKS:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out -= tag in self.OUT
        if tag in self.BLOCKS or tag == "article":
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside > 0 and self.out <= 0:
            self.blocks[-1] += data.split()


def test_marked_pages_by_another_parser(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver's tables are not here")
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    sources = {r.page_id: r.html or "" for r in pages.collect()}
    found = html_text.op5_html_extraction(spark, SF_DIR).collect()
    assert len(found) == len(sources)
    right = 0
    for r in found:
        parser = Article()
        parser.feed(sources[r.page_id])
        parser.close()
        want = [" ".join(b) for b in parser.blocks if b]
        right += r.text == "\n".join(want)
        assert r.n_chars == len(r.text)
    assert right >= 0.98 * len(found), f"{right} of {len(found)}"


# --- op10: features of one text, in plain Python


def plain_features(text: str) -> dict[str, float]:
    data = text.encode()
    n = max(1, len(data))
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    sizes, w = [len(x) for x in words], max(1, len(words))
    counts = collections.Counter(words)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    lines = [x + b"\n" for x in data.split(b"\n")[:-1]] + ([data.rsplit(b"\n", 1)[-1]] if data and not data.endswith(b"\n") else [])
    histogram = collections.Counter(data)
    mean = sum(sizes) / w
    out = {name: sum(histogram[b] for b in set(group)) / n for name, group in quality.SHARES.items()}
    return out | {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "word_bytes": mean, "word_bytes_sd": math.sqrt(max(0, sum(s * s for s in sizes) / w - mean**2)),
        "short_words": sum(s <= 3 for s in sizes) / w, "long_words": sum(s > 12 for s in sizes) / w, "types": len(counts) / w, "top_word": max(counts.values(), default=0) / w,
        "shingle_repeats": 1 - len(set(grams)) / max(1, len(grams)), "log_lines": math.log1p(len(lines)), "line_bytes": math.log1p(len(data) / max(1, len(lines))), "line_repeats": 1 - len(set(lines)) / max(1, len(lines)),
        "entropy": -sum(c / n * math.log2(c / n) for c in histogram.values()), "top_byte": max(histogram.values(), default=0) / n, "word_share": sum(sizes) / n,
    }


def test_features_one_text_at_a_time():
    rng = random.Random(5)
    bits = ["word", "Word", "a", "longerthantwelve", "é", "日本", " ", "  ", "\n", "\n\n", "\t", ".", ",", "|", "!?", "12", "\x00", "<b>", "-_", "same line\n", "'\""]
    texts = ["", "\n", "a", "a\n", "\n\nx", "é" * 40, "x y z x y z x y z"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 200))) for _ in range(150)] + [" ".join(rng.choice(bits) for _ in range(200_000))]
    got = quality.features(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        want = plain_features(text)
        assert set(want) == set(quality.FEATURES)
        np.testing.assert_allclose(row, [want[f] for f in quality.FEATURES], rtol=1e-7, atol=2e-7, err_msg=repr(text[:80]))


# --- op1: what is taken, with a long document in each source


def test_mix_takes_its_targets(spark):
    rng = random.Random(8)
    rows = []
    for source, n in (("a", 900), ("b", 400), (None, 60)):
        rows += [(len(rows) + k, "w " * rng.choice([1, 3, 8, 20, 55]), source) for k in range(n)]
        rows.append((len(rows), "w " * 2_000, source))
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    found = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(found) == 3
    for r in found:
        assert abs(r.taken - r.target) <= max(2, 0.002 * r.target) and r.most <= 3, r


# --- op9: telephones, social security numbers and worded dates, by plain patterns


@pytest.mark.parametrize("text,kind,value", [
    ("call +1 212 555 0143 today", "phone", "+1 212 555 0143"), ("Tel. (212) 555-0143.", "phone", "(212) 555-0143"), ("ssn 219-09-9998, ok", "ssn", "219-09-9998"),
    ("born on 5 March 1984 in", "day", "5 March 1984"), ("on March 5, 1984 at", "day", "March 5, 1984"), ("paid 4539 1488 0343 6467 by", "card", "4539 1488 0343 6467"),
])
def test_values_in_words(text, kind, value):
    names = pii.Pseudonyms(b"a key")
    out, found = names.apply(text)
    (begin, end, told, new), = found
    assert text[begin:end] == value and kind in told and out == text[:begin] + new + text[end:]
    assert new != value and re.sub("[0-9A-Za-z]", "", new) == re.sub("[0-9A-Za-z]", "", value)
    assert pii.Pseudonyms(b"a key", back=True).apply(out)[0] == text
    assert names.apply(f"x {text}")[1][0][3] == new


@pytest.mark.parametrize("text", ["000-12-3456", "666-12-3456", "912-34-5678", "219-00-9998", "12.34.5678", "31 February 1984", "February 30, 1984", "version 1.2.3", "room 212 555", "4539 1488 0343 6468"])
def test_what_is_no_value(text):
    assert pii.Pseudonyms(b"a key").apply(f"see {text} there")[1] == []
