"""Quality classifier: a generalised additive model with pairwise interactions.

Per-feature and per-pair lookup tables are learned by cyclic boosting: in each round every feature in turn gets one shallow
tree on its bins, fitted to the gradient of the log loss, and the tree is added to the feature's table. Pairs are chosen by
the gain of a small tree on what the single features leave over, and boosted in the same way. A score is the sum of table
cells that vectorised binning selects.

Features come from the whole text alone: byte shares, words, lines, repeats. Labels are learned from at most `max_rows`
labelled ids (the smallest by a hash) and of their documents at most `max_rows` different ones (again by a hash), so the sample's
text goes through the executors and only its feature rows, bounded by max_rows x n_features, reach the driver. All documents are scored in one scan without a shuffle.

Defined cases: a null text is an empty text, and an empty text is scored as any other; a very long text is one step of its own;
labels that are null are not learned from, and an id of two different labels is learned from with both; with no labels, or labels of one kind, the
score is the smoothed share of ones; an empty table gives none; repeated rows are each scored, and learned from once; of cuts
that gain the same (ties) the first is taken; columns of other names pass through, a column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import _common as C

THRESHOLD = 0.3
MAX_ROWS = 20_000
#: Groups of bytes whose share of the text is a feature.
SHARES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#$%&*@^~+=", "bar": b"|", "bang": b"!?", "stop": b".;:", "comma": b",", "quote": b"\"'`", "bracket": b"()[]{}<>/\\", "dash": b"-_", "space": b" \t", "newline": b"\n\r", "non_ascii": bytes(range(128, 256)), "control": bytes([*range(9), 11, 12, *range(14, 32), 127])}
FEATURES = [*SHARES, "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "short_words", "long_words", "types", "top_word", "shingle_repeats", "log_lines", "line_bytes", "line_repeats", "entropy", "top_byte", "word_share"]
_MEMBERS = np.zeros((256, len(SHARES)), np.float64)
for _k, _bytes in enumerate(SHARES.values()):
    _MEMBERS[list(_bytes), _k] = 1


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: how many, how many distinct, and the largest count of one."""
    total = np.bincount(rows, minlength=n)
    if not len(rows):
        return total, total.copy(), total.copy()
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    size = np.diff(np.append(head, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[head], size)
    return total, np.bincount(r[head], minlength=n), top


def _chunk_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n, size = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, len(FEATURES)))
    # A long text is a step of its own: no need to spread its row over its bytes.
    histogram = np.bincount(data if n == 1 else np.repeat(np.arange(n) * 256, size) + data, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)
    out[:, : len(SHARES)] = histogram @ _MEMBERS / some[:, None]
    low = C.LOWER[data]
    begin, end, of = C.word_spans(low, offs)
    length = (end - begin).astype(np.float64)
    words = C.span_hashes(low, begin, end)
    total, types, top = _repeats(words, of, n)
    tokens = np.maximum(total, 1)
    mean = np.bincount(of, length, minlength=n) / tokens
    grams = C.gram_hashes(words, 3)
    full = of[: len(grams)] == of[2:] if len(grams) else np.zeros(0, bool)
    runs, distinct, _ = _repeats(grams[full], of[: len(grams)][full], n)
    breaks = np.flatnonzero(data == 10)
    lines_begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    lines_begin = lines_begin[lines_begin < len(data)]
    lines_row = np.searchsorted(offs, lines_begin, "right") - 1
    lines_end = np.append(lines_begin[1:], len(data))[: len(lines_begin)]
    lines, kinds, _ = _repeats(C.span_hashes(data, lines_begin, lines_end), lines_row, n)
    share = histogram / some[:, None]
    values = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(total), "word_bytes": mean,
        "word_bytes_sd": np.sqrt(np.maximum(0, np.bincount(of, length**2, minlength=n) / tokens - mean**2)),
        "short_words": np.bincount(of, length <= 3, minlength=n) / tokens, "long_words": np.bincount(of, length > 12, minlength=n) / tokens,
        "types": types / tokens, "top_word": top / tokens, "shingle_repeats": 1 - distinct / np.maximum(runs, 1),
        "log_lines": np.log1p(lines), "line_bytes": np.log1p(size / np.maximum(lines, 1)), "line_repeats": 1 - kinds / np.maximum(lines, 1),
        "entropy": -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1), "top_byte": share.max(axis=1), "word_share": np.bincount(of, length, minlength=n) / some,
    }
    for name, v in values.items():
        out[:, FEATURES.index(name)] = v
    return out


def features(text: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offs = C.buffers(text)
    parts = [_chunk_features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in C.chunks(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _best_cut(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins in two."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    ga, ha = g.sum(), h.sum()
    gain = a**2 / (b + reg) + (ga - a) ** 2 / (ha - b + reg) - ga**2 / (ha + reg)
    gain[(b < least) | (ha - b < least)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float, least: float) -> np.ndarray:
    """A shallow tree on ordered bins: the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, k = max((*_best_cut(g[a:b], h[a:b], reg, least), k) for k, (a, b) in enumerate(parts))
        if gain <= 0:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + reg)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, reg: float, least: float, depth: int = 2) -> tuple[np.ndarray, float]:
    """A tree of that depth on a grid of bins: the value of each cell, and the gain."""
    cuts = [(*_best_cut(g.sum(axis=1 - axis), h.sum(axis=1 - axis), reg, least), axis) for axis in (0, 1)] if depth else [(0.0, 0, 0)]
    gain, cut, axis = max(cuts)
    if gain <= 0:
        return np.full(g.shape, g.sum() / (h.sum() + reg)), 0.0
    a, b = np.split(np.arange(g.shape[axis]), [cut])
    parts = [_tree2(np.take(g, x, axis), np.take(h, x, axis), reg, least, depth - 1) for x in (a, b)]
    return np.concatenate([p[0] for p in parts], axis), gain + sum(p[1] for p in parts)


class Gam:
    """score = sigmoid(intercept + sum of table[bin] over features + sum of table[bin, bin] over pairs)."""

    def __init__(self, *, bins: int = 32, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.1, n_pairs: int = 8, leaves: int = 3, reg: float = 2.0, least: float = 2.0):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.rate, self.n_pairs, self.leaves, self.reg, self.least = bins, pair_bins, rounds, pair_rounds, rate, n_pairs, leaves, reg, least

    def _cut(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), np.int64) for edges in (self.edges, self.coarse))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n, width = x.shape
        ones = float(y.sum())
        share = (ones + 1) / (n + 2)
        self.intercept, self.pairs = float(np.log(share / (1 - share))), []
        quantiles = lambda k, m: np.unique(np.quantile(x[:, k], np.linspace(0, 1, m + 1)[1:-1])) if n else np.zeros(0)
        self.edges, self.coarse = [quantiles(k, self.bins) for k in range(width)], [quantiles(k, self.pair_bins) for k in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if ones in (0, n):
            return self
        fine, coarse = self._cut(x)
        raw = np.full(n, self.intercept)
        for _ in range(self.rounds):
            for k in range(width):
                p = 1 / (1 + np.exp(-raw))
                m = len(self.tables[k])
                step = self.rate * _tree(np.bincount(fine[:, k], y - p, m), np.bincount(fine[:, k], p * (1 - p), m), self.leaves, self.reg, self.least)
                self.tables[k] += step
                raw += step[fine[:, k]]
        p = 1 / (1 + np.exp(-raw))
        grid = lambda i, j, w: np.bincount(coarse[:, i] * (len(self.coarse[j]) + 1) + coarse[:, j], w, (len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)).reshape(len(self.coarse[i]) + 1, -1)
        gains = [(_tree2(grid(i, j, y - p), grid(i, j, p * (1 - p)), self.reg, self.least)[1], i, j) for i in range(width) for j in range(i)]
        chosen = [(i, j) for gain, i, j in sorted(gains, reverse=True)[: self.n_pairs] if gain > 0]
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for i, j in chosen]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-raw))
                step = self.rate * _tree2(grid(i, j, y - p), grid(i, j, p * (1 - p)), self.reg, self.least)[0]
                table += step
                raw += step[coarse[:, i], coarse[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self._cut(x)
        raw = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            raw += table[fine[:, k]]
        for i, j, table in self.pairs:
            raw += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Learns from labelled rows that are not held out; at most max_rows ids, the same ones in every run."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & (C.bucket_of_id("id") != 0))
    known = known.withColumn("y", (F.col("y") > 0).cast("double")).withColumn("h", F.xxhash64("id"))
    chosen = known.join(F.broadcast(C.least(known.select("h"), max_rows)), "h", "left_semi").select(F.col("id").alias("of"), "y").distinct()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of")).select("y", F.xxhash64("id", "text", "y").alias("h"), "text")

    def step(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features(b.column(2))), pa.list_(pa.float64()))], names=["y", "h", "x"])

    found = C.stage(rows.mapInArrow(step, "y double, h long, x array<double>"), "quality-rows")
    found = found.join(F.broadcast(C.least(found.select("h"), max_rows)), "h", "left_semi").groupBy("h").agg(F.first("y").alias("y"), F.first("x").alias("x")).toPandas()
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    y = (found["y"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((*x.T[::-1], y)) if len(y) else []
    return Gam().fit(x[order], y[order])


def scorer(docs: DataFrame, model: Gam) -> Callable[[Column], Column]:
    """The score of a column of texts. Texts alone go to Python and scores alone come back: rows stay where they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(held.value.score(features(text)), pa.float64())

    return scored


def score(docs: DataFrame, model: Gam, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of `keep`) with score."""
    keep = C.others(docs, ["score"]) if keep is None else keep
    return docs.select(*[F.col(f"`{c}`") for c in keep], scorer(docs, model)(F.col(f"`{text}`")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", **options) -> DataFrame:
    """The documents that score at least the threshold; docs' columns as they are."""
    model = train(docs, labels, text=text, **options)
    return docs.filter(scorer(docs, model)(F.col(f"`{text}`")) >= threshold)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (C.bucket_of_id() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
