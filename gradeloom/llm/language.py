"""Language identification: script ranges narrow the candidates of each word, then Viterbi labels spans of mixed text.

A word is a maximal run of letters of the lower-cased text. Its score in a language is the sum of log probabilities of its
character trigrams (word borders included), its prefix and suffix pairs and, for short words, of the word itself, against the
average language. The script of its first letter allows only languages that the training texts show with that script. Over a
text's words, Viterbi finds the labels of the highest total of word scores less a penalty for each switch; runs of one label
are spans. A text's language is the one whose spans hold most letters (first by name where equal), and its score is that share
of the letters, weighed with the mean certainty of the words.

Labels are learned from at most `max_docs` different texts of each language (the smallest by a hash of id and text) among rows whose language
is given and whose id is not held out; counts are added up by the executors, and a table of a fixed size for each language reaches the driver and is broadcast; more
than `MAX_LANGS` languages raise an error.

Defined cases: a very long text is labelled whole, in a step of its own; an empty table gives none; a null text or one without letters is `und` with score 0; a text whose letters are all of scripts that no
training text has is given the language of most sampled texts, first by name, with score 0; with nothing to learn from all is `und`; ties go to the
name that sorts first; repeated rows get equal results; result columns replace input columns of the same name.

Scale: one scan for training (a bounded sample goes on), one for prediction, no shuffle of texts. Texts are labelled side by
side, word by word, in numpy, in batches of a fixed number of bytes; scores are made for CELLS words times languages at a time, so memory
beside the model hardly grows with the number of languages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

MAX_DOCS = 1_000
MAX_LANGS = 256
PENALTY = 8.0
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Scores, or features times languages, that a step holds at once.
CELLS = 1 << 21
#: Scores of a word in a language its script rules out.
RULED_OUT = -1e4
MADE = ["lang_pred", "score", "spans"]

#: Scripts by ranges of code points (first, last); letters outside all of them are of script 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2B8), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else 1 + the number of its script."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    out[out > 0] = 1
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[a : b + 1] *= k + 2
    return out


class Words:
    """The words of some texts as arrays: text, letters, script, and n-gram features in a flat list with the word of each."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _letters()[points]
        letter = kind > 0
        first = letter & ~np.concatenate([[False], letter[:-1]])
        last = letter & ~np.concatenate([letter[1:], [False]])
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        ends = np.cumsum([len(t) + 1 for t in lowered])
        self.n_texts, self.begin, self.end = len(texts), begin, end
        self.text = np.searchsorted(ends, begin, "right")
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.length = end - begin
        self.script = kind[begin].astype(np.int64) - 1
        self.points, self.letter = points, letter

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each feature, and its word."""
        p = np.where(self.letter, self.points, 0).astype(np.uint64)
        before, after = np.concatenate([[0], p[:-1]]).astype(np.uint64), np.concatenate([p[1:], [0]]).astype(np.uint64)
        at = np.flatnonzero(self.letter)
        word = np.repeat(np.arange(len(self.begin)), self.length)
        tri = C.mix((before[at] * np.uint64(0x110000) + p[at]) * np.uint64(0x110000) + after[at])
        short = np.flatnonzero(self.length <= 6)
        h = np.zeros(len(short), np.uint64)
        for k in range(6):
            some = self.length[short] > k
            h = np.where(some, C.mix(h + p[np.minimum(self.begin[short] + k, len(p) - 1)] + np.uint64(0x51)), h)
        # The last three letters with the border, for word endings.
        long = np.flatnonzero(self.length >= 4)
        e = self.end[long]
        tail = C.mix(((p[e - 1] * np.uint64(0x110000) + p[e - 2]) * np.uint64(0x110000) + p[e - 3]) ^ np.uint64(0xABCDEF0123))
        bucket = np.concatenate([tri, h, tail]) % np.uint64(BUCKETS)
        return bucket.astype(np.int64), np.concatenate([word, short, long])


class Model:
    """langs, sorted; log odds of each bucket in each; allowed[script, lang]; log share of each as a prior of a text."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, texts: np.ndarray, penalty: float = PENALTY):
        self.langs, self.penalty = langs, penalty
        p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS) if len(langs) else counts
        mean = p.mean(axis=0) if len(langs) else 0
        self.odds = np.log(p / mean).T.astype(np.float32).copy() if len(langs) else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = (share >= 0.01).T  # script x lang
        self.common = int(np.argmax(texts)) if len(langs) else 0

    def label(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The label of each word, and how sure it is: the best language's share of the probability of all candidates.

        A text's candidates are the languages that the scripts of its words allow; texts of the same candidates go together, and
        no other language is scored.
        """
        n = len(w.begin)
        label, sure = np.zeros(n, np.int64), np.zeros(n)
        bucket, word = w.features()
        order = np.argsort(word, kind="stable")
        features = bucket[order].astype(np.uint16 if BUCKETS <= 1 << 16 else np.int64), np.searchsorted(word[order], np.arange(n + 1))
        del bucket, word, order
        seen = np.zeros((w.n_texts, self.allowed.shape[0]), bool)
        seen[w.text, w.script] = True
        candidates = (seen.astype(np.uint8) @ self.allowed.astype(np.uint8)) > 0
        counts = np.bincount(w.text, minlength=w.n_texts)
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        kinds, kind = np.unique(candidates, axis=0, return_inverse=True)
        for c, mask in enumerate(kinds):
            langs = np.flatnonzero(mask) if mask.any() else np.array([0])
            texts = np.flatnonzero((kind.reshape(-1) == c) & (counts > 0))
            texts = texts[np.argsort(-counts[texts], kind="stable")]
            most = max(1, CELLS // len(langs))
            for lo in range(0, len(texts), most):
                own = texts[lo : lo + most]
                self._side_by_side(firsts[own], counts[own], langs, lambda ids, langs=langs: self._scores(w, ids, langs, features), label, sure)
        return label, sure

    def _scores(self, w: Words, ids: np.ndarray, langs: np.ndarray, features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Scores of words in some languages: sums over each word's features, CELLS of them at a time."""
        bucket, at = features
        whole = len(langs) == len(self.langs)
        out, size = np.zeros((len(ids), len(langs))), at[ids + 1] - at[ids]
        ends, lo, most = np.cumsum(size), 0, max(1, CELLS // len(langs))
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            if hi == lo + 1:  # also a word of very many letters
                for f in range(int(at[ids[lo]]), int(at[ids[lo] + 1]), most):
                    some = bucket[f : min(f + most, int(at[ids[lo] + 1]))]
                    out[lo] += (self.odds[some] if whole else self.odds[some[:, None], langs]).sum(axis=0, dtype=np.float64)
            else:
                begin = np.concatenate([[0], np.cumsum(size[lo : hi - 1])])
                flat = np.arange(int(size[lo:hi].sum())) + np.repeat(at[ids[lo:hi]] - begin, size[lo:hi])
                some = bucket[flat]
                out[lo:hi] = np.add.reduceat(self.odds[some] if whole else self.odds[some[:, None], langs], begin, axis=0, dtype=np.float64)
            lo = hi
        allowed = self.allowed[w.script[ids]]
        known = allowed.any(axis=1)
        out[known] = np.where(allowed[known][:, langs], out[known], RULED_OUT)
        out[~known] = 0
        return out

    def _viterbi(self, w: Words, scores: np.ndarray) -> np.ndarray:
        """The labels of all words by given scores in all languages."""
        counts = np.bincount(w.text, minlength=w.n_texts)
        firsts, label = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.zeros(len(scores), np.int64)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        if len(order):
            self._side_by_side(firsts[order], counts[order], np.arange(scores.shape[1]), lambda ids: scores[ids], label, np.zeros(len(scores)))
        return label

    def _side_by_side(self, first: np.ndarray, length: np.ndarray, langs: np.ndarray, scored: Callable[[np.ndarray], np.ndarray], label: np.ndarray, sure: np.ndarray) -> None:
        """Texts side by side, one word of each at a time, longest texts first so that those still going are a prefix.

        What a word comes from is its own language or the best one of the word before: a bit a language and one number. Scores are made for
        so many words at a time that they stay within CELLS.
        """
        k, steps = len(langs), int(length[0])
        going = np.searchsorted(-length, -np.arange(steps), "left")
        row = np.concatenate([[0], np.cumsum(going)])  # words in the order of steps
        stays, tops = np.zeros((int(row[-1]), -(-k // 8)), np.uint8), np.zeros(int(row[-1]), np.int16)
        best, t = np.zeros((len(first), k)), 0
        while t < steps:
            to = max(t + 1, int(np.searchsorted(row, row[t] + max(1, CELLS // k), "right")) - 1)
            ids = np.concatenate([first[: going[u]] + u for u in range(t, to)])
            scores = scored(ids)
            sure[ids] = 1 / np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -50, 0)).sum(axis=1)
            for u in range(t, to):
                m = int(going[u])
                b, own = best[:m], scores[row[u] - row[t] : row[u + 1] - row[t]]
                if u:
                    top = b.argmax(axis=1)
                    switch = b[np.arange(m), top] - self.penalty
                    stay = b >= switch[:, None]
                    stays[row[u] : row[u + 1]], tops[row[u] : row[u + 1]] = np.packbits(stay, axis=1), top
                    b = np.where(stay, b, switch[:, None])
                best[:m] = b + own
            t = to
        now = best.argmax(axis=1)
        for u in range(steps - 1, -1, -1):
            m = int(going[u])
            label[first[:m] + u] = langs[now[:m]]
            if u:
                bits = stays[row[u] : row[u + 1]][np.arange(m), now[:m] // 8] >> (7 - now[:m] % 8) & 1
                now[:m] = np.where(bits, now[:m], tops[row[u] : row[u + 1]])

    def predict(self, texts: list[str | None], spans: bool = False):
        """lang, score and spans (begin, end in characters of the lower-cased text, lang) of each text."""
        names, share, found = np.full(len(texts), -1), np.zeros(len(texts)), [[] for _ in texts]
        if self.langs:
            w = Words(texts)
            if len(w.begin):
                label, sure = self.label(w)
                k = len(self.langs)
                letters = np.bincount(w.text * k + label, w.length, minlength=len(texts) * k).reshape(-1, k)
                known = self.allowed[w.script].any(axis=1)
                own = np.bincount(w.text * k + label, w.length * np.where(known, sure, 0), minlength=len(texts) * k).reshape(-1, k)
                total = letters.sum(axis=1)
                usable = np.bincount(w.text, known, minlength=len(texts)) > 0
                best = np.where(usable, letters.argmax(axis=1), self.common)
                names = np.where(total > 0, best, -1)
                pick = own[np.arange(len(texts)), best]
                share = np.where((total > 0) & usable, (letters[np.arange(len(texts)), best] + pick) / np.maximum(2 * total, 1), 0)
                if spans:
                    new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (w.text[1:] != w.text[:-1])]))
                    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(label)], strict=True):
                        s = int(w.starts[w.text[a]])
                        found[w.text[a]].append({"begin": int(w.begin[a]) - s, "end": int(w.end[b - 1]) - s, "lang": self.langs[label[a]]})
        return [self.langs[x] if x >= 0 else "und" for x in names.tolist()], share, found


def _pieces(column, most: int = C.CHUNK_BYTES * 4):
    """Lists of texts of about that many bytes together, or of one text."""
    data, offs = C.buffers(column)
    for lo, hi in C.chunks(offs, most):
        yield column.slice(lo, hi - lo).to_pylist()


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_docs: int = MAX_DOCS, penalty: float = PENALTY) -> Model:
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.bucket_of_id("id") != 0))
    # The ids come first, so that only the chosen texts are moved.
    if len(some := rows.select("lang").distinct().limit(MAX_LANGS + 1).collect()) > MAX_LANGS:
        raise ValueError(f"more than {len(some) - 1} languages")
    few = C.least(rows.select("lang", F.xxhash64("id", "text").alias("h")), max_docs, "lang")
    chosen = rows.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(few), ["lang", "h"], "left_semi")
    chosen = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")  # a repeated row counts once

    def step(batches):
        names: dict[str, int] = {}
        counts, scripts, texts = [], [], []
        for b in batches:
            langs = b.column(0).to_pylist()
            at = 0
            for part in _pieces(b.column(1)):
                w = Words(part)
                for x in langs[at : at + len(part)]:
                    if x not in names:
                        names[x] = len(names)
                        counts.append(np.zeros(BUCKETS, np.int64)), scripts.append(np.zeros(len(SCRIPTS) + 1, np.int64)), texts.append(0)
                own = np.array([names[x] for x in langs[at : at + len(part)]])
                bucket, word = w.features() if len(w.begin) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for k in np.unique(own):
                    mine = own[w.text] == k if len(w.begin) else np.zeros(0, bool)
                    if len(mine):
                        counts[k] += np.bincount(bucket[mine[word]], minlength=BUCKETS)
                        scripts[k] += np.bincount(w.script[mine], w.length[mine], minlength=len(SCRIPTS) + 1).astype(np.int64)
                    texts[k] += int((own == k).sum())
                at += len(part)
        for x, k in names.items():
            some = np.flatnonzero(counts[k])
            seen = np.flatnonzero(scripts[k])
            where = np.concatenate([some, BUCKETS + seen, [BUCKETS + len(SCRIPTS) + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(where)), pa.array(where), pa.array(np.concatenate([counts[k][some], scripts[k][seen], [texts[k]]]))], names=["lang", "at", "n"])

    found = chosen.mapInArrow(step, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 2), np.float64)
    table[np.searchsorted(langs, found["lang"].to_numpy()) if langs else [], found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return Model(langs, table[:, :BUCKETS], table[:, BUCKETS:-1], table[:, -1], penalty)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """docs' columns (or those of `keep`) with lang_pred, score and, if asked for, spans."""
    made = [n for n in MADE if spans or n != "spans"]
    keep = C.others(docs, made) if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text")).toDF(*[f"c{k}" for k in range(len(keep))], "text")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", span)] if spans else [])])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        for b in batches:
            langs, scores, found = [], [], []
            for part in _pieces(b.column(b.num_columns - 1)):
                x = held.value.predict(part, spans)
                langs += x[0]
                scores.append(x[1])
                found += x[2]
            out = [*b.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return source.mapInArrow(step, schema).toDF(*keep, *made)


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs), keep=["doc_id"], spans=False).select("doc_id", (C.bucket_of_id() == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
