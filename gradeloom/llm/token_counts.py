"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at a place; dynamic programming over places carries the best
score and its number of pieces. Ties follow the tokenizer: of segmentations of equal score up to a place, the one whose last
piece is longest stays. A character that is no piece of its own may stand as unknown, at the least score less 10; it then
counts as many tokens as it has UTF-8 bytes (byte fallback). Spaces become U+2581 and a text that
starts with none gets one in front.

No public file holds a unigram model, and none is trained here: pieces and scores come from the SentencePiece file, whose
scores are whole numbers. Sums are therefore exact, so texts may be cut wherever no piece reaches across, and words, once
counted, are remembered. Tests hold the counts against the `tokenizers` library's Unigram model of the same vocabulary.

Defined cases: a null or empty text has no tokens; texts of any length and script are counted in full; a word that no piece
divides is one word, at a cost in proportion to its length; ties are as above; an empty table gives none; repeated rows each get their count; `n_tokens` replaces an input
column of that name.

Scale: one scan, no shuffle; the vocabulary, of a fixed size, is broadcast, and a worker remembers at most CACHED words.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED = 400_000
LONG_TEXT = 1 << 21
#: Longer words are counted each time.
LONGEST_CACHED = 64


def vocabulary(path: str = MODEL_FILE) -> list[tuple[str, float]]:
    """Pieces with their scores, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


class Counter(dict):
    """Maps a word (a run that starts at a space or a line break, or the text's first) to its number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        missing = [b for b in range(256) if f"<0x{b:02X}>" not in {p for p, _ in pieces}]
        if missing:
            raise ValueError(f"byte fallback needs a piece for every byte; there is none for {missing[:3]}")
        if any(s != int(s) for _, s in pieces):
            raise ValueError("scores must be whole numbers: other sums depend on where a text is cut")
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        across = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        lines = any("\n" in p for p, _ in pieces if len(p) > 1)
        stop = "" if across else SPACE
        stop += "" if lines else "\n"
        # A run of spaces with what follows, a line break alone, or what comes first.
        self.cut = re.compile(f"{SPACE}+[^{stop}]*|\n|[^{stop}]+" if not across and not lines else f"{SPACE}+[^{stop}]*|[^{stop}]+" if not across else ".+", re.S)

    def fresh(self, word: str) -> int:
        n = len(word)
        score, count = [None] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        done = 0
        for last, (size, own) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:  # places before this one that have had all their pieces
                done += 1
                self._settle(word, done, score, count)
            s = score[end - size] + own
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - size] + 1
        while done < n:
            done += 1
            self._settle(word, done, score, count)
        return count[n]

    def _settle(self, word: str, end: int, score: list, count: list) -> None:
        c = word[end - 1]
        if c not in self.single:
            s = score[end - 1] + self.unknown
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))

    def __missing__(self, word: str) -> int:
        n = self.fresh(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        text = text if text[0] == SPACE else SPACE + text
        if len(text) > LONG_TEXT:  # not all words at once
            return sum(self[m[0]] for m in self.cut.finditer(text))
        return sum(map(self.__getitem__, self.cut.findall(text)))


def count_tokens(docs: DataFrame, *, text: str = "text", path: str = MODEL_FILE, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of `keep`) with n_tokens."""
    keep = C.others(docs, ["n_tokens"]) if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text")).toDF(*[f"c{k}" for k in range(len(keep))], "text")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def step(batches):
        counter = Counter(pieces.value)
        for b in batches:
            counts = []
            for lo in range(0, b.num_rows, 500):
                counts += [counter.count(t) for t in b.column(b.num_columns - 1).slice(lo, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], names=schema.names)

    return source.mapInArrow(step, schema).toDF(*keep, "n_tokens")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
