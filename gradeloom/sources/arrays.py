"""Large JSON arrays, read in many tasks: byte ranges, element borders by a scan that knows strings, pieces of elements.

A range of bytes does not tell whether it begins within a string, nor how deep. The first scan therefore looks at each range both ways,
and notes for either how it ends: within a string or not, how much deeper, and how many commas and opening brackets stood at each depth
from its start. These summaries, a row a range, are composed along a file, which settles how each range begins and the number of its first element.
The second scan cuts elements: those whose comma or bracket in front lies in the range, the last one read on beyond its end. A backslash at
a border is looked back for. Borders are ASCII signs, so no character is cut.

A file is an array if it begins with a bracket, all its pieces parse, and it ends outside of strings at depth 0; other files are unreadable as a whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources.documents import place

#: Bytes of a range, of a part that is looked at in one step, and of a piece of elements.
RANGE, STEP, PIECE = 64 << 20, 4 << 20, 1 << 20
#: Bytes that a small read fetches at once, and how many of them before its place, where backslashes are looked for.
AHEAD, BACK = 1 << 18, 1 << 11
#: Bytes of the first step beyond a range's end; each further one has twice as many.
FIRST = 1 << 9
#: White space that may stand before and after an array.
END = 1 << 12
QUOTE, SLASH, COMMA, OPEN, CLOSE, LEFT, RIGHT = b'"\\,[]{}'
#: By byte: whether it is a sign, and how much deeper it leads.
SIGNS, DEEPER = np.zeros(256, bool), np.zeros(256, np.int64)
SIGNS[[COMMA, OPEN, CLOSE, LEFT, RIGHT]], DEEPER[[OPEN, LEFT]], DEEPER[[CLOSE, RIGHT]] = True, 1, -1


class Near:
    """A file whose small reads are served from one larger part, so that ranges side by side are one read."""

    def __init__(self, file):
        self.file, self.at, self.part = file, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if n >= AHEAD:
            return self.file.read_at(n, at)
        if not (self.at <= at and at + n <= self.at + len(self.part)):
            self.at = max(0, at - BACK)
            self.part = self.file.read_at(AHEAD, self.at)
        return self.part[at - self.at : at - self.at + n]


class Scan:
    """Walks over bytes part by part: where strings are, and how deep each sign stands."""

    def __init__(self, in_string: bool, depth: int, escaped: bool):
        self.in_string, self.depth, self.escaped = in_string, depth, escaped

    def step(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of signs outside of strings, the signs, the depth before each)"""
        n = len(data)
        places = np.arange(n)
        plain = np.where(data != SLASH, places, -1)
        last = np.maximum.accumulate(plain)  # of the bytes up to here, the last that is no backslash
        before = np.concatenate([[-1], last[:-1]])
        slashes = places - 1 - before
        if self.escaped:  # the run of backslashes before the first byte is odd
            slashes = slashes + (before < 0)
        quotes = (data == QUOTE) & (slashes % 2 == 0)
        self.escaped = bool(n) and bool((int(slashes[-1]) + 1) % 2) and data[-1] == SLASH
        inside = (np.cumsum(quotes) - quotes + self.in_string) % 2 == 1
        signs = np.flatnonzero(~inside & SIGNS[data])
        kinds = data[signs]
        change = DEEPER[kinds]
        depth = self.depth + np.cumsum(change) - change
        self.depth += int(change.sum())
        self.in_string = (int(quotes.sum()) + self.in_string) % 2 == 1
        return signs, kinds, depth


def _escaped(file, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while at > 0:
        part = file.read_at(min(at, 1024), max(0, at - 1024))
        run = len(part) - len(part.rstrip(b"\\"))
        n, at = n + run, at - len(part)
        if run < len(part):
            break
    return n % 2 == 1


def _summary(file, lo: int, hi: int) -> list[tuple]:
    """(in_string at the start, at the end, change of depth, commas and brackets by depth from the start) for either start."""
    escaped, found = _escaped(file, lo), []
    for start in (False, True):
        scan, commas, opens = Scan(start, 0, escaped), {}, {}
        for at in range(lo, hi, STEP):
            data = np.frombuffer(file.read_at(min(STEP, hi - at), at), np.uint8)
            _, kinds, depth = scan.step(data)
            for table, sign in ((commas, COMMA), (opens, OPEN)):
                own = depth[kinds == sign]
                low = int(own.min()) if len(own) else 0
                for d, n in enumerate(np.bincount(own - low).tolist(), low):
                    if n:
                        table[d] = table.get(d, 0) + n
        found.append((start, scan.in_string, scan.depth, commas, opens))
    return found


SUMMARY = "path string, k long, lo long, hi long, starts boolean, ends boolean, deeper long, commas map<long,long>, opens map<long,long>"
STARTS = "path string, k long, lo long, hi long, size long, in_string boolean, depth long, first_idx long, is_array boolean"


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file begins, from the summaries of those before it."""
    group = group.sort_values(["k", "starts"])
    size, in_string, depth, first, arrays, rows = int(group["hi"].max()), False, 0, 0, 0, []
    # Two rows a range, one for either start.
    told = list(zip(*(group[c].tolist() for c in ("path", "k", "lo", "hi", "ends", "deeper", "commas", "opens")), strict=True))
    for plain, quoted in zip(told[::2], told[1::2], strict=True):
        path, k, lo, hi, ends, deeper, commas, opens = quoted if in_string else plain
        rows.append([path, k, lo, hi, size, in_string, depth, first])
        opened = dict(opens).get(-depth, 0)
        first, arrays = first + dict(commas).get(1 - depth, 0) + opened, arrays + opened
        in_string, depth = bool(ends), depth + int(deeper)
    out = pd.DataFrame(rows, columns=["path", "k", "lo", "hi", "size", "in_string", "depth", "first_idx"])
    return out.assign(is_array=not in_string and depth == 0 and arrays == 1)


def _elements(file, lo: int, hi: int, size: int, in_string: bool, depth: int) -> Iterator[bytes]:
    """The elements whose border in front lies in [lo, hi)."""
    scan, begun, at, beyond = Scan(in_string, depth, _escaped(file, lo)), None, lo, FIRST
    while at < size and (at < hi or begun is not None):
        # A step ends at the range's end, so that what lies beyond is read for the last element only, and about as much as that has left.
        to = min(size, at + STEP, hi) if at < hi else min(size, at + min(STEP, beyond))
        beyond *= 1 if at < hi else 2
        data = file.read_at(to - at, at)
        signs, kinds, depths = scan.step(np.frombuffer(data, np.uint8))
        from_ = 0
        borders = ((kinds == COMMA) & (depths == 1)) | ((kinds == OPEN) & (depths == 0)) | ((kinds == CLOSE) & (depths == 1))
        for place_, kind in zip(signs[borders].tolist(), kinds[borders].tolist(), strict=True):
            if begun is not None:
                begun.append(data[from_:place_])
                yield b"".join(begun)
                begun = None
            from_ = place_ + 1
            if kind != CLOSE and at + place_ < hi:
                begun = []
            elif at + place_ >= hi:
                return
        if begun is not None:
            begun.append(data[from_:])
        at = to


def ranges(spark: SparkSession, files: DataFrame, span: int) -> DataFrame:
    """(path, k, lo, hi) of files (path, length)."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / span).cast("long")))
    return files.filter("length > 0").select("path", "length", k.alias("k")).select("path", "k", (F.col("k") * span).alias("lo"), F.least((F.col("k") + 1) * span, F.col("length")).alias("hi"))


def pieces(spark: SparkSession, files: DataFrame, span: int = RANGE, piece: int = PIECE) -> DataFrame:
    """Of files (path, length): (path, first_idx, body): arrays of a few elements each, with the number of the first; body is null once where a file is no array."""

    def opened(batch):
        """Each range with its file, which is opened once for ranges that follow one another."""
        rows = sorted(batch.to_pylist(), key=lambda r: (r["path"], r["k"]))
        for name, own in itertools.groupby(rows, key=lambda r: r["path"]):
            filesystem, path = place(name)
            with filesystem.open_input_file(path) as file:
                near = Near(file)
                for row in own:
                    yield row, near

    def summaries(batches):
        kinds = (pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.int64(), *[pa.map_(pa.int64(), pa.int64())] * 2)
        for b in batches:
            held = []
            for row, file in opened(b):
                held += [(row["path"], row["k"], row["lo"], row["hi"], *f[:3], list(f[3].items()), list(f[4].items())) for f in _summary(file, row["lo"], row["hi"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["path", "k", "lo", "hi", "starts", "ends", "deeper", "commas", "opens"])

    def cut(batches):
        for b in batches:
            held, size = [], 0
            for found, n in cut_of(b):
                held.append(found)
                size += n
                if size >= PIECE:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    def cut_of(batch):
        """(path, number of the first, elements) and bytes of each piece."""
        for row, file in opened(batch):
            ends = [file.read_at(min(row["size"], END), max(0, at)) for at in (0, row["size"] - END)] if row["k"] == 0 else []
            if not row["is_array"] or ends and not (ends[0].lstrip().startswith(b"[") and ends[1].rstrip().endswith(b"]")):
                if row["k"] == 0:
                    yield (row["path"], 0, None), 0
                continue
            first, held, size = row["first_idx"], [], 0
            for element in _elements(file, row["lo"], row["hi"], row["size"], row["in_string"], row["depth"]):
                # Nothing between two commas is no element; nothing at all is an empty array.
                held.append(element if element.strip() or first + len(held) == 0 else b"}")
                size += len(element)
                if size >= piece:
                    yield (row["path"], first, held), size
                    first, held, size = first + len(held), [], 0
            if held:
                yield (row["path"], first, held), size

    def made(found):
        bodies = [None if h is None else "[" + ",".join(x.decode("utf-8", "replace") for x in h) + "]" for _, _, h in found]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int64()), pa.array(bodies, pa.string())], names=["path", "first_idx", "body"])

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ranges that make up a step go to one task, side by side: small ones are dealt and read together, large ones each alone.
    run = F.floor(F.col("lo") / max(span, STEP)).alias("run")
    own = ranges(spark, files, span)
    told = own.repartition(parts, "path", run).sortWithinPartitions("path", "k").mapInArrow(summaries, SUMMARY)
    starts = told.groupBy("path").applyInPandas(_composed, STARTS)
    return starts.repartition(parts, "path", run).sortWithinPartitions("path", "k").mapInArrow(cut, "path string, first_idx long, body string")
