"""Mixing sources to target weights, by subset-sum budget fitting.

Size of a document: its number of runs of characters other than ASCII white space. Sources, in the order of their code
points with null last, weigh 5, 2, 1 and again; their shares of the whole size are their targets, but none above `max_repeat`
times its source's size: what is above is dealt anew by weight among the others, until none is above.

A source's target is `whole` copies of every document plus a remaining budget. For that, documents are counted by their
exact size; each size gives its even share of documents, and what is still missing is fitted by a bounded-knapsack program
over the sizes left, which meets the budget exactly where a subset does, and else takes the nearest sum on either side.
Of each size, the rows with the smallest seeded hashes of all their columns are chosen, so reruns agree.

Defined cases: a null text has size 0; documents of size 0 are never taken; the null source is a source of its own; an empty
table gives an empty mix; very long texts are sizes like any other; rows that differ in any column, such as one id and text in
two sources, are told apart, and of rows that are equal altogether as many are taken as the plan says (ties); a column of the
name of `copy_column` is replaced.

Scale: text is never shuffled. Counting by (source, size) is pre-aggregated; a group of that histogram holds a source's
distinct sizes, of which there are at most sqrt(2 x words). A hot (source, size) is never gathered: its rows fall into about
sqrt(count) ranges of hashes, and only the one on the border is looked at, equal rows as one. So the plan is one row a source
and size, the place in the order of hashes up to which rows are taken; documents are read once more and compared with it. That
table is broadcast if its measured size allows, and else joined by source and size. Sources are ordered in ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import _common as C

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20240607
#: Words that the knapsack program fits; larger budgets are first brought down to this by whole documents.
DP_BUDGET = 1 << 16
#: Documents of each size that the program may choose anew.
SLACK = 16
#: Bytes of a table that may be broadcast.
MAX_BROADCAST = 32 << 20
#: Rows that one step writes out of a group of equal ones.
PART = 1 << 16


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each size to take, so that their sizes sum up to the budget or as near to it as can be found."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)  # Python's integers: no overflow
    rest = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    for k in order:
        if rest <= dp_budget // 2:
            break
        more = min(int(counts[k] - take[k]), max(0, -(-(rest - dp_budget // 2) // int(sizes[k]))), rest // int(sizes[k]))
        take[k] += more
        rest -= more * int(sizes[k])
    for k in order[::-1]:  # a few short documents are given back, so that the program has a choice
        less = min(int(take[k]), SLACK, max(0, dp_budget - rest) // int(sizes[k]))
        take[k] -= less
        rest += less * int(sizes[k])
    if rest <= 0:
        return take
    # Sums up to twice the rest: whatever is above lies further off than nothing at all.
    goal = min(rest, dp_budget)
    cap = 2 * goal
    reach, mask, made_by = 1, (1 << (cap + 1)) - 1, {0: (-1, 0)}
    for k in order:
        left, step = min(int(counts[k] - take[k]), cap // int(sizes[k])), 1
        while left > 0 and not reach >> goal & 1:
            m = min(step, left)
            left, step = left - m, step * 2
            new = (reach << (m * int(sizes[k]))) & mask & ~reach
            if new:
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(cap // 8 + 1, "little"), np.uint8), bitorder="little"))
                made_by.update(dict.fromkeys(bits.tolist(), (int(k), m)))
                reach |= new
        if reach >> goal & 1:
            break
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = goal + ((reach >> goal) & -(reach >> goal)).bit_length() - 1 if reach >> goal else 2 * goal + 1
    at = below if goal - below <= above - goal else above
    rest -= at
    while at:
        k, m = made_by[at]
        take[k] += m
        at -= m * int(sizes[k])
    if rest > 0 and (more := [k for k in order if counts[k] > take[k] and sizes[k] >= rest and sizes[k] - rest < rest]):
        take[more[-1]] += 1
    return take


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) with target: weights by order of source, the excess over max_repeat times the size reshared.

    With every source's bound divided by its weight in order, those capped come first; the level of the rest follows from running
    sums. Orders are dealt by range and numbered within each range, so no task sees all sources.
    """
    ranked, before = _in_order(sizes.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], {"ones": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (before["ones"] % len(weights) + 1).cast("int"))
    most = F.col("source_size") * float(max_repeat)
    ranked = C.stage(ranked.select("source", "source_size", weight.alias("weight"), most.alias("most")), "mix-sources")
    total, all_weights = (float(x or 0) for x in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    by_level, before = _in_order(ranked.withColumn("ratio", F.col("most") / F.col("weight")), ["ratio", "is_null", "source"], {"most": F.col("most"), "weight": F.col("weight")})
    left = F.lit(all_weights) - before["weight"]
    filled = by_level.filter(before["most"] + F.col("ratio") * left >= F.lit(total)).select(((F.lit(total) - before["most"]) / left).alias("level"), "ratio")
    first = filled.agg(F.min(F.struct("ratio", "level")).alias("first")).first()["first"]
    level = max(0.0, first["level"]) if first else 0.0
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).select("source", "source_size", "target")


def _in_order(df: DataFrame, order: list[str], sums: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """df, and for each of sums a column of its total over the rows before; order must tell rows apart."""
    if "is_null" not in df.columns:
        df = df.withColumn("is_null", F.col("source").isNull())
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = C.stage(dealt.withColumns({f"own_{n}": c.cast("double") for n, c in sums.items()}), "mix-order")
    # One row a range, of which there are as many as shuffle partitions.
    ranges = dealt.groupBy("part").agg(*[F.sum(f"own_{n}").alias(f"range_{n}") for n in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("part").alias("in_part"), *[F.coalesce(F.sum(f"range_{n}").over(earlier), F.lit(0.0)).alias(f"ahead_{n}") for n in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"within_{n}": F.coalesce(F.sum(f"own_{n}").over(within), F.lit(0.0)) for n in sums})
    found = dealt.join(F.broadcast(ranges), F.col("part") == F.col("in_part"))
    return found, {n: F.col(f"ahead_{n}") + F.col(f"within_{n}") for n in sums}


def _plan(dp_budget: int):
    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = int(target // total) if total else 0
        some = group["size"].to_numpy() > 0
        extra = np.zeros(len(group), np.int64)
        extra[some] = fit_counts(group["size"].to_numpy()[some], group["n"].to_numpy()[some], int(round(target - whole * total)), dp_budget)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "n": group["n"], "source_size": total, "target": target, "whole": np.where(some, whole, 0), "extra": extra})

    return plan


def _hashable(field) -> Column:
    """A column that can be hashed: maps and variants by their JSON."""
    kind = field.dataType.json()
    name = F.col(f"`{field.name}`")
    return F.to_json(F.struct(name)) if '"map"' in kind or "variant" in kind else name


def _keyed(docs: DataFrame, text: str, source: str, seed: int) -> DataFrame:
    """(row, source, size, h1, h2): two hashes of all of a row's columns, so rows that share them are equal altogether."""
    values = [x for c in map(_hashable, docs.schema.fields) for x in (c, c.isNull())]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col(f"`{source}`").alias("source"), n_tokens(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.lit(seed), *values).alias("h1"), F.xxhash64(F.lit(seed + 1), *values[::-1]).alias("h2"))


def _cuts(slim: DataFrame, weights, max_repeat: int, dp_budget: int) -> DataFrame:
    """(c_source, c_size, source_size, target, whole, extra, n, c1, c2, t, m) for each source and size.

    Every row is taken `whole` times; of its source and size, those before (c1, c2) in the order of hashes once more, and t of
    the m equal rows that are there. Where extra is 0 or n there is no such row, and c1 is null.
    """
    histogram = C.stage(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    goals = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeat)
    by_source = histogram.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).select("source", "size", "n", "source_size", "target")
    plan = by_source.groupBy("source").applyInPandas(_plan(dp_budget), "source string, size long, n long, source_size long, target double, whole long, extra long")
    plan = C.stage(plan.withColumnsRenamed({"source": "c_source", "size": "c_size"}), "mix-plan")
    # About sqrt(n) ranges of hashes; only the one in which the extra-th row lies is looked at row by row.
    unit = (F.col("h1").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    some = plan.filter("extra > 0 and extra < n").select("c_source", "c_size", "n", "extra")
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    opened = _join_small(slim, some, same).select("c_source", "c_size", "extra", F.floor(unit * F.ceil(F.sqrt("n"))).alias("bucket"), "h1", "h2")
    earlier = Window.partitionBy("c_source", "c_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = opened.groupBy("c_source", "c_size", "extra", "bucket").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    border = C.stage(counts.filter("before < extra and before + k >= extra").select(F.col("c_source").alias("b_source"), F.col("c_size").alias("b_size"), F.col("bucket").alias("b_bucket"), "before"), "mix-borders")
    near = _join_small(opened, border, F.col("c_source").eqNullSafe(F.col("b_source")) & (F.col("c_size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
    # Equal rows are one here, so their number does not matter.
    earlier = Window.partitionBy("c_source", "c_size").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    keys = near.groupBy("c_source", "c_size", "extra", "before", "h1", "h2").agg(F.count("*").alias("m")).withColumn("t", F.col("extra") - F.col("before") - F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    cut = keys.filter("t > 0 and t <= m").select(F.col("c_source").alias("k_source"), F.col("c_size").alias("k_size"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "t", "m")
    told = plan.join(cut, F.col("c_source").eqNullSafe(F.col("k_source")) & (F.col("c_size") == F.col("k_size")), "left").drop("k_source", "k_size")
    return C.stage(told, "mix-cuts")


def _join_small(left: DataFrame, small: DataFrame, on: Column) -> DataFrame:
    """left with small's columns; small is broadcast if its measured size is below MAX_BROADCAST."""
    names = [f.name for f in small.schema.fields if f.dataType.simpleString() == "string"]
    rows, wide = small.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(0)))).first()
    return left.join(F.broadcast(small) if rows * 16 * len(small.columns) + (wide or 0) <= MAX_BROADCAST else small, on)


def _taken(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """keyed's rows, each with source_size, target and copies; of equal rows at a cut t have one copy more than the others."""
    found = _join_small(keyed, cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")))
    at_cut = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    before = (F.col("h1") < F.col("c1")) | (F.col("h1") == F.col("c1")) & (F.col("h2") < F.col("c2"))
    more = F.when(F.col("c1").isNull(), F.col("extra") > 0).otherwise(before | at_cut)
    made = [*keyed.columns, "source_size", "target", "copies"]
    split = F.coalesce(at_cut & (F.col("t") < F.col("m")), F.lit(False))
    once = found.filter(~split).withColumn("copies", F.col("whole") + more.cast("long")).select(made)
    if cuts.filter("t < m").isEmpty():
        return once
    # Equal rows are counted first, which leaves one of them a task, and then written out in parts of bounded length.
    own = keyed.columns
    equal = found.filter(split).groupBy("source", "size", "h1", "h2", "source_size", "target", "whole", "t", "m").agg(*[F.first(c).alias(c) for c in own if c not in ("source", "size", "h1", "h2")])
    parts = equal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PART)))).repartition("h1", "part")
    rows = parts.withColumn("i", F.explode(F.sequence(F.col("part") * PART + 1, F.least(F.col("m"), (F.col("part") + 1) * PART))))
    return once.unionByName(rows.withColumn("copies", F.col("whole") + (F.col("i") <= F.col("t")).cast("long")).select(made))


def plan_mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, dp_budget: int = DP_BUDGET) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how many copies of each row the mix takes."""
    keyed = _keyed(docs, text, source, seed).withColumn("row", F.col(f"row.`{doc_id}`"))
    slim = C.stage(keyed, "mix-sizes")
    cuts = _cuts(slim, weights, max_repeat, dp_budget)
    return _taken(slim, cuts).select(F.col("row").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", copy_column: str | None = None, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, dp_budget: int = DP_BUDGET) -> DataFrame:
    """The mix itself: docs' rows, each as often as plan_mix says; copy_column numbers a row's copies from 1."""
    keyed = _keyed(docs, text, source, seed)
    cuts = _cuts(C.stage(keyed.drop("row"), "mix-sizes"), weights, max_repeat, dp_budget)
    rows = _taken(keyed, cuts).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    keep = C.others(docs, [copy_column] if copy_column else [])
    return rows.select(*[F.col(f"row.`{c}`") for c in keep], *([F.col("nth").alias(copy_column)] if copy_column else []))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
