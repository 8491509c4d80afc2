"""Score roll-ups: per dataset and run (A1), per question (A2, A6), over runs (A3, A4, A7) and over datasets (A5, A10).

A result row has dataset, run_id, idx, question_id, fine_grained_score, coarse_grained_score, earned_points, max_points and
error (null where the problem was scored). All roll-ups are hash aggregates with partial sums, except the one that must round
after each addition, which folds a dataset run's ordered scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import text as X
from gradeloom.sources.staging import large, stage

SCORES = {"": "earned_points", "_fine": "fine_grained_score", "_coarse": "coarse_grained_score"}


def earned(fine: Column, coarse: Column) -> Column:
    """The greater score; NaN counts as 0 (Q18)."""
    return F.greatest(X.no_nan(fine), X.no_nan(coarse))


def earned_over_runs(fine: Column, coarse: Column, valid_marking: Column) -> Column:
    """Q17: over several runs the fine score counts only where the marking says something."""
    return F.when(valid_marking, earned(fine, coarse)).otherwise(X.no_nan(coarse))


def scored(results: DataFrame) -> DataFrame:
    """Without the problems that failed."""
    return results.filter(F.col("error").isNull()) if "error" in results.columns else results


#: How near a score must be to half a cent for the order of additions to matter; the error of sums below 10**8 is less.
NEAR_TIE = 1e-5


def _stepwise(results: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Per group the sums that rounding after each addition gives, by partial sums.

    A running sum is a whole number of cents, so a score adds its own cents, whatever came before it, unless it lies half-way
    between two cents; then what it adds depends on the cents before it. One aggregate sums up the whole cents and finds the groups
    that have such scores. Where there is none that is all; else their rows alone are ordered, see _ordered_cents.
    """
    names = list(SCORES.values())
    hundredfold = {c: F.col(c) * 100 for c in names}
    tie = {c: ok & F.col(c).isNotNull() & (F.abs(F.abs(x - F.floor(x)) - 0.5) < NEAR_TIE) for c, x in hundredfold.items()}
    cents = {c: F.when(ok & ~tie[c], F.rint(x)).otherwise(0.0) for c, x in hundredfold.items()}
    rows = results.withColumns({f"__{c}_cents": F.coalesce(v, F.lit(0.0)) for c, v in cents.items()} | {f"__{c}_tie": F.when(v, F.col(c)) for c, v in tie.items()})
    any_tie = F.coalesce(*[F.col(f"__{c}_tie") for c in names]).isNotNull()
    sums = stage(rows.groupBy(keys).agg(*[F.sum(f"__{c}_cents").alias(f"__{c}_all") for c in names], F.sum(F.when(ok, F.col("max_points"))).alias("m"), F.count("*").alias("total_count"), F.max(any_tie).alias("__ties")), "sums")
    open_ = sums.filter("__ties")
    if open_.isEmpty():
        return sums.select(*keys, *[(F.col(f"__{c}_all") / 100).alias(c) for c in names], "m", "total_count")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    of = lambda df: df.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    told = of(_ordered_cents(rows.join(of(open_.select(keys)), same, "left_semi"), keys, names))
    found = sums.join(told, same, "left")
    return found.select(*keys, *[(F.coalesce(f"__{c}_told", f"__{c}_all") / 100).alias(c) for c in names], "m", "total_count")


def _ordered_cents(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, __<name>_told): the cents of each group, its scores added in the order of idx.

    Rows are dealt by range of (keys, idx), which splits large groups. Each range becomes a step for each group in it: the scores
    half-way between two cents, each with the whole cents before it; given the cents that a group has before the range, the step tells those after it.
    Steps are composed along a group: what each adds is reckoned from what those before it add, and again until nothing changes. That is
    exact in floating numbers, in which what a score adds depends on more than whether the sum is odd; since scores
    half-way lead to even sums, a change hardly reaches beyond the next step, and two or three passes over the steps do.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [*keys, "idx", *names]
    # Keys sort nulls together and equal keys hash alike; the two hashes tell groups apart in a range.
    slim = rows.select(F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(7), *keys[::-1]).alias("h2"), *order, *[f"__{c}_cents" for c in names], *[f"__{c}_tie" for c in names])
    dealt = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "h1", "h2", *[f"__{c}_cents" for c in names], *[f"__{c}_tie" for c in names])
    n = len(names)
    schema = T.StructType([dealt.schema["key"], *T.StructType.fromDDL("part long, at long, name int, before array<double>, tie array<double>, rest double").fields])

    def steps(batches):
        part, at, key, held, last = TaskContext.get().partitionId(), -1, None, None, None

        def ended():
            columns = [[], [], [], []]
            for k in range(n):
                before, tie, rest = held[k]
                for c, v in zip(columns, (k, before, tie, rest), strict=True):
                    c.append(v)
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([key] * n), pa.array([part] * n), pa.array([at] * n), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

        for b in batches:
            ids = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()])
            cents = [b.column(3 + k).to_numpy(zero_copy_only=False) for k in range(n)]
            ties = [b.column(3 + n + k).to_numpy(zero_copy_only=False) for k in range(n)]
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                own = tuple(ids[:, lo].tolist())
                if own != last:
                    if last is not None:
                        yield ended()
                    at, key, held, last = at + 1, b.column(0).slice(lo, 1), [[[], [], 0.0] for _ in range(n)], own
                for k in range(n):
                    total = np.cumsum(cents[k][lo:hi])
                    where = np.flatnonzero(~np.isnan(ties[k][lo:hi]))
                    reached = np.diff(total[where], prepend=0.0)
                    if len(where):
                        reached[0] += held[k][2]
                        held[k][0] += reached.tolist()
                        held[k][1] += ties[k][lo:hi][where].tolist()
                    held[k][2] = float(total[-1] - total[where[-1]]) if len(where) else held[k][2] + float(total[-1])
        if last is not None:
            yield ended()

    table = stage(dealt.mapInArrow(steps, schema), "steps")
    pairs = F.arrays_zip("before", "tie")
    after = lambda first: F.aggregate(pairs, first, lambda a, x: F.rint(((a + x["before"]) / 100 + x["tie"]) * 100)) + F.col("rest")
    added = stage(table.select("key", "part", "at", "name", after(F.lit(0.0)).alias("adds")), "adds")
    # What a group had before is at most a row a range and score that it reaches into, however many rows it has.
    along = Window.partitionBy("key", "name").orderBy("part")
    while True:
        starts = added.withColumn("first", F.coalesce(F.sum("adds").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("of", F.count("*").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        spanning = starts.filter("of > 1").select("part", "at", "name", "first", F.col("adds").alias("was"))
        if spanning.isEmpty():
            break
        again = table.join(F.broadcast(spanning), ["part", "at", "name"], "left")
        again = stage(again.select("key", "part", "at", "name", (after(F.coalesce("first", F.lit(0.0))) - F.coalesce("first", F.lit(0.0))).alias("adds"), "was"), "adds")
        same = again.filter("was <> adds").isEmpty()
        added = again.drop("was")
        if same:
            break
    told = added.groupBy("key").agg(*[F.sum(F.when(F.col("name") == k, F.col("adds"))).alias(f"__{c}_told") for k, c in enumerate(names)])
    return told.select("key.*", *[f"__{c}_told" for c in names])


def dataset_score(results: DataFrame, keys: list[str], stepwise: bool = True) -> DataFrame:
    """A1: one row a group of keys. stepwise rounds after each addition, in the order of idx; without it, sums are rounded once. Both sum up before the shuffle."""
    ok = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    if stepwise:
        sums = _stepwise(results, keys, ok)
        of = F.col
    else:
        sums = results.groupBy(keys).agg(*[F.sum(F.when(ok, F.col(c))).alias(c) for c in SCORES.values()], F.sum(F.when(ok, F.col("max_points"))).alias("m"), F.count("*").alias("total_count"))
        of = lambda name: X.half_even(F.coalesce(F.col(name), F.lit(0.0)), 2)
    made = sums.select(*keys, of("fine_grained_score").alias("fine_grained_total_score"), of("coarse_grained_score").alias("coarse_grained_total_score"), of("earned_points").alias("total_score"), X.half_even(F.coalesce("m", F.lit(0.0)), 2).alias("max_possible_score"), "total_count")
    most = F.col("max_possible_score")
    return made.select(
        *keys, "fine_grained_total_score", X.rate(F.col("fine_grained_total_score"), most).alias("fine_grained_score_rate"),
        "coarse_grained_total_score", X.rate(F.col("coarse_grained_total_score"), most).alias("coarse_grained_score_rate"),
        "total_score", X.rate(F.col("total_score"), most).alias("score_rate"), "max_possible_score", "total_count",
    )


def _stats(digits: int, median: bool) -> list[Column]:
    out = []
    for suffix, name in SCORES.items():
        for kind, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), *((("median", F.median),) if median else ())):
            out.append(X.half_even(f(name), digits).alias(f"{kind}{suffix}_score"))
    return out


def question_stats(results: DataFrame, keys: list[str], digits: int = 2, median: bool = False) -> DataFrame:
    """A2 (and A6 with digits=4, median=True): statistics of each question over its runs. Only runs that scored it count.

    score_rate comes from the unrounded mean, but from the rounded one in the form with medians.
    """
    mean = X.half_even(F.avg("earned_points"), digits) if median else F.avg("earned_points")
    most = F.max("max_points")
    return scored(results).groupBy(keys).agg(F.count("*").alias("num_runs"), *_stats(digits, median), X.rate(mean, most).alias("score_rate"))


def run_stats(run_scores: DataFrame, keys: list[str]) -> DataFrame:
    """A3: over the runs of A1."""
    r = X.half_even
    return run_scores.groupBy(keys).agg(F.count("*").alias("num_runs"), r(F.avg("total_score")).alias("mean_total_score"), r(F.stddev_pop("total_score")).alias("std_total_score"), r(F.min("total_score")).alias("min_total_score"), r(F.max("total_score")).alias("max_total_score"), r(F.avg("score_rate")).alias("mean_score_rate"), r(F.stddev_pop("score_rate")).alias("std_score_rate"))


def question_based(stats: DataFrame, keys: list[str]) -> DataFrame:
    """A4: from the rounded means of questions that have runs; needs max_points beside question_stats()' columns."""
    has = F.col("num_runs") > 0
    found = stats.groupBy(keys).agg(F.count("*").alias("num_questions"), F.coalesce(F.sum(F.when(has, F.col("mean_score"))), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(has, F.col("max_points"))), F.lit(0.0)).alias("m"))
    return found.select(*keys, "num_questions", X.half_even(F.col("s")).alias("question_based_mean_score"), X.half_even(F.col("m")).alias("question_based_max_score"), X.rate(F.col("s"), F.col("m")).alias("question_based_score_rate"))


def overall_stats(results: DataFrame, stats: DataFrame, keys: list[str], run: str = "run_id", stepwise: bool = True) -> DataFrame:
    """A3 and A4 side by side (11 measures)."""
    return run_stats(dataset_score(results, [*keys, run], stepwise), keys).join(question_based(stats, keys), keys)


def grand_total(dataset_scores: DataFrame) -> DataFrame:
    """A5: the sum over datasets, and its rate."""
    found = dataset_scores.agg(F.coalesce(F.sum("total_score"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("max_possible_score"), F.lit(0.0)).alias("m"), F.count("*").alias("num_datasets"))
    return found.select(X.half_even(F.col("t")).alias("grand_total_score"), X.half_even(F.col("m")).alias("grand_max_score"), X.rate(F.col("t"), F.col("m")).alias("grand_score_rate"), "num_datasets")


#: Distinct values of a group that one task orders, and the ranges that more of them are first divided into.
ORDERED, RANGES = 100_000, 1024


def medians(rows: DataFrame, keys: list[str], value: str, ordered: int = ORDERED, ranges: int = RANGES) -> DataFrame:
    """(keys, median) of a column's values that are not null, exactly.

    Equal values are counted before the shuffle. While a group has more than `ordered` different values, they are counted by ranges, and
    the one in which the middle lies is divided anew; so no task holds or orders all values of a large group. Eight divisions
    do for any but values spread over hundreds of powers of ten; what is left then is ordered as it is.
    """
    key = F.struct(*keys).alias("key")
    counted = stage(rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m")), "values")
    sizes = stage(counted.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(0).cast("long").alias("less")), "medians")
    for _ in range(8):
        wide = sizes.filter((F.col("d") > ordered) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        inside = counted.join(wide, "key").filter("v >= lo and v <= hi")
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bucket = F.when(F.col("v") >= F.col("hi"), ranges - 1).otherwise(F.least(F.floor(share * ranges), F.lit(ranges - 1)))
        parts = inside.groupBy("key", "n", "less", bucket.alias("bucket")).agg(F.sum("m").alias("k"), F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("less")
        # The ranges that hold the two middle places: one, or two with nothing between them.
        middle = parts.withColumn("before", before).filter((F.col("before") <= F.floor(F.col("n") / 2)) & (F.col("before") + F.col("k") > F.floor((F.col("n") - 1) / 2)))
        narrowed = middle.groupBy("key", "n").agg(F.when(F.count("*") > 1, F.lit(2)).otherwise(F.max("d")).alias("d"), F.when(F.count("*") > 1, F.min("hi")).otherwise(F.min("lo")).alias("lo"), F.when(F.count("*") > 1, F.max("lo")).otherwise(F.max("hi")).alias("hi"), F.min(F.struct("before", F.col("k"))).alias("first"), F.count("*").alias("c"))
        # Of two ranges the first one's greatest value and the second one's least are the middle.
        edge = counted.join(narrowed.filter("c > 1").select("key", F.col("lo").alias("at")), "key").filter("v = at").select("key", F.col("m").alias("edge"))
        narrowed = narrowed.join(edge, "key", "left").select("key", "n", "d", "lo", "hi", F.when(F.col("c") > 1, F.col("first.before") + F.col("first.k") - F.col("edge")).otherwise(F.col("first.before")).alias("less"))
        rest = sizes.join(wide.select("key"), "key", "left_anti").select("key", "n", "d", "lo", "hi", "less")
        sizes = stage(rest.unionByName(narrowed), "medians")
    inside = counted.join(sizes, "key").filter("v >= lo and v <= hi")
    upto = F.sum("m").over(Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("less")
    placed = inside.withColumn("upto", upto)
    holds = lambda place: (F.col("upto") - F.col("m") <= place) & (place < F.col("upto"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    found = placed.groupBy("key").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))
    return found.select("key.*", "median")


def pooled_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """Over all scores of all runs."""
    r = lambda c: X.half_even(c, 4)
    e = "earned_points"
    rows = scored(results)
    found = rows.groupBy(keys).agg(F.count("*").alias("total_runs"), r(F.avg(e)).alias("mean_score"), r(F.stddev_pop(e)).alias("std_score"), r(F.min(e)).alias("min_score"), r(F.max(e)).alias("max_score"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    told = medians(rows, keys, e).withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return found.join(told, same, "left").select(*found.columns, r(F.col("median")).alias("median_score"))


def run_summary(results: DataFrame, questions: DataFrame, key: str = "dataset", run: str = "run_id") -> DataFrame:
    """Per run the earned sum over its questions, against the points of all questions of the dataset.

    The reference set's points are summed once a dataset, so no run is crossed with questions.
    """
    most = questions.groupBy(key).agg(F.sum("max_points").alias("m"))
    sums = scored(results).join(large(questions.select(key, "question_id").distinct()), [key, "question_id"], "left_semi").groupBy(key, run).agg(F.sum("earned_points").alias("t"))
    runs = results.select(key, run).distinct()
    found = runs.join(sums, [key, run], "left").join(most, key, "left")
    t, m = F.coalesce("t", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    return found.select(key, run, X.half_even(t, 4).alias("total_score"), X.half_even(m, 4).alias("max_possible_score"), X.rate(t, m).alias("score_rate"))


def summary_by_file(results: DataFrame, questions: DataFrame, key: str = "dataset", run: str = "run_id") -> DataFrame:
    """A10: one row a statistics file. A file without runs has rate 0."""
    most = questions.groupBy(key).agg(F.sum("max_points").alias("m"))
    found = scored(results).groupBy(key).agg(F.countDistinct(run).alias("num_runs"), F.sum("earned_points").alias("t"), F.avg("earned_points").alias("mean"), F.stddev_pop("earned_points").alias("std")).join(most, key)
    full = F.col("m") * F.col("num_runs")
    return found.select(key, "num_runs", X.half_even(F.col("t")).alias("total_score"), X.half_even(full).alias("max_possible_score"), X.half_even(F.col("mean"), 4).alias("mean_score"), X.half_even(F.col("std"), 4).alias("std_score"), X.rate(F.col("t"), full).alias("mean_score_rate"), X.rate(F.col("std"), F.col("m")).alias("std_score_rate"))


def pivot_runs(results: DataFrame, runs: list[str], keys: list[str], score: str = "earned_points", questions: DataFrame | None = None) -> DataFrame:
    """One row a question, one column a run; 0 where a run has no score. With the runs named, one aggregate makes it."""
    made = scored(results).groupBy(keys).pivot("run_id", runs).agg(F.max(score))
    if questions is not None:
        made = questions.select(keys).distinct().join(large(made), keys, "left")
    return made.na.fill(0.0, runs)


def first_run_questions(results: DataFrame, keys: list[str], run_order: str = "run_id") -> DataFrame:
    """The questions of the first run, each once (the last of repeated ids, Q19)."""
    first = results.groupBy(keys).agg(F.min(run_order).alias("first_run"))
    own = results.join(first, (F.col(run_order) == F.col("first_run")) & F.lit(True) if not keys else keys).filter(F.col(run_order) == F.col("first_run"))
    return own.groupBy(*keys, "question_id").agg(F.max_by("max_points", "idx").alias("max_points"))


def last_of_repeated(results: DataFrame, keys: list[str]) -> DataFrame:
    """Q19: of equal question ids in one run the last counts; `repeats` tells how many were there."""
    w = Window.partitionBy(*keys, "run_id", "question_id")
    return results.withColumn("__r", F.row_number().over(w.orderBy(F.col("idx").desc()))).withColumn("repeats", F.count("*").over(w)).filter("__r = 1").drop("__r")
