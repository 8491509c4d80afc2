"""Marking sets: a set's score within the limit (A12), and the best of several sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X

ATTEMPTS = 4


def within_limit(total: Column, most: Column) -> Column:
    """W6; no limit where the most is 0 (Q5)."""
    return (total <= most) | (most == 0)


def scale(scores: Column, total: Column, most: Column) -> Column:
    """Scores brought down in proportion, so that they sum up to the most."""
    return F.transform(scores, lambda s: s * (most / total))


def settle(attempts: DataFrame, keys: list[str], attempts_allowed: int = ATTEMPTS) -> DataFrame:
    """A12. attempts: keys, attempt (from 1), max_points, scores (array of double, in the order of criteria).

    The first attempt within the limit counts; if none is, the last is scaled. One row a set: score, scores, attempt, scale_factor.
    """
    summed = attempts.filter(F.col("attempt") <= attempts_allowed).withColumn("total", X.total(F.col("scores")))
    pick = F.min(F.struct((~within_limit(F.col("total"), F.col("max_points"))).alias("over"), F.when(within_limit(F.col("total"), F.col("max_points")), F.col("attempt")).otherwise(-F.col("attempt")).alias("o"), "attempt", "total", "max_points", "scores"))
    one = summed.groupBy(keys).agg(pick.alias("p")).select(*keys, "p.*")
    over = F.col("over")
    made = F.when(over, scale(F.col("scores"), F.col("total"), F.col("max_points"))).otherwise(F.col("scores"))
    return one.select(
        *keys, X.half_even(F.when(over, X.total(made)).otherwise(F.col("total"))).alias("score"), F.transform(made, lambda s: X.half_even(s)).alias("scores"), "attempt",
        F.when(over, X.half_even(F.col("max_points") / F.col("total"), 3)).alias("scale_factor"), (~over).alias("final_success"),
    )


def scaled_sums(scores: DataFrame, keys: list[str], most: Column) -> DataFrame:
    """A12 on one row a criterion: a set's total, and what it counts: itself, or the most where it is over. Partial sums only."""
    found = scores.groupBy(keys).agg(F.sum("score").alias("t"))
    counted = F.when(within_limit(F.col("t"), most), F.col("t")).otherwise(most)
    return found.select(*keys, X.half_even(F.col("t")).alias("raw_total"), X.half_even(counted).alias("score"), (~within_limit(F.col("t"), most)).alias("forced"))


def best_set(sets: DataFrame, keys: list[str], detail: str | None = None) -> DataFrame:
    """The set of the highest score, the first of equals; sets that are not above 0 never win (Q4), and 0 stands then."""
    wins = F.col("score") > 0
    pick = F.max(F.when(wins, F.struct("score", (-F.col("set_index")).alias("o"), *([detail] if detail else []))))
    one = sets.groupBy(keys).agg(pick.alias("p"))
    return one.select(*keys, F.coalesce("p.score", F.lit(0.0)).alias("score"), (-F.col("p.o") + 1).cast("long").alias("best_marking_set"), *([F.col(f"p.{detail}").alias(detail)] if detail else []))


def fine_score(has_marking: Column, judged: Column, score: Column) -> Column:
    """0 without marking or judge."""
    return F.when(has_marking & judged, F.coalesce(score, F.lit(0.0))).otherwise(0.0)
