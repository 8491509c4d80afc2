"""Calls to a language model: client protocol, offline stub, cache, budget, and the judging of criteria.

Calls happen in one stage (operators/calls.py: a pool, time limits, retries, a journal); everything before and after is plain DataFrame
work. A reply that failed is kept with its error and never put in the cache (Q12).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import answers, parse
from gradeloom.operators import graph, marking
from gradeloom.operators.calls import JUDGE, VERIFIER, Policy, Refused
from gradeloom.operators.calls import call as call
from gradeloom.sources.staging import stage


class Client(Protocol):
    """Made in each task by a factory, so it need not be picklable; generate() is called from several threads."""

    def working(self) -> bool: ...

    def generate(self, prompt: str) -> str: ...


class NoClient:
    """The default; nothing is called."""

    def working(self) -> bool:
        return False

    def generate(self, prompt: str) -> str:
        raise Refused("no model is configured")


class ScriptedClient:
    """Replies by a function of the prompt; for tests and offline use."""

    def __init__(self, reply: Callable[[str], str]):
        self.reply = reply

    def working(self) -> bool:
        return True

    def generate(self, prompt: str) -> str:
        return self.reply(prompt)


def judge_wanted(name: str | None, key: str | None, working: bool) -> bool:
    """W18."""
    return bool(name) and name != "exact_matching" and bool(key) and working


def lookup(payloads: DataFrame, cache: DataFrame) -> DataFrame:
    """Payloads (namespace, key, ...) with the cached value, null where there is none."""
    return payloads.join(cache.select("namespace", "key", "value"), ["namespace", "key"], "left")


def budget_rank(missing: DataFrame, order: list[str]) -> DataFrame:
    """The rank of each distinct payload that is not cached, by a stable order.

    Ranks are global, so counts of ranges of the order's first column are summed up first and each range is ranked on its own.
    """
    spark = missing.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = missing.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    dealt = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").agg(F.max("__rank").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    return dealt.join(F.broadcast(sizes), "__part").withColumn("call_rank", (F.col("__before") + F.col("__rank")).cast("long")).drop("__part", "__rank", "__before")


def with_budget(missing: DataFrame, order: list[str], most_calls: int) -> DataFrame:
    """The payloads that may be called."""
    return budget_rank(missing, order).filter(F.col("call_rank") <= most_calls) if most_calls > 0 else missing.limit(0)


def answered(payloads: DataFrame, cache: DataFrame, factory: Callable[[], Client], order: list[str], most_calls: int, prompt: str = "prompt", policy: Policy = VERIFIER, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(payloads with value, new cache rows): from the cache, then by calls within the budget, once a distinct payload; the rest has null.

    The budget goes to distinct payloads by the first place of each in the order. Replies are staged, so both results tell of the
    same calls, and reading them again calls nothing (X2, W17).
    """
    found = lookup(payloads, cache)
    place = F.struct(*order)
    missing = found.filter(F.col("value").isNull()).groupBy("namespace", "key").agg(F.min(place).alias("place"))
    missing = missing.select("namespace", "key", *[F.col(f"place.{o}").alias(o) for o in order if o not in ("namespace", "key")])
    # Who is asked is settled without prompts; those are looked up for what is asked alone.
    chosen = stage(with_budget(missing, order, most_calls).select("namespace", "key"), "asked")
    asked = payloads.join(chosen, ["namespace", "key"]).groupBy("namespace", "key").agg(F.min_by(prompt, place).alias(prompt))
    called = stage(call(asked, factory, prompt, None, policy, journal, F.concat_ws("/", "namespace", "key")).select("namespace", "key", "reply", "call_error"), "replies")
    fresh = called.filter(F.col("call_error").isNull()).select("namespace", "key", F.to_json(parse.json_in_text(F.col("reply"))).alias("value")).filter(F.col("value").isNotNull())
    full = found.join(fresh.withColumnRenamed("value", "__new"), ["namespace", "key"], "left").withColumn("value", F.coalesce("value", "__new")).drop("__new")
    return full, fresh


# --- grading by criteria


def criterion_prompt(question: Column, prediction: Column, criterion: Column, most: Column, attempt: Column) -> Column:
    """What a judge is asked about one criterion; the answer is one boxed number."""
    limit = F.when(most > 0, F.format_string("\nTogether, all criteria of this problem give at most %s points; this is attempt %s.", most.cast("string"), attempt.cast("string"))).otherwise("")
    return F.concat(
        F.lit("Grade a solution against one criterion. Give full, part or no credit, as the criterion says, and be sparing.\n\nProblem:\n"), F.coalesce(question, F.lit("")),
        F.lit("\n\nSolution:\n"), F.coalesce(prediction, F.lit("")), F.lit("\n\nCriterion:\n"), criterion, limit, F.lit("\n\nReply with the score alone, as \\boxed{score}."),
    )


def judge_criteria(problems: DataFrame, factory: Callable[[], Client], attempts: int = 4, parallelism: int | None = None, policy: Policy = JUDGE, journal: str | None = None) -> DataFrame:
    """Fine scores of problems (problem_key, question, prediction, sets array<array<string>>, max_points).

    Each (problem, set, criterion) is judged on its own. All attempts of the sets that are over the limit run after one another;
    a set within the limit is not judged again. With a journal, a call is named by problem, set, criterion and attempt, so what was answered
    before a failure is not asked again. One row a set: problem_key, set_index, score, scores, attempt, scale_factor, details.
    """
    problems = problems if parallelism else graph.spread(problems)
    sets = problems.select("problem_key", "question", "prediction", "max_points", F.posexplode("sets").alias("set_index", "marks"))
    sets = sets.withColumn("criteria", parse.criteria(F.col("marks")))
    pending, tried = sets, None
    for attempt in range(1, attempts + 1):
        asked = pending.select("problem_key", "set_index", "max_points", "question", "prediction", F.explode_outer("criteria").alias("c"))
        asked = asked.withColumn("prompt", criterion_prompt(F.col("question"), F.col("prediction"), F.coalesce("c.description", F.lit("")), F.col("max_points"), F.lit(attempt)))
        named = F.to_json(F.struct("problem_key", "set_index", F.col("c.index").alias("criterion"), F.lit(attempt).alias("attempt"), F.sha2("prompt", 256).alias("prompt")))
        judged = call(asked.filter("c is not null"), factory, "prompt", parallelism, policy, journal, named)
        scored = judged.withColumn("score", F.when(F.col("call_error").isNull(), answers.score_in(F.col("reply"))).otherwise(0.0))
        listed = F.array_sort(F.collect_list(F.struct(F.col("c.index").alias("index"), F.col("c.description").alias("criterion"), "score", F.coalesce("reply", "call_error").alias("judge_response"))))
        done = scored.groupBy("problem_key", "set_index").agg(listed.alias("details"))
        done = pending.join(done, ["problem_key", "set_index"], "left").select("problem_key", "set_index", "max_points", F.lit(attempt).alias("attempt"), F.coalesce(F.transform("details", lambda d: d["score"]), F.array().cast("array<double>")).alias("scores"), "details")
        done = stage(done, "judged")  # no criterion is judged twice because a task is
        tried = done if tried is None else tried.unionByName(done)
        over = done.filter(~marking.within_limit(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), F.col("max_points"))).select("problem_key", "set_index")
        if attempt == attempts or over.isEmpty():
            break
        pending = pending.join(over, ["problem_key", "set_index"], "left_semi")
    settled = marking.settle(tried, ["problem_key", "set_index"], attempts)
    return settled.join(tried.select("problem_key", "set_index", "attempt", "details"), ["problem_key", "set_index", "attempt"])
