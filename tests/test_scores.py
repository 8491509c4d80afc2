"""Sums rounded after each addition as composed steps, and exact medians by selection, at many sizes of ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import scores

RESULT = "dataset string, run_id string, idx int, question_id string, fine_grained_score double, coarse_grained_score double, earned_points double, max_points double, error string"


def cents(x):
    return round(x * 100) / 100  # Python rounds halves to even


@pytest.mark.parametrize("partitions,groups", [(2, 1), (7, 1), (16, 3)])
def test_halves_of_a_large_group(spark, partitions, groups):
    """A group that reaches over all ranges, most of its scores half-way between two cents."""
    rng = random.Random(partitions)
    rows, want = [], {}
    for g in range(groups):
        total = [0.0, 0.0, 0.0]
        for k in range(1500):
            x = [rng.choice([0.005, 0.015, 1.125, 2.375, 0.285, 0.295, -0.005, 3.3333, 0.25]), rng.randrange(2000) / 200, rng.randrange(3) * 0.005]
            failed = "failed" if rng.random() < 0.05 else None
            rows.append((None if g == 2 else f"d{g}", "r", k, f"q{k}", *x, 9.0, failed))
            if not failed:
                total = [cents(t + v) for t, v in zip(total, x, strict=True)]
        want[None if g == 2 else f"d{g}"] = tuple(total)
    rows.append(("plain", "r", 0, "q", 1.25, 1.0, 1.0, 9.0, None))
    want["plain"] = (1.25, 1.0, 1.0)
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = scores.dataset_score(spark.createDataFrame(rows, RESULT).repartition(5), ["dataset", "run_id"])
        got = {r.dataset: (r.fine_grained_total_score, r.coarse_grained_total_score, r.total_score) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_without_halves_one_aggregate_does(spark):
    rows = [("d", "r", k, "q", 0.25, 1.0, 1.0, 2.0, None) for k in range(9)]
    found = scores.dataset_score(spark.createDataFrame(rows, RESULT), ["dataset"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and "Join" not in plan and found.first().total_score == 9.0


@pytest.mark.parametrize("ordered,ranges", [(1, 2), (3, 4), (10, 1024), (100_000, 1024)])
def test_medians(spark, ordered, ranges):
    rng = random.Random(ordered)
    groups = {
        "odd": [rng.random() for _ in range(101)], "even": [rng.randrange(10) / 4 for _ in range(100)], "one": [2.5], "two": [1.0, 4.0], "same": [3.0] * 50,
        "halves": [1.0] * 20 + [9.0] * 20, "far": [10.0**k for k in range(-200, 200)], "hot": [7.0] * 200 + [rng.random() * 14 for _ in range(99)], None: [-1.0, -2.5, 0.0, -0.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None), ("none", None)]
    found = scores.medians(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", ordered, ranges)
    got = {r.g: r["median"] for r in found.collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(statistics.median(vs), rel=1e-12), g


def test_pooled_stats_have_no_percentile(spark):
    rows = [("d", "r", k, "q", 1.0, 1.0, k / 2, 2.0, None) for k in range(4)] + [("e", "r", 0, "q", None, None, None, 2.0, "failed")]
    found = scores.pooled_stats(spark.createDataFrame(rows, RESULT), ["dataset"])
    assert [tuple(r) for r in found.collect()] == [("d", 4, 0.75, 0.559, 0.0, 1.5, 0.75)]
    plan = found._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan
    assert scores.pooled_stats(spark.createDataFrame([], RESULT), ["dataset"]).agg(F.count("*")).first()[0] == 0
