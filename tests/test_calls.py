"""The call stage under clients that hang, fail, refuse and die: replies, errors, and exact counts of calls."""

import collections
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import calls, judge
from gradeloom.plans import evaluate
from gradeloom.sources import inference

QUICK = calls.Policy(timeout=0.4, retries=2, wait=0.01, workers=4)


class Trouble:
    """Counts its calls in files, one a call; prompts tell what goes wrong."""

    def __init__(self, folder):
        self.folder = folder

    def working(self):
        return True

    def generate(self, prompt):
        n = len([x for x in os.listdir(self.folder) if x.startswith(f"{prompt}.")])
        open(os.path.join(self.folder, f"{prompt}.{n}.{threading.get_ident()}.{time.time_ns()}"), "w").close()
        if prompt.startswith("hang"):
            time.sleep(3)
        if prompt.startswith("twice") and n < 2 or prompt.startswith("never"):
            raise ValueError(f"no {prompt}")
        if prompt.startswith("refuse"):
            raise calls.Refused("not allowed")
        if prompt.startswith("die") and n == 0:
            time.sleep(0.2)
            raise SystemExit("killed")
        return 7 if prompt.startswith("number") else f"  {prompt}!\n"


def counted(folder):
    return collections.Counter(x.split(".")[0] for x in os.listdir(folder))


def ask(spark, prompts, folder, **options):
    table = spark.createDataFrame([(k, p) for k, p in enumerate(prompts)], "k int, prompt string").coalesce(1)
    return calls.call(table, lambda: Trouble(str(folder)), policy=options.pop("policy", QUICK), **options)


def test_failures_and_retries(spark, tmp_path):
    prompts = ["fine", "hang", "twice", "never", "refuse", "number", "other"]
    got = {r.prompt: (r.reply, r.call_error) for r in ask(spark, prompts, tmp_path).orderBy("k").collect()}
    assert got == {"fine": ("fine!", None), "hang": (None, "no reply within 0.4 seconds"), "twice": ("twice!", None), "never": (None, "no never"), "refuse": (None, "not allowed"), "number": (None, "the reply is no text"), "other": ("other!", None)}
    assert counted(tmp_path) == {"fine": 1, "hang": 3, "twice": 3, "never": 3, "refuse": 1, "number": 3, "other": 1}


def test_a_task_that_dies_asks_nothing_twice(spark, tmp_path):
    told, journal = tmp_path / "told", str(tmp_path / "journal")
    told.mkdir()
    prompts = [f"p{k}" for k in range(8)] + ["die"] + [f"q{k}" for k in range(8)]
    with pytest.raises(Exception, match="killed|SystemExit"):
        ask(spark, prompts, told, journal=journal).collect()
    before = counted(told)
    assert before["die"] == 1 and before["p0"] == 1
    got = ask(spark, prompts, told, journal=journal).orderBy("k").collect()
    assert [r.reply for r in got] == [f"{p}!" for p in prompts]
    after = counted(told)
    # A call that was under way when the task died may have had no time to be written down.
    assert after["die"] == 2 and all(after[p] == 1 for p in prompts[:4]) and sum(after.values()) <= len(prompts) + QUICK.workers
    ask(spark, prompts, told, journal=journal).collect()
    assert counted(told) == after


def test_pool_is_bounded_and_in_order():
    going, most, lock = [0], [0], threading.Lock()

    def slow(prompt):
        with lock:
            going[0] += 1
            most[0] = max(most[0], going[0])
        time.sleep(0.02 if int(prompt) % 3 else 0.06)
        with lock:
            going[0] -= 1
        return prompt

    pool = calls.Pool(slow, calls.Policy(workers=5))
    asked = iter(range(60))
    began = time.monotonic()
    got = [r for r, _ in pool.map((None, str(k)) for k in asked)]
    assert got == [str(k) for k in range(60)] and most[0] == 5 and time.monotonic() - began < 1.5
    stuck = calls.Pool(lambda p: time.sleep(2), calls.Policy(timeout=0.01, retries=0, workers=2, left_behind=3))
    with pytest.raises(RuntimeError, match="more than 3"):
        list(stuck.map((None, str(k)) for k in range(9)))


def test_journal_files(tmp_path):
    journal = calls.Journal(str(tmp_path / "j x"))
    assert journal.get("a") is None
    journal.put("a", "é\n")
    journal.put("a", "é\n")
    assert journal.get("a") == "é\n" and len(list((tmp_path / "j x").rglob("*.json"))) == 1 and not list(tmp_path.rglob("*.writing"))


def test_judge_with_a_journal(spark, tmp_path):
    """Each criterion of each attempt is a call of its own; an evaluation that is made again from a journal asks nothing."""
    (tmp_path / "in/D/M").mkdir(parents=True)
    (tmp_path / "in/D/M/r.json").write_text('[{"id": 1, "prediction": "x", "answer": "1", "points": 1, "marking": [["a", "b"]]}]')
    told = tmp_path / "told"
    told.mkdir()

    class Judge(Trouble):
        def generate(self, prompt):
            open(os.path.join(self.folder, f"{time.time_ns()}.{threading.get_ident()}"), "w").close()
            return "\\boxed{0.75}"

    engine = evaluate.Engine(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda: Judge(str(told)), 2, QUICK, str(tmp_path / "journal"))
    for _ in range(2):
        results, _totals = engine.evaluate("D", "M")
        assert results.first().fine_grained_score == 1.0 and len(os.listdir(told)) == 8  # two criteria, four attempts
    cache = inference.read_cache(spark, None)
    payloads = spark.createDataFrame([("n", f"k{k}", f"p{k}") for k in range(5)], "namespace string, key string, prompt string")
    for _ in range(2):
        full, fresh = judge.answered(payloads, cache, lambda: judge.ScriptedClient(lambda p: "[1]"), ["key"], 9, journal=str(tmp_path / "verifier"))
        assert fresh.count() == 5 and full.filter(F.col("value").isNull()).count() == 0
