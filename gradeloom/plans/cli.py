"""Command line: python -m gradeloom --help."""

from __future__ import annotations

import argparse
import dataclasses
import functools
import importlib
import inspect
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import catalog, judge, rules
from gradeloom.plans import evaluate, repair, verify
from gradeloom.sources import inference, sinks, staging, store

log = logging.getLogger(__name__)
#: The folder that paths are looked for in where the working folder has none.
HOME = str(Path(__file__).resolve().parents[2])
KEY_NAME = "OPENAI_API_KEY"
CHECKS = ("varconst", "rules")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gradeloom")
    p.add_argument("--results-dir", default="results_reasoning")
    p.add_argument("--dataset", help="<dataset>/<model>; all that wait, if left out")
    p.add_argument("--datasets", default="", help="comma-separated list for the catalog")
    p.add_argument("--models", default="", help="comma-separated list for the catalog")
    p.add_argument("--nproc", type=int, default=8, help="tasks that call the judge at once")
    p.add_argument("--judge-workers", type=int, default=judge.JUDGE.workers, help="calls at once in each of them")
    p.add_argument("--judge-timeout", type=float, default=judge.JUDGE.timeout)
    p.add_argument("--judge-retries", type=int, default=judge.JUDGE.retries)
    p.add_argument("--judge-model", help="module:factory of a judge client")
    p.add_argument("--api-key", help=f"the judge's key, if not {KEY_NAME} of the environment or of .env")
    p.add_argument("--no-judge", action="store_true")
    p.add_argument("--multi-runs", action="store_true")
    p.add_argument("--output-dir", default="evaluation")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--log-dir", default="logs")
    p.add_argument("--repair-statistics", metavar="FOLDER", help="recompute the multi-run statistics below a folder into a new version, and nothing else")
    for name in CHECKS:
        p.add_argument(f"--{name}-check", action="store_true")
        p.add_argument(f"--{name}-llm-model", help="module:factory of a client")
        p.add_argument(f"--{name}-max-llm-calls", type=int, default=0)
    p.add_argument("--rules", default="var_const_consistency")
    return p.parse_args(argv)


def client(spec: str | None, key: str | None = None) -> Callable[[], judge.Client] | None:
    """The factory that module:factory names; one that takes a key gets it."""
    if not spec:
        return None
    module, _, name = spec.partition(":")
    factory = getattr(importlib.import_module(module), name)
    return functools.partial(factory, key=key) if "key" in inspect.signature(factory).parameters else factory


def judge_of(args: argparse.Namespace, key: str | None) -> Callable[[], judge.Client] | None:
    """The judge's factory, or None where no judge is wanted, has a key, or works."""
    if args.no_judge or not args.judge_model:
        log.info("no judge: fine scores are 0")
        return None
    factory = None if args.judge_model == "exact_matching" else client(args.judge_model, key)
    if judge.judge_wanted(args.judge_model, key, bool(factory) and factory().working()):
        return factory
    log.warning("judge %s is not used: it has no key or does not work; fine scores are 0", args.judge_model)
    return None


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def check(args: argparse.Namespace, kind: str, samples: DataFrame, key: str | None, base: str, run: str | None = None) -> None:
    """The full and the light report of a check, and new replies for its cache."""
    spark = samples.sparkSession
    model = getattr(args, f"{kind}_llm_model") or ""
    factory, most = client(model, key) or judge.NoClient, getattr(args, f"{kind}_max_llm_calls")
    path = f"{args.output_dir}/{kind}_cache"
    cache = inference.read_cache(spark, path)
    if kind == "rules":
        report, fresh = verify.by_rules(samples, names(args.rules), cache, factory, model, most, journal=f"{path}_journal")
        tag = f"rules({'-'.join(names(args.rules)).replace(':', '.') or 'default'})"
    else:
        report, fresh = verify.by_model(samples, cache, factory, model, most, journal=f"{path}_journal")
        tag = kind
    report = staging.stage(report, "report")
    if kind == "rules":
        for r in report.select(F.explode("rule_failures.rule").alias("rule")).groupBy("rule").count().collect():
            log.warning("rule %s failed on %s samples", r["rule"], r["count"])
    summary = F.lit(rules.summary(report).toJSON().first())
    folder, name = f"{args.output_dir}/{kind}_reports", "__".join([base, *([run] if run else []), tag])
    sinks.write_table(report.withColumn("summary", summary), sinks.versioned(folder, f"{name}_full"), "json")
    sinks.write_table(sinks.light(report).withColumn("summary", summary), sinks.versioned(folder, f"{name}_light"), "json")
    sinks.append_cache(fresh, path)
    store.delete(spark, f"{path}_journal")  # what it held is in the cache and in the reports
    log.info("%s of %s: %s", kind, name, rules.summary(report).first())


def checks(args: argparse.Namespace, engine: evaluate.Engine, dataset: str, model: str, key: str | None) -> None:
    """The checks that are asked for, of the newest run or, with --multi-runs, of each."""
    wanted = [kind for kind in CHECKS if getattr(args, f"{kind}_check")]
    if not wanted:
        return
    files = engine.files(dataset, model).filter("readable")
    if not args.multi_runs:
        files = inference.newest(files, ["dataset", "model"])
    samples = inference.samples(files)
    for run in sorted(r[0] for r in files.select("run_id").distinct().collect()) if args.multi_runs else [None]:
        for kind in wanted:
            check(args, kind, samples.filter(F.col("run_id") == run) if run else samples, key, f"{dataset}_{model}", run)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    sinks.log_to(args.log_dir, args.dataset)
    log.setLevel(logging.DEBUG if args.verbose else logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    if args.repair_statistics:
        for path in repair.write(spark, args.repair_statistics).values():
            log.info("written: %s", path)
        return 0
    if "://" not in args.results_dir:
        try:
            args.results_dir = inference.anchored(args.results_dir, HOME)
        except FileNotFoundError:
            log.error("no folder %s", args.results_dir)
            return 1
    key = args.api_key or inference.settings(".env").get(KEY_NAME)
    policy = dataclasses.replace(judge.JUDGE, timeout=args.judge_timeout, retries=args.judge_retries, workers=args.judge_workers)
    engine = evaluate.Engine(spark, args.results_dir, args.output_dir, None if args.dry_run else judge_of(args, key), args.nproc, policy, f"{args.output_dir}/judge_journal", args.verbose)
    files = engine.files()
    if args.dataset:
        dataset, _, model = args.dataset.partition("/")
        pairs = spark.createDataFrame([(dataset, model)], "dataset string, model string")
    else:
        known = catalog.listed(spark, names(args.datasets), names(args.models)) if args.datasets else catalog.found(files)
        if args.multi_runs:
            known = known.join(catalog.multi_run(files), ["dataset", "model"], "left_semi")
        pairs = catalog.pending(known, catalog.found(files), engine.evaluated())
    pairs = staging.stage(pairs.select("dataset", "model"), "pairs")
    listed = [(r["dataset"], r["model"]) for r in pairs.orderBy("dataset", "model").collect()]
    if args.dry_run:
        for pair in listed:
            print("/".join(pair))
        return 0
    failed, done = 0, []
    if args.multi_runs and listed:
        found, told = engine.multi_run_pairs(pairs)
        engine.save_multi_run(found)
        for r in told.orderBy("dataset", "model").collect():
            if r["error"]:
                failed += 1
                log.error("%s/%s: %s", r["dataset"], r["model"], r["error"])
            else:
                done.append((r["dataset"], r["model"]))
        if done:
            engine.save_multi_run_summary(found["overall"])
    elif listed:
        results, totals = engine.evaluate_pairs(pairs)
        engine.save(results, totals)
        for r in totals.orderBy("dataset", "model").collect():
            log.info("%s/%s: %s", r["dataset"], r["model"], r["error"] or f"{r['total_score']} of {r['max_possible_score']} ({r['score_rate']} %)")
            if r["error"]:
                failed += 1
            else:
                done.append((r["dataset"], r["model"]))
        if not args.dataset:
            engine.save_summary(totals)
    if engine.journal and not failed:
        store.delete(spark, engine.journal)
    for dataset, model in done:
        try:
            checks(args, engine, dataset, model, key)
        except Exception as e:
            failed += 1
            log.exception("checks of %s/%s failed: %s", dataset, model, e)
    staging.drop_staged(spark)
    return int(failed > 0)
