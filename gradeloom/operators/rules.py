"""Consistency rules over the symbol graph, plugins, and what follows from their diagnostics.

A native rule is a Column builder over a parsed sample; it gives an array of diagnostics, evidence being JSON text. A user's rule
is a Python object with id, title, description and run(context, runtime), which runs in Arrow batches; one that raises is left
out for that sample, and the others go on.
"""

from __future__ import annotations

import importlib
import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gradeloom.functions import parse
from gradeloom.functions import symbols as S
from gradeloom.functions import text as X

GRAPH_RULE = "graph_consistency"
# The messages by which diagnostics are told apart.
SELF_REFERENCE = "公式存在自引用（左侧变量也出现在右侧），需确认是否合理。"
UNDEFINED = "符号被多次使用但未在等式左侧明确定义，可能需要给出定义或说明。"
CONFLICT = "同一符号在文本中由不同表达式定义，可能存在冲突或重载。"
PENALTIES = {"error": -1.0, "warning": -0.5}
MOST_USES, MOST_OCCURRENCES, MOST_VARIANTS = 5, 3, 5

log = logging.getLogger(__name__)


def _none() -> Column:
    return F.array().cast(f"array<{parse.DIAGNOSTIC}>")


def _diagnostic(severity: str, rule: str, symbol: Column, message: str, evidence: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), symbol.alias("symbol"), F.lit(message).alias("message"), F.to_json(evidence).alias("evidence"))


def _definitions(formulas: Column) -> Column:
    return F.filter(formulas, lambda f: S.defines(f["relation"]) & f["lhs"].isNotNull())


def self_reference(formulas: Column, rule: str = GRAPH_RULE, strict: bool = False) -> Column:
    """A definition of a symbol of the line that has other symbols too (Q8); strict: the symbol is on the right side indeed."""

    def fires(f: Column) -> Column:
        own = S.lhs_symbol(f["lhs"])
        loose = F.array_contains(f["symbols"], own) & (F.size(f["symbols"]) > 1)
        return F.coalesce(loose & F.array_contains(S.words(F.coalesce(f["rhs"], F.lit(""))), own) if strict else loose, F.lit(False))

    return F.transform(F.filter(_definitions(formulas), fires), lambda f: _diagnostic("warning", rule, S.lhs_symbol(f["lhs"]), SELF_REFERENCE, F.struct(f["raw"].alias("formula"), f["fid"].alias("fid"))))


def undefined_symbol(text: Column, symbols: Column, formulas: Column, rule: str = GRAPH_RULE) -> Column:
    """R2: a likely variable (W13) that no formula defines, in two formulas and on two lines at least."""
    names = F.array_union(symbols, F.flatten(F.transform(formulas, lambda f: f["symbols"])))
    likely = F.filter(names, lambda s: (F.length(s) <= 3) | F.contains(s, F.lit("_")))
    undefined = F.array_except(likely, F.transform(S.formula_definitions(formulas), lambda d: d["k"]))
    used = F.filter(S.formula_uses(formulas, undefined), lambda u: F.size(u["values"]) >= 2)

    def of(uses: Column) -> Column:
        # Lines are looked for only for the names that are left; both lists are in the order of those.
        both = F.zip_with(uses, S.contexts(text, F.transform(uses, lambda u: u["name"])), lambda u, c: F.struct(u.alias("u"), c.alias("c")))
        found = F.filter(both, lambda b: F.size(b["c"]["occurrences"]) >= 2)
        return F.transform(found, lambda b: _diagnostic("info", rule, b["u"]["name"], UNDEFINED, F.struct(F.slice(b["u"]["values"], 1, MOST_USES).alias("used_in"), F.slice(b["c"]["occurrences"], 1, MOST_OCCURRENCES).alias("occurrences"))))

    return X.let(used, lambda uses: F.when(F.size(uses) > 0, of(uses)).otherwise(_none()))


def conflicting_definition(formulas: Column, rule: str = GRAPH_RULE) -> Column:
    """One name (the left side itself where it has none) with two right sides at least."""
    known = F.filter(_definitions(formulas), lambda f: f["rhs"].isNotNull())
    pairs = F.array_distinct(F.transform(known, lambda f: F.struct(F.coalesce(S.lhs_symbol(f["lhs"]), f["lhs"]).alias("k"), f["rhs"].alias("v"))))
    grouped = X.let(pairs, lambda ps: F.transform(X.grouped(ps, F.array_distinct(F.transform(ps, lambda p: p["k"]))), lambda g: F.struct(g["name"].alias("name"), F.array_sort(g["values"]).alias("rhs"))))
    return F.transform(F.filter(grouped, lambda g: F.size(g["rhs"]) >= 2), lambda g: _diagnostic("warning", rule, g["name"], CONFLICT, F.struct(F.slice(g["rhs"], 1, MOST_VARIANTS).alias("rhs_variants"))))


def graph_consistency(text: Column, symbols: Column, formulas: Column) -> Column:
    """R1, R2 and R3 in this order, as one rule."""
    return F.concat(self_reference(formulas), undefined_symbol(text, symbols, formulas), conflicting_definition(formulas))


def dedupe(diagnostics: Column) -> Column:
    """The first of equal (rule, symbol, message), in order; later evidence goes (Q24)."""
    keyed = lambda d, i: F.struct(F.struct(d["rule"], d["symbol"], d["message"]).alias("key"), i.alias("i"))

    def of(all_: Column) -> Column:
        # Sorted by key, then place: what differs from the one before is the first of its key.
        firsts = lambda found: F.filter(found, lambda x, j: (j == 0) | ~F.get(found, j - 1)["key"].eqNullSafe(x["key"]))
        kept = X.let(F.array_sort(F.transform(all_, keyed)), lambda found: F.array_sort(F.transform(firsts(found), lambda x: x["i"])))
        return F.transform(kept, lambda i: F.get(all_, i))

    return X.let(diagnostics, of)


def dedupe_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """O4 on one row a diagnostic."""
    w = Window.partitionBy(*keys, "rule", "symbol", "message").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def penalty(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])[severity], F.lit(0.0))


def score(diagnostics: Column) -> Column:
    """What the diagnostics of a sample cost."""
    return F.aggregate(diagnostics, F.lit(0.0), lambda a, d: a + penalty(d["severity"]))


def summary(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Samples, total and mean of score; the mean of none is 0."""
    agg = [F.count("*").alias("num_samples"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total_score"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score")]
    return results.groupBy(keys).agg(*agg) if keys else results.agg(*agg)


# --- plugins


@dataclass
class Context:
    """What a user's rule gets to see of a sample."""

    sample_id: str | None
    dataset: str | None
    text_all: str
    symbols: list = field(default_factory=list)
    formulas: list = field(default_factory=list)
    precondition_cues: list = field(default_factory=list)


class Registry:
    """Rules by id."""

    def __init__(self):
        self._rules: dict[str, object] = {}

    def register(self, rule) -> None:
        self._rules[rule.id] = rule

    def get(self, rule_id: str):
        return self._rules.get(rule_id)

    def list_ids(self) -> list[str]:
        return sorted(self._rules)


def load_rule(spec: str):
    """A rule's class from 'module:Class' or 'module.Class' (F7)."""
    module, _, name = spec.partition(":") if ":" in spec else spec.rpartition(".")
    if not module or not name:
        raise ValueError(f"no module and class in {spec!r}")
    return getattr(importlib.import_module(module), name)


def load_rules(specs: Iterable[str], native: dict[str, Callable]) -> tuple[list[str], list[object]]:
    """Native rule ids and instances of users' rules; one that fails to load is logged and skipped."""
    ids, loaded = [], []
    for spec in specs:
        if spec in native:
            ids.append(spec)
            continue
        try:
            loaded.append(load_rule(spec)())
        except Exception as e:
            log.warning("rule %s is skipped: %s", spec, e)
    return ids, loaded


FAILURE = "struct<rule:string,error:string>"
NEEDED = ["text_all", "symbols", "formulas", "precondition_cues"]


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def _listed(value) -> list:
    return [] if value is None else list(value)


def said_by(rules: list[object], row, runtime: object, key: str = "id") -> Iterable[tuple[object, dict | None, str | None]]:
    """(rule, diagnostic, None) for each diagnostic of a sample, and (rule, None, error) for each rule that fails, rule by rule."""
    context = Context(row[key], row["dataset"] if "dataset" in row else None, row["text_all"], _listed(row["symbols"]), _listed(row["formulas"]), _listed(row["precondition_cues"]))
    for rule in rules:
        try:
            found = [d for d in rule.run(context, runtime) or [] if isinstance(d, dict)]
        except Exception as e:
            yield rule, None, f"{type(e).__name__}: {e}"
            continue
        for d in found:
            yield rule, d, None


def _said(rule: object, d: dict) -> dict:
    return {"severity": _text(d.get("severity")) or "info", "rule": _text(d.get("rule")) or rule.id, "symbol": _text(d.get("symbol")), "message": _text(d.get("message")) or "", "evidence": _text(d.get("evidence"))}


def run_plugins(samples: DataFrame, rules: list[object], runtime: object = None, key: str = "id") -> DataFrame:
    """samples (id, dataset, text_all, symbols, formulas, precondition_cues) with plugin_diagnostics, from the users' rules in order, and
    plugin_failures: which rule failed, and how (R12: the others go on)."""
    schema = T.StructType([*samples.schema.fields, *T.StructType.fromDDL(f"plugin_diagnostics array<{parse.DIAGNOSTIC}>, plugin_failures array<{FAILURE}>").fields])

    def step(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            told = [list(said_by(rules, r, runtime, key)) for r in frame.to_dict("records")]
            yield frame.assign(
                plugin_diagnostics=[[_said(rule, d) for rule, d, _ in t if d is not None] for t in told],
                plugin_failures=[[{"rule": str(getattr(rule, "id", rule)), "error": e} for rule, _, e in t if e is not None] for t in told],
            )

    return samples.mapInPandas(step, schema)


def diagnostic_rows(samples: DataFrame, rules: list[object], runtime: object = None, key: str = "id", outer: bool = False) -> DataFrame:
    """X4 as a table function: samples' columns with a row a diagnostic (severity, rule, symbol, message, evidence, rule_error).

    A rule that fails gives a row with rule_error and no severity. A rule may declare columns of its own, `columns = {name: type}`, which its
    diagnostics fill by name; the function's schema has those of all rules. With outer, samples without a diagnostic have a row of nulls.
    """
    own: dict[str, str] = {}
    for rule in rules:
        for name, kind in (getattr(rule, "columns", None) or {}).items():
            if own.setdefault(name, kind) != kind:
                raise ValueError(f"rules give column {name} different types")
    taken = {c.lower() for c in samples.columns}
    made = ["severity", "rule", "symbol", "message", "evidence", "rule_error", *own]
    if clash := [c for c in made if c.lower() in taken]:
        raise ValueError(f"samples have columns of the diagnostics' names: {', '.join(clash)}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in made[:6]), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in own.items())])

    class Diagnostics:
        @staticmethod
        def analyze(sample: AnalyzeArgument) -> AnalyzeResult:
            missing = [c for c in [key, *NEEDED] if c not in sample.dataType.fieldNames()]
            if missing:
                raise ValueError(f"a sample needs {', '.join(missing)}")
            return AnalyzeResult(schema)

        def eval(self, sample):
            none = outer
            for rule, d, error in said_by(rules, sample.asDict(), runtime, key):
                none = False
                if error is not None:
                    yield (None, str(getattr(rule, "id", rule)), None, None, None, error, *[None] * len(own))
                else:
                    yield (*_said(rule, d).values(), None, *(d.get(n) for n in own))
            if none:  # an outer lateral join makes no row of its own for a table function in Python
                yield (None,) * len(schema)

    names = list(dict.fromkeys([key, *NEEDED, *(["dataset"] if "dataset" in samples.columns else [])]))
    sample = F.struct(*[F.col(c).outer() for c in names])
    return samples.lateralJoin(F.udtf(Diagnostics)(sample))
