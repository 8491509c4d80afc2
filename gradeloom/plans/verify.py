"""The two verifiers over samples: by rules (R4-R9) and by a model alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import parse
from gradeloom.functions import symbols as S
from gradeloom.operators import graph, judge, rules
from gradeloom.sources.staging import stage

#: Rules that ask a model: id -> what it is to look for.
MODEL_RULES = {
    "var_const_consistency": "Are variables and constants kept apart? Look for a constant given several values, a variable used as a constant or the other way round, one symbol for several quantities, and units or meanings that change.",
    "formula_correctness": "Are the formulas right and applicable? Look for dimensions or units that do not agree, laws that are misused, and definitions that contradict each other.",
    "precondition_consistency": "Do formulas and approximations agree with the stated or implied assumptions, such as small angles, no air resistance, a steady or quasi-static state, or an ideal gas?",
}
NATIVE = {rules.GRAPH_RULE: lambda: rules.graph_consistency(F.col("text_all"), F.col("symbols"), F.col("formulas")), "strict_self_reference": lambda: rules.self_reference(F.col("formulas"), "strict_self_reference", strict=True)}
REPLY = "Reply with a JSON array of objects {severity: error|warning|info, rule, symbol, message, evidence}, and [] if nothing is wrong."


def prepared(samples: DataFrame) -> DataFrame:
    """Samples with text_all and what is parsed from it."""
    full = samples.withColumn("text_all", S.full_text(F.col("question"), F.col("context"), F.col("prediction")))
    return graph.parsed(full)


def rule_prompt(rule: Column, about: Column, inputs: Column) -> Column:
    return F.concat(F.lit("Check one rule, "), rule, F.lit(". "), about, F.lit(f"\n{REPLY}\nInputs:\n"), inputs)


def model_prompt(rule: str, inputs: Column) -> Column:
    return rule_prompt(F.lit(rule), F.lit(MODEL_RULES.get(rule, rule)), inputs)


def rule_inputs() -> Column:
    """What a model rule sees, as JSON."""
    return F.to_json(F.struct(F.col("text_all").alias("text"), "symbols", F.col("formulas").alias("formulas_structured"), "precondition_cues", S.symbol_stats(F.col("text_all"), F.col("symbols")).alias("sym_stats"), S.contexts(F.col("text_all"), F.col("symbols")).alias("snippets")))


def by_rules(samples: DataFrame, specs: list[str], cache: DataFrame, factory: Callable[[], judge.Client] = judge.NoClient, model: str = "", most_calls: int = 0, policy: judge.Policy = judge.VERIFIER, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one report row a sample, new cache rows). Rules run in the order given; unknown ones are logged and skipped,
    and the report's rule_failures tell of users' rules that raised.

    All rules that ask a model share one budget, which goes sample by sample and, within a sample, rule by rule (X3).
    """
    native, plugins = rules.load_rules(specs, NATIVE | MODEL_RULES)
    rows, fresh = prepared(samples), None
    asking = [(k, rule) for k, rule in enumerate(native) if rule not in NATIVE]
    if asking:
        place = [c for c in ("run_id", "idx") if c in rows.columns]
        order = ["dataset", *place, "id", "rule_no", "key"]
        keys = ["dataset", *place, "id", "text_key"]  # samples that share an id are told apart by their text
        parsed = ["text_all", "symbols", "formulas", "precondition_cues"]
        # Texts are parsed once, and a sample's inputs made once for all rules; what follows reads them.
        known = rows.select("dataset", *place, "id", F.sha2("text_all", 256).alias("text_key"), *parsed, rule_inputs().alias("inputs"))
        named = F.array(*[F.struct(F.lit(k).alias("rule_no"), parse.text_key(inputs=F.col("inputs"), model=F.lit(model), rule=F.lit(rule)).alias("key")) for k, rule in asking])
        known = stage(known.withColumn("named", named), "prepared")
        each = known.select(*keys, "inputs", F.explode("named").alias("r")).select(*keys, "inputs", "r.*")
        told = F.create_map(*[x for k, rule in asking for x in (F.lit(k), F.struct(F.lit(rule).alias("rule"), F.lit(MODEL_RULES.get(rule, rule)).alias("about")))])[F.col("rule_no")]
        asked = each.select(*keys, "rule_no", F.lit("rule").alias("namespace"), "key", rule_prompt(told["rule"], told["about"], F.col("inputs")).alias("prompt"))
        full, fresh = judge.answered(asked, cache, factory, order, most_calls, policy=policy, journal=journal)
        # Of the samples that have a reply alone: where they are few, no sample is shuffled for them.
        said = stage(full.filter("value is not null").groupBy(keys).agg(F.map_from_entries(F.collect_set(F.struct("rule_no", "value"))).alias("__said")), "said")
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
        rows = known.select(*keys, *parsed).join(said.withColumnsRenamed({c: f"__of_{c}" for c in keys}), same, "left").drop(*[f"__of_{c}" for c in keys])
    made = []
    for k, rule in enumerate(native):
        own = NATIVE[rule]() if rule in NATIVE else parse.diagnostics_in(F.try_parse_json(F.try_element_at("__said", F.lit(k))), F.lit(rule))
        rows = rows.withColumn(f"__d{k}", own)
        made.append(F.coalesce(F.col(f"__d{k}"), F.array().cast(f"array<{parse.DIAGNOSTIC}>")))
    if plugins:
        rows = rules.run_plugins(rows, plugins)
        made.append(F.col("plugin_diagnostics"))
    found = rules.dedupe(F.concat(*made)) if made else F.array().cast(f"array<{parse.DIAGNOSTIC}>")
    rows = rows.withColumn("diagnostics", found)
    failures = F.col("plugin_failures") if plugins else F.array().cast(f"array<{rules.FAILURE}>")
    report = rows.select("id", "dataset", "diagnostics", S.contexts(F.col("text_all"), F.col("symbols")).alias("symbol_nodes"), F.col("formulas").alias("formula_nodes"), "precondition_cues", rules.score(F.col("diagnostics")).alias("score"), failures.alias("rule_failures"))
    return report, fresh if fresh is not None else cache.limit(0)


def by_model(samples: DataFrame, cache: DataFrame, factory: Callable[[], judge.Client] = judge.NoClient, model: str = "", most_calls: int = 0, policy: judge.Policy = judge.VERIFIER, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One call a sample; without a model there are no diagnostics. The reply is {diagnostics: [...], symbols: {...}}."""
    full_text = S.full_text(F.col("question"), F.col("context"), F.col("prediction"))
    place = [c for c in ("run_id", "idx") if c in samples.columns]
    rows = samples.withColumn("text_all", full_text).withColumns({"symbols": S.plain_symbols(F.col("text_all")), "formulas": S.plain_formula_lines(F.col("text_all"))})
    inputs = F.to_json(F.struct(F.col("text_all").alias("text"), "symbols", "formulas"))
    asked = rows.select("dataset", *place, "id", "symbols", F.lit("var_const").alias("namespace"), parse.cache_key(inputs.alias("inputs"), F.lit(model).alias("model")).alias("key"), model_prompt("var_const_consistency", inputs).alias("prompt"))
    full, fresh = judge.answered(asked, cache, factory, ["dataset", *place, "id", "key"], most_calls, policy=policy, journal=journal)
    value = F.try_parse_json("value")
    said = F.coalesce(F.try_variant_get(value, "$.diagnostics", "variant"), value)
    told = F.transform_values(F.coalesce(F.try_variant_get(value, "$.symbols", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, v: parse.variant_text(v))
    own = F.map_from_entries(F.transform("symbols", lambda s: F.struct(s, F.lit(None).cast("string"))))
    nodes = F.map_zip_with(own, told, lambda _, a, b: F.coalesce(b, a))
    found = rules.dedupe(parse.diagnostics_in(said, F.lit("var_const_consistency")))
    report = full.select("id", "dataset", found.alias("diagnostics"), nodes.alias("symbol_nodes"))
    return report.withColumn("score", rules.score(F.col("diagnostics"))), fresh
