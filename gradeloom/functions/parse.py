"""Column functions for fields that hold a value, a list, or a list as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import text as X


def _is_list(s: Column) -> Column:
    return s.startswith("[") & s.endswith("]") & (F.length(s) >= 2)


def json_field(value: Column) -> Column:
    """Text to list (F1): null, '' and 'nan' give none; JSON lists are parsed; what is not valid is one item."""
    s = X.strip(value)
    none = F.array().cast("array<string>")
    return F.when(value.isNull() | (value == ""), none).when(_is_list(s), F.coalesce(F.from_json(s, "array<string>"), F.array(s))).when(s == "nan", none).otherwise(F.array(s))


def points_field(value: Column) -> Column:
    """Text to points (F2): lists lose their nulls; what is no number is [0.0]."""
    s = X.strip(value)
    zero = F.array(F.lit(0.0))
    parsed = F.from_json(s, "array<string>")
    numbers = F.transform(F.filter(parsed, lambda x: x.isNotNull()), X.number)
    valid = parsed.isNotNull() & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(value.isNull(), zero).when(_is_list(s) & valid, numbers).otherwise(F.array(F.coalesce(X.number(s), F.lit(0.0))))


def variant_kind(v: Column) -> Column:
    """'ARRAY', 'OBJECT', 'STRING', ... ; null for null and JSON null (W4 looks at the kind before any cast)."""
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.regexp_extract(kind, r"^([A-Z]+)", 1))


def variant_text(v: Column) -> Column:
    """A variant as text: strings as they are, others as JSON; null and JSON null give null."""
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def variant_list(v: Column) -> Column:
    """A variant field to list: arrays item by item, other values by json_field()."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), variant_text)
    return F.when(variant_kind(v) == "ARRAY", F.filter(items, lambda x: x.isNotNull())).otherwise(json_field(F.nullif(variant_text(v), F.lit("NaN"))))


def variant_points(v: Column) -> Column:
    """A variant field to points: arrays lose their nulls, other values by points_field(); an item that is no number makes it null."""
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), variant_text), lambda x: x.isNotNull())
    numbers = F.transform(items, X.number)
    return F.when(variant_kind(v) == "ARRAY", F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)).otherwise(points_field(F.nullif(variant_text(v), F.lit("NaN"))))


#: Texts that stand for no criterion.
EMPTY_MARKS = ["", "nan", "none", "null"]


def valid_marking(marking: Column) -> Column:
    """A list of criteria (strings) has one that says something."""
    named = F.exists(marking, lambda m: m.isNotNull() & ~F.lower(X.strip(m)).isin(EMPTY_MARKS))
    return F.coalesce(named, F.lit(False))


def valid_marking_variant(v: Column) -> Column:
    """As valid_marking, for lists of strings, of lists, or of anything else."""
    items = F.try_variant_get(v, "$", "array<variant>")
    kind = variant_kind

    def says(m: Column) -> Column:
        return F.when(kind(m) == "ARRAY", F.size(F.try_variant_get(m, "$", "array<variant>")) > 0).when(kind(m) == "STRING", ~F.lower(X.strip(variant_text(m))).isin(EMPTY_MARKS)).otherwise(kind(m).isNotNull())

    return F.coalesce((kind(v) == "ARRAY") & F.exists(items, says), F.lit(False))


def marking_sets(v: Column) -> Column:
    """Criteria as a list of sets: a flat list is one set; a string among sets is a set of one criterion."""
    items = F.try_variant_get(v, "$", "array<variant>")
    several = F.coalesce(variant_kind(F.try_element_at(items, F.lit(1))) == "ARRAY", F.lit(False))
    each = F.transform(items, lambda m: F.when(variant_kind(m) == "ARRAY", F.transform(F.try_variant_get(m, "$", "array<variant>"), variant_text)).otherwise(F.array(variant_text(m))))
    flat = F.array(variant_list(v))
    return F.when(several, each).when(F.size(variant_list(v)) > 0, flat).otherwise(F.array().cast("array<array<string>>"))


def criteria(marks: Column) -> Column:
    """Criteria that are not blank, stripped, with their place from 0."""
    numbered = F.transform(marks, lambda c, i: F.struct(X.strip(c).alias("description"), i.alias("index")))
    return F.filter(numbered, lambda c: c["description"].isNotNull() & (c["description"] != ""))


def json_in_text(reply: Column) -> Column:
    """The JSON value in a model's reply: the whole text, or else its widest {...} or [...]."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(F.nullif(inner, F.lit(""))))


#: How grave a diagnostic can be.
SEVERITIES = ["error", "warning", "info"]
DIAGNOSTIC = "struct<severity:string,rule:string,symbol:string,message:string,evidence:string>"


def diagnostics_in(v: Column, rule: Column) -> Column:
    """A reply's list of objects as diagnostics of that rule (F5, W15, W16): no list gives none, other items go."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda d: variant_kind(d) == "OBJECT")
    field = lambda d, name: variant_text(F.try_variant_get(d, f"$.{name}", "variant"))

    def one(d: Column) -> Column:
        severity = F.lower(field(d, "severity"))
        return F.struct(F.when(severity.isin(SEVERITIES), severity).otherwise("info").alias("severity"), rule.alias("rule"), field(d, "symbol").alias("symbol"), F.coalesce(F.nullif(field(d, "message"), F.lit("")), field(d, "detail"), F.lit("")).alias("message"), field(d, "evidence").alias("evidence"))

    return F.coalesce(F.when(variant_kind(v) == "ARRAY", F.transform(items, one)), F.array().cast(f"array<{DIAGNOSTIC}>"))


def cache_key(*payload: Column) -> Column:
    """sha256 of the payload as JSON with sorted keys."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(F.struct(*payload)))), 256)


def text_key(**payload: Column) -> Column:
    """cache_key() of texts that are not null: these are written as they are, and need no parsing to be sorted by name."""
    return F.sha2(F.to_json(F.struct(*[payload[name].alias(name) for name in sorted(payload)])), 256)


def first_said(*values: Column) -> Column:
    """The first that is neither null nor empty (P5)."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
