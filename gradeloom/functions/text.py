"""Column functions on text and numbers that the rest builds on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values, kind: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once a row: what a lambda merely mentions is worked out at each of its calls."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def grouped(pairs: Column, names: Column) -> Column:
    """For each of names (distinct, not null), in their order: struct<name, values> with the values of its pairs (k, v), in their order.

    One sort of the pairs with the names among them, so a row costs n log n and not names x pairs.
    """
    return let(pairs, lambda known: _grouped(known, names))


def _grouped(pairs: Column, names: Column) -> Column:
    marks = F.transform(names, lambda n, i: F.struct(n.alias("k"), F.lit(-1).alias("o"), i.alias("place"), F.get(F.transform(F.filter(pairs, lambda p: F.lit(False)), lambda p: p["v"]), F.lit(0)).alias("v")))
    own = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("o"), F.lit(None).cast("int").alias("place"), p["v"].alias("v")))

    def cut(found: Column, heads: Column) -> Column:
        end = lambda j: F.coalesce(F.get(heads, j + 1), F.size(found))
        inside = lambda h, j: F.filter(F.slice(found, h + 2, end(j) - h - 1), lambda p: p["k"] == F.get(found, h)["k"])
        groups = F.transform(heads, lambda h, j: F.struct(F.get(found, h)["place"].alias("place"), F.get(found, h)["k"].alias("name"), F.transform(inside(h, j), lambda p: p["v"]).alias("values")))
        return F.transform(F.array_sort(groups), lambda g: F.struct(g["name"].alias("name"), g["values"].alias("values")))

    heads = lambda found: F.filter(F.transform(found, lambda x, i: F.when(x["o"] < 0, i)), lambda i: i.isNotNull())
    return let(F.array_sort(F.concat(marks, own)), lambda found: let(heads(found), lambda at: cut(found, at)))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end; Spark's trim takes spaces alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Stripped, with each run of white space turned into one space."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def normalise(text: Column) -> Column:
    """What two texts are compared by: squeezed and lower-cased; null is empty."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounds to the nearest multiple of 10**-digits, ties to even, as numpy does; NaN and null pass through."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def rate(part: Column, whole: Column) -> Column:
    """Percent, rounded to 2 digits; 0 where the whole is not positive."""
    return F.when(whole > 0, half_even(part / whole * 100, 2)).otherwise(F.lit(0.0))


def no_nan(x: Column) -> Column:
    """A NaN score counts as 0 (Q18)."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def number(text: Column) -> Column:
    """The text as a double if all of it is one decimal number, else null."""
    plain = strip(text).rlike(r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$")
    return F.when(plain, strip(text).try_cast("double"))


def lines(text: Column) -> Column:
    """The lines of a text; a break at the end opens no further line."""
    found = F.split(F.coalesce(text, F.lit("")), r"\R|[\x1c-\x1e]", -1)
    return let(found, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def shorten(text: Column, most: int = 100) -> Column:
    """At most so many characters, with dots where some are left out."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def total(values: Column) -> Column:
    """The sum of an array of doubles, in its order."""
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def run_name(path: Column) -> Column:
    """The run's name from its file's path (P10)."""
    return F.regexp_extract(path, r"([^/]+)\.json$", 1)
