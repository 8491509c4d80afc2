"""Column functions that take answers out of a solution and match them with the gold answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import text as X

#: A decimal number (ASCII digits), and a boxed answer, which ends at the first closing brace.
NUMBER = r"[-+]?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"
BOXED = r"\\boxed\{([^}]+)\}"
DEFAULT_ANSWERS = 10


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def boxed(text: Column) -> Column:
    """All boxed answers that are not blank, stripped."""
    return F.filter(F.transform(_all(text, BOXED, 1), X.strip), lambda a: a != "")


def last_boxed(text: Column) -> Column:
    """The last boxed answer, stripped, or '' (F8)."""
    return F.coalesce(X.strip(F.try_element_at(_all(text, BOXED, 1), F.lit(-1))), F.lit(""))


def numbers(text: Column) -> Column:
    return _all(text, NUMBER)


def answers(text: Column, most: Column | int = DEFAULT_ANSWERS) -> Column:
    """The first answers: boxed ones, or else the numbers of the text."""
    most = F.lit(most) if isinstance(most, int) else most
    found = boxed(text)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(numbers(text)), F.lit(1), F.greatest(F.lit(1), most))


def first_number(text: Column) -> Column:
    """The first number of a text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), NUMBER, 0), F.lit("")).try_cast("double")


def matches(said: Column, gold: Column) -> Column:
    """Equal by the first numbers of both, within a thousandth (a millionth beside a gold 0); else equal as texts."""
    a, b = first_number(said), first_number(gold)
    near = F.when(b == 0, F.abs(a - b) < 1e-6).otherwise(F.abs(a - b) / (F.abs(b) + 1e-12) < 1e-3)
    return F.when(a.isNotNull() & b.isNotNull(), near).otherwise(X.normalise(said) == X.normalise(gold))


def _paired(gold: Column, points: Column) -> tuple[Column, Column]:
    """Both cut to the shorter; without points each answer is worth 1."""
    points = F.when(F.size(points) > 0, points).otherwise(F.transform(gold, lambda _: F.lit(1.0)))
    n = F.least(F.size(gold), F.size(points))
    return F.slice(gold, F.lit(1), n), F.slice(points, F.lit(1), n)


def hits(text: Column, gold: Column) -> Column:
    """For each gold answer, whether any of the text's answers matches it; one answer may serve several."""
    said = answers(text, F.when(F.size(gold) > 0, F.size(gold)).otherwise(F.lit(DEFAULT_ANSWERS)))
    return X.let(said, lambda all_said: F.transform(gold, lambda g: F.exists(all_said, lambda s: matches(s, g))))


def earned_any(text: Column, gold: Column, points: Column) -> Column:
    """The points of all gold answers that are hit."""
    cut, worth = _paired(gold, points)
    return X.total(F.zip_with(hits(text, cut), worth, lambda h, p: F.when(h, p).otherwise(0.0)))


def earned_in_place(text: Column, gold: Column, points: Column) -> Column:
    """The points of the gold answers that the answer at the same place matches, as far as all three lists go."""
    said = answers(text, F.greatest(F.lit(1), F.size(gold)))
    n = F.least(F.size(said), F.size(gold), F.size(points))
    pairs = F.arrays_zip(F.slice(said, F.lit(1), n).alias("s"), F.slice(gold, F.lit(1), n).alias("g"), F.slice(points, F.lit(1), n).alias("p"))
    return X.total(F.transform(pairs, lambda x: F.when(matches(x["s"], x["g"]), x["p"]).otherwise(0.0)))


def coarse(earned: Column, fine: Column, fallback: str = "fine") -> Column:
    """The earned points if positive, else the fine score, or 0 with fallback='zero' (F17, F18, W7, Q2)."""
    return X.half_even(F.when(earned > 0, earned).otherwise(fine if fallback == "fine" else F.lit(0.0)), 2)


def display(text: Column, most: Column | int = DEFAULT_ANSWERS) -> Column:
    """The answers on one line, for reports."""
    return F.array_join(F.filter(F.transform(answers(text, most), X.squeeze), lambda a: a != ""), ", ")


def shown_answers(said: Column) -> Column:
    """A display line as boxed answers again; none gives ['']."""
    parts = F.filter(F.transform(F.split(F.coalesce(said, F.lit("")), ", "), X.strip), lambda a: a != "")
    made = F.transform(parts, lambda a: F.concat(F.lit("\\boxed{"), a, F.lit("}")))
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.lit("")))


def plain_answers(made: Column) -> Column:
    """Boxed answers on one line without the boxes; every closing brace goes."""
    return F.replace(F.replace(F.array_join(made, ", "), F.lit("\\boxed{"), F.lit("")), F.lit("}"), F.lit(""))


def score_in(reply: Column) -> Column:
    """The score that a judge's reply gives (F20): boxed (the last that holds a number), named, before 'points', or the last number; else 0."""
    reply = X.strip(F.coalesce(reply, F.lit("")))

    def of_box(content: Column) -> Column:
        inner = F.try_element_at(F.regexp_extract_all(content, F.lit("[0-9]+[.]?[0-9]*"), F.lit(0)), F.lit(-1))
        return F.coalesce(X.number(content), inner.try_cast("double"))

    def in_boxes(pattern: str) -> Column:
        found = F.filter(F.transform(_all(reply, pattern, 1), lambda m: of_box(X.strip(m))), lambda x: x.isNotNull())
        return F.try_element_at(found, F.lit(-1))

    def last(pattern: str, group: int) -> Column:
        return F.try_element_at(_all(reply, pattern, group), F.lit(-1)).try_cast("double")

    found = F.coalesce(
        in_boxes(r"(?i)\\boxed\{([^}]+)\}"),
        in_boxes(r"(?i)boxed\{([^}]+)\}"),
        last(r"(?i)(?:score|final score|total|points?):\s*([0-9]*[.]?[0-9]+)", 1),
        last(r"(?i)([0-9]*[.]?[0-9]+)\s*(?:points?|pts?)", 1),
        last(r"[0-9]*[.]?[0-9]+", 0),
        F.lit(0.0),
    )
    return X.half_even(X.no_nan(found), 2)
