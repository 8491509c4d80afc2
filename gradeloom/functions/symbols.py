"""Column functions that read symbols, formulas and cues from a solution's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import text as X

TOKEN = r"[a-zA-Z][a-zA-Z0-9_]*"
WORD = r"[A-Za-z0-9_]+"

# The words that decide whether a token is a symbol.
UNITS = ["m", "s", "kg", "A", "K", "mol", "cd", "N", "Pa", "J", "W", "C", "V", "F", "Ω", "ohm", "S", "H", "Hz", "T", "lm", "lx", "Bq", "Gy", "Sv", "Wb", "mm", "cm", "dm", "km", "ms", "us", "μs", "ns", "deg", "rad", "sr", "eV", "MeV", "GeV", "keV", "u", "L", "ml", "mL", "bar", "atm"]
LATEX_WORDS = ["frac", "dfrac", "tfrac", "cfrac", "sqrt", "text", "mathrm", "mathbf", "mathit", "mathbb", "operatorname", "cdot", "times", "left", "right", "begin", "end", "over", "hat", "bar", "dot", "ddot", "vec", "cal", "partial", "nabla", "sum", "int", "lim", "log", "ln", "sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "exp", "min", "max", "arg", "det", "Tr", "trace", "sgn", "deg", "infty", "infin"]
STOP_WORDS = ["the", "of", "to", "in", "for", "and", "is", "we", "this", "that", "with", "on", "by", "as", "be", "are", "or", "an", "at", "from", "it", "our", "can", "will", "not", "have", "has", "but", "if", "then", "else", "than", "which", "these", "those", "their", "its", "into", "using", "use", "problem", "solution", "thus", "hence", "therefore", "let", "consider", "assume", "since", "because", "also", "so", "such", "where", "when", "while", "between", "within", "about", "approx", "approximate", "approximately", "given", "known", "unknown", "constant", "planck", "mass", "electron", "proton"]
QUANTITIES = ["g", "c", "h", "k", "G", "m", "M", "q", "e", "k_B", "R", "T", "P", "V", "E", "U", "F", "v", "u", "t"]
ANSWER_WORDS = ["final", "answer", "boxed", "ans", "unit", "units"]
CUES = ["小角近似", "忽略空气阻力", "忽略摩擦", "理想气体", "稳态", "准静态", "绝热", "等温", "非相对论", "低速近似", "小振幅", "small angle", "neglect air resistance", "ignore friction", "ideal gas", "steady state", "quasi-static", "adiabatic", "isothermal", "non-relativistic", "low speed", "small amplitude"]

FORMULA = "struct<fid:string,raw:string,relation:string,lhs:string,rhs:string,symbols:array<string>,line_index:int>"


def tokens(text: Column) -> Column:
    """All symbol-like tokens, repeats kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores: a symbol stands alone in a text just where it is one of them."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def looks_like_symbol(token: Column) -> Column:
    """W8. Units are refused before known quantities are accepted (Q7)."""
    low = F.lower(token)
    return (
        F.when(token.isNull() | (token == ""), False)
        .when(low.isin([*LATEX_WORDS, *STOP_WORDS]), False)
        .when(token.isin(UNITS), False)
        .when(token.isin(QUANTITIES), True)
        .when(token.rlike("^[a-z]{4,}$"), False)
        .when(token.contains("_") | token.rlike("[0-9]"), True)
        .otherwise(F.length(token) <= 3)
    )


def is_formula_line(line: Column) -> Column:
    """A relation between what can be operands, in a line that is not mostly long words."""
    few_long = X.let(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)), lambda spelled: F.size(F.filter(spelled, lambda t: F.length(t) >= 4)) <= F.greatest(F.lit(3), F.floor(F.size(spelled) / 2)))
    return F.coalesce((line != "") & (F.length(line) <= 500) & line.rlike(r"[A-Za-z0-9_)\]}]\s*(=|≈|∝|~)\s*[-+A-Za-z0-9_(\[{]") & few_long, F.lit(False))


def has_relation(line: Column) -> Column:
    """The plainer test of the second verifier."""
    return line.rlike("[=≈~∝]")


def _not_answer_word(token: Column) -> Column:
    return ~F.lower(token).isin(ANSWER_WORDS)


def symbols(text: Column) -> Column:
    """Distinct symbols in the order of their first use (F22, O5); no token goes over a line's end."""
    found = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    return F.filter(found, lambda t: _not_answer_word(t) & looks_like_symbol(t))


def plain_symbols(text: Column) -> Column:
    """The second verifier's symbols: all tokens but answer words and units, sorted."""
    found = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    return F.array_sort(F.filter(found, lambda t: _not_answer_word(t) & ~t.isin(UNITS)))


def formula_lines(text: Column) -> Column:
    return F.filter(F.transform(X.lines(text), X.strip), is_formula_line)


def plain_formula_lines(text: Column) -> Column:
    return F.filter(F.transform(X.lines(text), X.strip), has_relation)


def formula(raw: Column, ordinal: Column) -> Column:
    """A formula line's parts (F24): the first relation, both sides ('' gives null), symbols, and its number among formulas (Q23)."""
    said = lambda text: X.let(text, lambda x: F.when(x != "", x))

    def parts(raw: Column, relation: Column) -> Column:
        at, has = F.position(relation, raw), relation != ""
        lhs = said(X.strip(F.substring(raw, F.lit(1), at - 1)))
        rhs = said(X.strip(F.substring(raw, at + 1, F.length(raw))))
        own = F.filter(F.array_distinct(tokens(raw)), looks_like_symbol)
        return F.struct(
            F.format_string("F%04d", ordinal).alias("fid"), raw.alias("raw"), F.when(has, relation).otherwise("unknown").alias("relation"),
            F.when(has, lhs).alias("lhs"), F.when(has, rhs).otherwise(raw).alias("rhs"), own.alias("symbols"), ordinal.cast("int").alias("line_index"),
        )

    return X.let(X.strip(raw), lambda stripped: X.let(F.regexp_extract(stripped, "(=|≈|∝|~)", 1), lambda relation: parts(stripped, relation)))


def formulas(text: Column) -> Column:
    """All formulas of a text, numbered from 0."""
    return F.transform(formula_lines(text), lambda raw, i: formula(raw, i))


def lhs_symbol(lhs: Column) -> Column:
    """The first identifier of a left side, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(lhs, F.lit("")), f"({TOKEN})", 1), F.lit(""))


def defines(relation: Column) -> Column:
    return relation.isin("=", "≈", "~")


def assignments(text: Column) -> Column:
    """All `name = number` of a text: struct<name (lower case), value> (F27 in one pass)."""
    pattern = r"(?i)\b([a-z][a-z0-9_]*)\s*=\s*([-+]?[0-9]+(?:[.][0-9]+)?(?:e[-+]?[0-9]+)?)"
    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    return F.zip_with(found(1), found(2), lambda name, value: F.struct(F.lower(name).alias("name"), value.alias("value")))


def symbol_stats(text: Column, names: Column) -> Column:
    """Of each symbol: how often it stands alone, and the distinct numbers assigned to it, sorted as text."""

    alone = X.grouped(F.transform(words(text), lambda w: F.struct(w.alias("k"), F.lit(True).alias("v"))), names)
    given = F.transform(F.array_distinct(assignments(text)), lambda a: F.struct(a["name"].alias("k"), a["value"].alias("v")))
    by_name = X.let(given, lambda known: X.grouped(known, F.array_distinct(F.transform(known, lambda a: a["k"]))))
    values = F.map_from_entries(F.transform(by_name, lambda g: F.struct(g["name"], F.array_sort(g["values"]))))

    def of(told: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.transform(alone, lambda g: F.struct(g["name"].alias("symbol"), F.size(g["values"]).alias("frequency"), F.coalesce(F.try_element_at(told, F.lower(g["name"])), none).alias("assigned_values")))

    return X.let(values, of)


def contexts(text: Column, names: Column) -> Column:
    """Of each symbol: the lines that use it, from 0, each with its neighbours."""

    def in_lines(stripped: Column) -> Column:
        around = lambda i: F.array_join(F.slice(stripped, F.greatest(F.lit(1), i), F.when(i == 0, 2).otherwise(3)), " ")
        used = F.flatten(F.transform(stripped, lambda s, i: F.transform(F.array_intersect(words(s), names), lambda w: F.struct(w.alias("k"), i.alias("v")))))
        return F.transform(X.grouped(used, names), lambda g: F.struct(g["name"].alias("symbol"), F.transform(g["values"], lambda i: F.struct(i.alias("line"), around(i).alias("context"))).alias("occurrences")))

    return X.let(F.transform(X.lines(text), X.strip), in_lines)


def formula_uses(formulas: Column, names: Column) -> Column:
    """Of each name the ids of the formulas that use it: struct<name, values>."""
    pairs = F.flatten(F.transform(formulas, lambda f: F.transform(f["symbols"], lambda s: F.struct(s.alias("k"), f["fid"].alias("v")))))
    return X.grouped(pairs, names)


def formula_definitions(formulas: Column) -> Column:
    """(k, v): the symbol that a formula defines and uses, and the formula's id."""
    made = F.transform(F.filter(formulas, lambda f: defines(f["relation"])), lambda f: F.struct(lhs_symbol(f["lhs"]).alias("k"), f["fid"].alias("v"), f["symbols"].alias("symbols")))
    own = F.filter(made, lambda m: F.coalesce(F.array_contains(m["symbols"], m["k"]), F.lit(False)))
    return F.transform(own, lambda m: F.struct(m["k"].alias("k"), m["v"].alias("v")))


def cues(text: Column) -> Column:
    """The named assumptions of a text, sorted."""
    said = F.struct(text.alias("as_is"), F.lower(text).alias("low"))
    return X.let(said, lambda t: F.array_sort(F.filter(X.lit_array(CUES), lambda k: F.contains(t["as_is"], k) | F.contains(t["low"], k))))


def full_text(question: Column, context: Column, prediction: Column) -> Column:
    """Question, context and prediction, each on its own line even if empty."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (question, context, prediction)])
