"""The symbol graph of a sample as tables: symbols, formulas, and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import symbols as S
from gradeloom.functions import text as X


def spread(samples: DataFrame) -> DataFrame:
    """samples, dealt out anew if they come from fewer files than there are cores: parsing costs far more than moving a text."""
    cores = samples.sparkSession.sparkContext.defaultParallelism
    return samples.repartition(cores) if len(samples.inputFiles()) < cores else samples


def parsed(samples: DataFrame, text: str = "text_all") -> DataFrame:
    """samples with symbols, formulas and cues of the text."""
    t = F.col(text)
    return samples.withColumns({"symbols": S.symbols(t), "formulas": S.formulas(t), "precondition_cues": S.cues(t)})


def formula_rows(parsed_samples: DataFrame, key: str = "id") -> DataFrame:
    # Before an inner explode Spark asks whether there are any, by an expression that parses the text again.
    return parsed_samples.select(key, F.explode_outer("formulas").alias("f")).filter("f is not null").select(key, "f.*")


def uses(formulas: DataFrame, key: str = "id") -> DataFrame:
    """(sample, fid, symbol, role): each symbol a formula uses, and the one it defines."""
    used = formulas.select(key, "fid", "line_index", F.explode("symbols").alias("symbol"), F.lit("uses").alias("role"))
    lhs = S.lhs_symbol(F.col("lhs"))
    made = formulas.filter(S.defines(F.col("relation"))).withColumn("symbol", lhs).filter("array_contains(symbols, symbol)").select(key, "fid", "line_index", "symbol", F.lit("defines").alias("role"))
    return used.unionByName(made)


def occurrences(samples: DataFrame, key: str = "id", text: str = "text_all") -> DataFrame:
    """J9, an equi-join of symbols with the lines' tokens by one sort a sample, and J14: (sample, symbol, line, context) of each line that uses a symbol."""
    found = samples.select(key, F.explode(S.contexts(F.col(text), F.col("symbols"))).alias("c"))
    return found.select(key, F.col("c.symbol").alias("symbol"), F.explode("c.occurrences").alias("o")).select(key, "symbol", "o.line", "o.context")


def nodes(parsed_samples: DataFrame, key: str = "id", text: str = "text_all") -> DataFrame:
    """One row a symbol of a sample: occurrences, used_in and defined_by, all in order. Row-local: nothing is shuffled."""
    names = F.array_union("symbols", F.flatten(F.transform("formulas", lambda f: f["symbols"])))
    named = parsed_samples.select(key, "formulas", F.col(text).alias("__text"), names.alias("__names"))
    # Three lists in the order of the names, side by side.
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    all_ = both(S.contexts(F.col("__text"), F.col("__names")), both(S.formula_uses(F.col("formulas"), F.col("__names")), X.grouped(S.formula_definitions(F.col("formulas")), F.col("__names"))))
    return named.select(key, F.explode(all_).alias("n")).select(key, F.col("n.a.symbol").alias("symbol"), F.col("n.a.occurrences").alias("occurrences"), F.col("n.b.a.values").alias("used_in"), F.col("n.b.b.values").alias("defined_by"))


def symbol_frequency(samples: DataFrame, key: str = "id", text: str = "text_all") -> DataFrame:
    """(sample, symbol, frequency, assigned_values)."""
    return samples.select(key, F.explode(S.symbol_stats(F.col(text), F.col("symbols"))).alias("s")).select(key, "s.*")
