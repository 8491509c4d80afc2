"""Golden cases of the column functions."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import parse as P
from gradeloom.functions import symbols as S
from gradeloom.functions import text as X


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_matches(spark):
    cases = [("2.50 m/s", "2.5", True), ("0.0000005", "0", True), ("1000.5", "1000", True), ("1002", "1000", False), ("10^5", "10^6", True), ("5", "five", False), (" A ", "a", True), ("x  y", "X y", True), (None, "", True), ("-3", "3", False)]
    got = values(spark, [c[:2] for c in cases], "a string, b string", A.matches(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_answers(spark):
    cases = [("\\boxed{\\frac{1}{2}}", 10, ["\\frac{1"]), ("got 3, then 4.5e2", 10, ["3", "4.5e2"]), ("\\boxed{a} \\boxed{b}", 1, ["a"]), ("\\boxed{ } 7", 10, ["7"]), (None, 10, []), ("", 0, [])]
    got = values(spark, [c[:2] for c in cases], "t string, n int", A.answers(F.col("t"), F.col("n")))
    assert [g[0] for g in got] == [c[2] for c in cases]
    got = values(spark, [("\\boxed{a} \\boxed{ b }",), ("none",), (None,)], "t string", A.last_boxed(F.col("t")))
    assert got == [("b",), ("",), ("",)]


def test_earned(spark):
    rows = [("\\boxed{2}", ["2", "2"], [1.0, 3.0]), ("\\boxed{2}", ["2", "5", "2"], [1.0, 1.0]), ("\\boxed{2}", ["2"], []), ("x", [], []), ("\\boxed{5} \\boxed{2}", ["2", "5"], [1.0, 1.0])]
    got = values(spark, rows, "t string, g array<string>, p array<double>", A.earned_any(F.col("t"), F.col("g"), F.col("p")), A.earned_in_place(F.col("t"), F.col("g"), F.col("p")))
    assert got == [(4.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (2.0, 0.0)]


def test_coarse(spark):
    got = values(spark, [(0.0, 0.7), (2.0, 0.7)], "e double, f double", A.coarse(F.col("e"), F.col("f")), A.coarse(F.col("e"), F.col("f"), "zero"))
    assert got == [(0.7, 0.0), (2.0, 2.0)]


def test_score_in(spark):
    cases = [("\\boxed{0.4}", 0.4), ("\\boxed{0.4 points of 1.0}", 1.0), ("boxed{} Score: 0.3", 0.3), ("0.5 points out of 2 pts", 2.0), ("I give 3 of 4", 4.0), ("-0.5", 0.5), ("", 0.0), (None, 0.0), ("\\boxed{1} \\boxed{x}", 1.0), ("\\boxed{nan}", 0.0), ("\\boxed{-2}", -2.0), ("Total: .5", 0.5)]
    got = values(spark, [(c[0],) for c in cases], "r string", A.score_in(F.col("r")))
    assert [g[0] for g in got] == [c[1] for c in cases]


def test_fields(spark):
    cases = [(None, [], [0.0]), ("", [], [0.0]), ("nan", [], [0.0]), ("[bad", ["[bad"], [0.0]), ("[bad]", ["[bad]"], [0.0]), ("x", ["x"], [0.0]), ("[1, null, 2]", ["1", None, "2"], [1.0, 2.0]), ("3", ["3"], [3.0]), ("[]", [], []), ('["a", "b"]', ["a", "b"], [0.0])]
    got = values(spark, [(c[0],) for c in cases], "v string", P.json_field(F.col("v")), P.points_field(F.col("v")))
    assert got == [(c[1], c[2]) for c in cases]


def test_marking(spark):
    cases = [(["nan", " "], False), ([], False), (None, False), ([None, "None"], False), (["x"], True)]
    got = values(spark, [(c[0],) for c in cases], "m array<string>", P.valid_marking(F.col("m")))
    assert [g[0] for g in got] == [c[1] for c in cases]
    rows = [('["a", " ", "b"]',), ('[["a"], ["b", "c"]]',), ('[["a"], "bc"]',), ("null",), ('"x"',), ("[]",)]
    got = values(spark, rows, "j string", P.marking_sets(F.parse_json("j")), P.valid_marking_variant(F.parse_json("j")))
    assert got == [([["a", " ", "b"]], True), ([["a"], ["b", "c"]], True), ([["a"], ["bc"]], True), ([], False), ([["x"]], False), ([], False)]
    got = values(spark, [(["a", " ", None, " b "],)], "m array<string>", P.criteria(F.col("m")))
    assert [(c["description"], c["index"]) for c in got[0][0]] == [("a", 0), ("b", 3)]


def test_replies(spark):
    reply = 'Sure: [{"severity": "ERROR", "message": "", "detail": "d", "symbol": "x", "evidence": {"a": 1}}, 3, {"severity": "odd", "message": "m"}]'
    got = values(spark, [(reply,), ("nothing",), ('{"a": 1}',), (None,)], "r string", P.diagnostics_in(P.json_in_text(F.col("r")), F.lit("rule")))
    assert [tuple(d) for d in got[0][0]] == [("error", "rule", "x", "d", '{"a":1}'), ("info", "rule", None, "m", None)]
    assert [g[0] for g in got[1:]] == [[], [], []]


def test_cache_key(spark):
    a, b = values(spark, [("x", "é")], "a string, b string", P.cache_key(F.col("a"), F.col("b")), P.cache_key(F.col("b"), F.col("a")))[0]
    assert a == b and len(a) == 64


def test_symbols(spark):
    tokens = {"m": False, "V": False, "k_B": True, "mass": False, "Tr": True, "f1": True, "velocity": False, "g": True, "Alpha": False, "": False, "abc": True, "SIN": False}
    got = values(spark, [(t,) for t in tokens], "t string", S.looks_like_symbol(F.col("t")))
    assert [g[0] for g in got] == list(tokens.values())
    lines = {"x = \\frac{a}{b}": False, "v = v0 + 3": True, "no relation here": False, "": False, "this sentence says that energy = mass times velocity squared": False, "a ≈ 3": True}
    got = values(spark, [(t,) for t in lines], "t string", S.is_formula_line(F.col("t")))
    assert [g[0] for g in got] == list(lines.values())


def test_formula(spark):
    text = "intro\n v_1 = u0 + 3 * t1\nq ∝ r1\n = 5"
    got = values(spark, [(text,)], "t string", S.formulas(F.col("t")))[0][0]
    assert [(f["fid"], f["relation"], f["lhs"], f["rhs"], f["symbols"]) for f in got] == [("F0000", "=", "v_1", "u0 + 3 * t1", ["v_1", "u0", "t1"]), ("F0001", "∝", "q", "r1", ["q", "r1"])]
    stats = values(spark, [("k_B = 1\nK_B = 2.5e3 k_B\nxk_B",)], "t string", S.symbol_stats(F.col("t"), F.array(F.lit("k_B"))))[0][0][0]
    assert (stats["frequency"], stats["assigned_values"]) == (2, ["1", "2.5e3"])
    ctx = values(spark, [("a1\n b1 = a1 \nc",)], "t string", S.contexts(F.col("t"), F.array(F.lit("a1"))))[0][0][0]
    assert [(o["line"], o["context"]) for o in ctx["occurrences"]] == [(0, "a1 b1 = a1"), (1, "a1 b1 = a1 c")]
    assert values(spark, [("We assume an Ideal Gas, 稳态",)], "t string", S.cues(F.col("t")))[0][0] == ["ideal gas", "稳态"]


def test_text(spark):
    got = values(spark, [("　 a \t b ",)], "t string", X.strip(F.col("t")), X.squeeze(F.col("t")))
    assert got == [("a \t b", "a b")]
    assert values(spark, [("a\n\nb\n",), ("",), (None,), ("a\r\nb",)], "t string", X.lines(F.col("t"))) == [(["a", "", "b"],), ([],), ([],), (["a", "b"],)]
    assert values(spark, [("/x/D/M/run 1.json",)], "t string", X.run_name(F.col("t"))) == [("run 1",)]
    assert values(spark, [("x" * 101,), ("x" * 100,)], "t string", X.shorten(F.col("t"))) == [("x" * 100 + "...",), ("x" * 100,)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_json_field_never_fails(spark, texts):
    got = values(spark, [(t,) for t in texts], "v string", P.json_field(F.col("v")), P.points_field(F.col("v")))
    assert all(isinstance(a, list) and isinstance(b, list) and all(not math.isnan(x) for x in b) for a, b in got)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50))
def test_half_even_is_numpy_round(spark, xs):
    import numpy as np

    got = values(spark, [(x,) for x in xs], "x double", X.half_even(F.col("x"), 2))
    assert [g[0] for g in got] == pytest.approx([float(np.round(x, 2)) for x in xs])
