"""Pairs of answers that are one, and pairs that only look alike."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.equivalence import same_answer
from sparkloom.operators import puzzles, scoring

SAME = [
    ("\\sqrt{8}", "2\\sqrt2"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"), ("\\sqrt[3]{-27}", "-3"), ("2^{-3}", "0.125"), ("8^{1/3}", "2"), ("\\pi/2", "\\frac{\\pi}{2}"), ("\\sin(\\pi/6)", "1/2"), ("\\tan\\frac{\\pi}{4}", "1"),
    ("e", "e"), ("\\ln(\\exp(3))", "3"), ("\\log 1000", "3"), ("|{-5}|", "5"), ("(x+1)^2", "x^2 + 2x + 1"), ("\\frac{x^2-1}{x-1}", "x+1"), ("2\\cdot3\\times4", "24"), ("1,000", "1000"), ("$12$.", "12"), ("x = 5", "5"), ("12\\text{ cm}", "12"), ("90^\\circ", "90"),
    ("\\{1, 2\\}", "2, 1"), ("1 and 2", "\\{2,1\\}"), ("(1, 2)", "\\left(1, \\frac{4}{2}\\right)"), ("[0, \\infty)", "[0,+\\infty)"), ("(-\\infty, 1) \\cup (2, 3]", "(2,3] \\cup (-\\infty, 1)"), ("\\pm 3", "3, -3"), ("3 \\pm \\sqrt{2}", "3-\\sqrt 2; 3+\\sqrt 2"),
    ("x \\in [1, 2]", "[1,2]"), ("-2^2", "-4"), ("(-2)^2", "4"), ("\\sin(x)\\sin(x)+\\cos(x)\\cos(x)", "1"), ("ab", "ba"), ("\u221216", "-16"), ("text alone", "text alone"), ("10^{30}+1-10^{30}", "1"),
]
OTHER = [
    ("\\sqrt{8}", "2.828427"), ("1/3", "0.3333333333"), ("(1,2)", "(2,1)"), ("[1,2)", "[1,2]"), ("(1,2)", "1,2"), ("1,2", "1,2,2"), ("x", "y"), ("x^2", "x"), ("", "0"), ("abc def", "abd"), ("\\sqrt{-1}", "1"), ("1/0", "1/0 "[:3] + "1"), ("\\infty", "-\\infty"),
    ("\\{1\\}", "\\{1, 1\\}"), ("\\frac{1}{2", "0.5"), ("2^{9999999}", "2^{9999998}"), ("((((", "1"), ("sin", "cos"), ("\\sqrt{x^2}", "-x"), ("(" * 3000 + "1" + ")" * 3000, "1"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_one_answer(a, b):
    assert same_answer(a, b) and same_answer(b, a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_answers(a, b):
    assert not same_answer(a, b) and not same_answer(b, a)


@pytest.mark.parametrize(("response", "gold", "score", "method"), [
    ("so \\boxed{\\frac{\\sqrt2}{2}}", "1/\\sqrt{2}", 1, "last_boxed"), ("\\boxed{1} then \\boxed {2}", "1", 0, "failed"), ("\\sqrt{4}", "2", 1, "full_response"), ("<think>\\boxed{2}", "2", 0, "unclosed_think_block"),
    ("<think>2</think>", "2", 0, "empty_visible_response"), ("\\boxed{2}", "", 0, "gold_missing"), ("\\boxed{2}", None, 0, "gold_missing"), (None, "2", 0, "empty_visible_response"), ("\\boxed{3}", "2", 0, "failed"), ("<think>9</think> \\boxed{(1, 2]}", "(1,2]", 1, "last_boxed"),
])
def test_details(spark, response, gold, score, method):
    row = spark.createDataFrame([(response, gold)], "r string, g string").select(scoring.score_details(F.col("r"), F.col("g")).alias("d"), scoring.score_number(F.col("r"), F.col("g")).alias("s"), puzzles.equivalent(F.col("g"), F.col("g")).alias("e")).first()
    assert (row["d"]["score"], row["d"]["method"], row["s"], row["e"]) == (score, method, score, int(gold is not None))
    assert (row["d"]["error"] is None) == (score == 1)
