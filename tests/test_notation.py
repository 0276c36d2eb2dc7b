"""Exact rewriting of numbers between bases, with reasons."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import notation
from sparkloom.functions.notation import Notation, Refused
from sparkloom.operators import puzzles

NINE = Notation(9)


@pytest.mark.parametrize(("shown", "want"), [
    ("57 + 18 = 75, so \\boxed{75}.", "63 + 20 = 83, so \\boxed{83}."), ("10/3", "11/3"), ("9,486,900 / 10,541", "18758520 / 15412"), ("3.14", "(184/55)"), ("595h and item10", "731h and item11"),
    ("Step 2.125: 10", "Step 2.125: 11"), ("case 10) x", "case 10) x"), ("section 12", "section 13"), ("x1e5 9", "x1e5 10"), ("-9.50", "-(21/2)"), ("1,23", "1,25"), ("5.00", "5"), (".5", "(1/2)"), ("", ""), ("no number", "no number"),
])
def test_golden_rewriting(shown, want):
    assert NINE.to_base(shown) == want


@pytest.mark.parametrize(("run", "reason"), [
    (lambda: NINE.to_base("1.2345"), "too_many_places:1.2345"), (lambda: NINE.to_decimal("9"), "not_in_base:9"), (lambda: NINE.to_base("about 1.5e-3 m"), "scientific_notation"), (lambda: NINE.to_base("2E10"), "scientific_notation"),
    (lambda: NINE.check_decimals("a 0.123"), "too_many_places:0.123"), (lambda: NINE.to_decimal("0.19"), "not_in_base:0.19"),
])
def test_reasons(run, reason):
    with pytest.raises(Refused) as error:
        run()
    assert str(error.value) == reason


def test_forms_and_other_bases():
    assert NINE.to_base("3.14", latex=True) == "\\frac{184}{55}" and NINE.to_base("3.14", brackets=False) == "184/55" and NINE.to_base("1.2345", limited=False).startswith("(")
    eight = Notation(8)
    assert eight.to_base("0.5") == "0.4" and eight.to_decimal("0.4") == "(1/2)" and eight.is_finite("0.125") and not NINE.is_finite("0.2") and NINE.is_finite("5.000000")
    assert Notation(9, refuse_scientific=False).to_base("1e9") == "1e10"
    for bad in (dict(base=1), dict(base=11), dict(most_places=-1), dict(most_digits=0)):
        with pytest.raises(ValueError):
            Notation(**bad)


@pytest.mark.parametrize("base", [2, 5, 8, 9, 10])
def test_there_and_back(base):
    rng, kind = random.Random(base), Notation(base)
    for _ in range(300):
        text = "".join(rng.choice(["x", " ", "+", str(rng.randrange(10**6)), "(", "é"]) for _ in range(12))
        assert kind.to_decimal(kind.to_base(text)) == "".join(str(int(t)) if t.isdigit() else t for t in __import__("re").split(r"(\d+)", text))


def test_columns(spark):
    rows = spark.createDataFrame([(0, "1.5 + 9", "10.5"), (1, "1e5", "1"), (2, "2", "0.125"), (3, None, None)], "k int, q string, a string")
    out = {r["k"]: r for r in rows.select("k", notation.rewritten(NINE)(F.col("q")).alias("x"), notation.numeric_policy(NINE)(F.col("q"), F.col("a")).alias("why")).collect()}
    assert [tuple(out[k]["x"]) for k in range(4)] == [("(3/2) + 10", None), (None, "scientific_notation"), ("2", None), (None, None)]
    assert [out[k]["why"] for k in range(4)] == [None, "scientific_notation", "too_many_places:0.125", None]
    assert sorted(tuple(r) for r in notation.policy_rejections(rows, "q", "a", NINE).collect()) == [("scientific_notation", 1), ("too_many_places:0.125", 1)]


@pytest.mark.parametrize(("question", "answer", "response", "correct", "cut", "reason"), [
    ("1+1?", "2", None, True, False, "empty_response"), ("1+1?", "2", "\\boxed{2}", True, True, "hit_token_limit"), ("1+1?", "2", "\\boxed{2}", None, False, "failed_verification"), ("1+1?", "2", "\\boxed{2} \\boxed{", True, False, "malformed_box"),
    ("1+1?", "2", "2", True, None, "box_count:0"), ("1+1?", "2", "\\boxed{3}", True, False, "box_differs"), ("1+1?", "2", "\\boxed{x}", True, False, "box_differs"), ("1+1?", "2", "1.3 \\boxed{2}", True, False, "nonfinite_decimal:1.3"),
    ("1+1?", "2", "2.0000 \\boxed{4/2}", True, False, None), ("0.5+1.5?", "2", "2.0000 \\boxed{2}", True, False, "too_many_places:2.0000"), ("0.5+1.5?", "2", "0.5 \\boxed{2}", True, False, None), ("1+1?", "2", "2e0 \\boxed{2}", True, False, "scientific_notation"),
])
def test_candidates(spark, question, answer, response, correct, cut, reason):
    row = spark.createDataFrame([(question, answer, response, correct, cut)], "q string, a string, r string, ok boolean, cut boolean")
    assert row.select(notation.candidate_policy(NINE)(F.col("q"), F.col("a"), F.col("r"), F.col("ok"), F.col("cut"))).first()[0] == reason


@pytest.mark.parametrize(("question", "answer", "solution", "reason"), [
    ("What is 8 + 8?", "16", "\\boxed{16}", None), ("What is 8 + 9?", "", "\\boxed{17}", "missing_original_fields"), ("What is 8e3 + 9?", "17", "\\boxed{17}", "unsupported_numeric_notation:scientific_notation"),
    ("What is 1 + 2?", "3", "\\boxed{3}", "unchanged_problem"), ("What is 8 + 9?", "17", "\\boxed{18}", "solution_not_verified"), ("What is 8 + 9?", "17", "17", "solution_not_verified"), ("Calculate 107 divided by 1.", "107", "\\boxed{107}", "degenerate_identity:division_by_one"),
    ("What is 0.5 + 9.5?", "10", "0.125 \\boxed{10}", "unsupported_numeric_notation:too_many_places:0.125"), ("What is 9 + 18?", "27", "0.125 is \\boxed{\\frac{54}{2}}", "decimal_consistent"),
])
def test_records(spark, question, answer, solution, reason):
    row = spark.createDataFrame([(question, answer, solution)], "q string, a string, s string")
    assert row.select(puzzles.transformed_record(NINE, F.col("q"), F.col("a"), F.col("s"))["reason"]).first()[0] == reason
