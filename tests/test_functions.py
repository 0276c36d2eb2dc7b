"""Golden values and brute force for what SQL can't express."""

import math
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import notation, numbers, text, vectors
from sparkloom.operators import aggregates, context, ordered, runs, sampling, scoring, stats


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("n", "nine"), [(57, "63"), (18, "20"), (75, "83"), (-57, "-63"), (0, "0")])
def test_base_nine(spark, n, nine):
    assert numbers.in_base(Fraction(n), 9) == nine
    assert one(spark, numbers.integer_in_base(F.lit(n), 9)) == nine


def test_texts_between_bases(spark):
    to, back = notation.rebase_text(10, 9), notation.rebase_text(9, 10)
    assert one(spark, to(F.lit("10/3"))) == "11/3"
    assert one(spark, to(F.lit("9,486,900 / 10,541"))) == "18758520 / 15412"
    assert one(spark, to(F.lit("3.14"))) == "(184/55)"
    assert one(spark, back(F.lit("(184/55)"))) == "(157/50)"
    assert one(spark, notation.rebase_text(10, 8)(F.lit("0.5"))) == "0.4"
    assert one(spark, back(F.lit("9"))) is None
    assert one(spark, to(F.lit("1. ten is 10\n2. x"))) == "1. ten is 11\n2. x"


@given(st.fractions(min_value=-10**6, max_value=10**6, max_denominator=500), st.integers(2, 20))
@settings(max_examples=100, deadline=None)
def test_bases_round_trip(value, base):
    shown = numbers.in_base(value, base, places=30)
    if "/" in shown:
        a, b = shown.strip("()").split("/")
        assert numbers.fraction_of(a, base) / numbers.fraction_of(b, base) == value
    else:
        assert numbers.fraction_of(shown, base) == value


@pytest.mark.parametrize(("shown", "want"), [("x = 3/6", "1/2"), ("\\frac{1}{3} + 0.5", "5/6"), ("2^{3}", "8"), ("(1", None), ("a+1", None), ("1/0", None), ("$1,000$", "1000"), ("", None), ("−3", "-3")])
def test_rationals(shown, want):
    assert numbers.written(numbers.rational(shown)) == want


@pytest.mark.parametrize(("shown", "want"), [("\\boxed{1} \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("\\boxed{", None), ("none", None), ("\\boxed{a} then \\boxed{b", "a"), (None, None)])
def test_last_box(spark, shown, want):
    assert one(spark, text.last_box(F.lit(shown).cast("string"))) == want


@pytest.mark.parametrize(("shown", "score"), [("\\boxed{(2,-3)}", 1), ("\\boxed{(2,3)}", 0), ("(2,-3)", 0), ("\\boxed{( 2 , −3 )}", 1), (None, 0)])
def test_coordinates(spark, shown, score):
    assert one(spark, scoring.score_coordinate(F.lit(shown).cast("string"), F.lit(2), F.lit(-3))) == score


def test_quarter_turns(spark):
    turned = [tuple(one(spark, runs.quarter_turn(F.lit(x), F.lit(y)))) for x, y in [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]]
    assert turned == [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]


def test_think_blocks(spark):
    assert one(spark, text.visible(F.lit("<think>no</think> yes"))) == "yes"
    assert one(spark, text.visible(F.lit("<think> open"))) is None
    assert one(spark, text.tagged(F.lit("<a>1</a><a>2</a>"), "a")) == "2" and one(spark, text.tagged(F.lit("x<a>part"), "a")) == "part"
    assert one(spark, text.tags_balanced(F.lit("<a>x</a><b>y"), ["a", "b"])) is False
    assert one(spark, text.option_value(F.lit("run --lr=1e-5 --name 'a b' --lr 2"), "lr")) == "1e-5"
    assert one(spark, text.tail_path(F.lit("/x//y/z/"))) == "y/z"
    assert one(spark, text.plain_typography(F.lit("“ﬁ”​ —"))) == '"fi" -'
    with pytest.raises(KeyError):
        text.render("$nothing", {})


def test_signed_rank_against_enumeration(spark):
    d = [1.5, -0.5, 2.0, 3.0, -1.0, 2.5, 4.0]
    rows = spark.createDataFrame([("g", x) for x in d] + [("few", 1.0)] + [("zero", 0.0)] * 7, "k string, d double")
    got = {r.k: r for r in stats.wilcoxon(rows, ["k"], "d").collect()}
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product([0, 1], repeat=len(d))]
    low = min(plus, sum(ranks) - plus)
    assert got["g"].w_plus == plus and math.isclose(got["g"].p, min(1, 2 * sum(s <= low for s in sums) / len(sums)))
    assert got["few"].p is None and got["zero"].p is None


def test_normal_tail(spark):
    for z in (0.0, 0.3, 1.96, -3.0, 6.5, 9.0):
        assert math.isclose(one(spark, vectors.normal_two_sided(F.lit(z))), math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-14)


def test_quadratic_against_numpy(spark):
    x = [0.0, 1.0, 2.0, 5.0, 7.0]
    y = [1.0, 0.5, 3.0, 11.0, 30.0]
    r = aggregates.quadratic(spark.createDataFrame([("a", *p) for p in zip(x, y, strict=True)], "k string, x double, y double"), ["k"], "x", "y").first()
    assert np.allclose([r.c2, r.c1, r.c0], np.polyfit(x, y, 2))


def test_calibration_and_gradients(spark):
    rows = spark.createDataFrame([([0.7, 0.2, 0.1], [0.2, 0.3, 0.5])], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    target = 0.4 * vectors.kl(p, q)
    r = rows.select(vectors.calibrate(lambda c: vectors.kl(p, vectors.mixture(p, q, c)), target).alias("c"), target.alias("t"), vectors.reverse_gradient(p, q).alias("g")).first()
    mixed = [(1 - r.c) * a + r.c * b for a, b in zip([0.7, 0.2, 0.1], [0.2, 0.3, 0.5], strict=True)]
    assert math.isclose(sum(a * math.log(a / m) for a, m in zip([0.7, 0.2, 0.1], mixed, strict=True)), r.t, rel_tol=1e-9)

    def loss(logits):
        e = np.exp(logits)
        s = e / e.sum()
        return float((s * np.log(s / np.array([0.2, 0.3, 0.5]))).sum())

    base = np.log([0.7, 0.2, 0.1])
    numeric = [(loss(base + h) - loss(base - h)) / 2e-6 for h in np.eye(3) * 1e-6]
    assert np.allclose(r.g, numeric, atol=1e-6)


def test_batches_are_greedy(spark):
    sizes = [5, 5, 5, 9, 1, 1, 1, 10]
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "k string, i int, s long")
    got = {r.i: r.batch for r in sampling.batches(rows, "k", "i", "s", 3, 10).collect()}
    assert [got[i] for i in range(8)] == [0, 0, 1, 2, 2, 3, 3, 4]


def test_fill_and_holm_edges(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "k string, i int, v double")
    assert sorted((r.k, r.i, r.v) for r in ordered.filled(rows, ["k"], ["i"], ["v"]).collect()) == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None)]
    p = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.04), ("f", "z", None), ("f", "w", float("nan"))], "f string, t string, p double")
    assert {r.t: r.p_holm for r in ordered.holm(p, ["f"], "p", "t").collect()} == {"x": 0.02, "y": 0.04, "z": None, "w": None}


def test_context_specs(spark):
    assert len(context.STRATEGIES) == 25
    assert context.parse_choices("gold_hint(2)|no_context | self_feedback(*,1)") == [("gold_hint", "2", None), ("no_context", None, None), ("self_feedback", "*", "1")]
    for bad in ("nothing", "gold_hint(", "gold_hint(1,2,3)"):
        with pytest.raises(ValueError):
            context.parse_choices(bad)
    rows = spark.createDataFrame([(1, "q", "")], "i long, question string, short_hint string")
    assert context.contextualised(rows, "gold_hint", "i", 1).first().teacher_text is None


def test_judgments(spark):
    rows = spark.createDataFrame([("inconsistent", 90, ["a", "a", "b"], ["not there"]), ("odd", 5, [], [])], "label string, confidence int, failure_modes array<string>, evidence array<string>")
    out = [r[0] for r in rows.select(context.validated_judgment(F.struct("*"), F.lit("the source"), {"consistent": "keep", "inconsistent": "drop", "suspect": "review"})).collect()]
    assert (out[0].label, out[0].confidence, out[0].recommendation, out[0].failure_modes) == ("suspect", 60, "review", ["a", "b"]) and out[1] is None


def test_occupancy_and_edges(spark):
    tree = spark.createDataFrame([(0, 0, 1, 0.25), (0, 0, 2, 0.75), (1, 1, 3, 1.0), (2, 1, 4, 0.5), (2, 1, 5, 0.5)], "state long, depth int, child long, p double")
    assert {r.state: r.mass for r in runs.occupancy(tree, 2).collect()} == {0: 1.0, 1: 0.25, 2: 0.75, 3: 0.25, 4: 0.375, 5: 0.375}
    edges = spark.createDataFrame([([("a", "b", 0, 1, 2), ("b", "c", 1, 1, 3)],)], "e array<struct<parent:string,child:string,dx:int,dy:int,distance:int>>")
    assert tuple(edges.select(runs.folded_edges(F.col("e"))).first()[0]) == (3, 5, True)


def test_audit_helpers(spark):
    from sparkloom.operators import audits

    rows = spark.createDataFrame([(1, 2, [1, 2], "a")], "x int, original_x int, y array<int>, z string")
    kept, reasons = audits.column_profile(rows, ["x", "z"])
    assert kept.columns == ["x", "z"] and reasons == {"original_x": "not listed", "y": "nested"}
    assert audits.other_world(rows).first().x == 2
    with pytest.raises(ValueError):
        audits.column_profile(rows, ["x"], ["nope"])
    config = rows.select(F.struct("x", "y").alias("c"))
    assert audits.flattened_config(config, "c").select("cfg_x", "cfg_y").first() == (1, "1->2")
    cells = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 5), ("b", None, 6)], "k string, m double, n int")
    assert audits.metric_columns(cells, ["k"]) == ["m"]
    tree = spark.createDataFrame([(0, 0, 1, 0.6, True), (0, 0, 2, 0.4, True), (1, 1, 3, 0.3, True), (1, 1, 4, 0.7, False), (2, 1, 5, 1.0, True)], "state long, depth int, child long, p double, supported boolean")
    out = audits.path_success(tree, 2).first()
    assert math.isclose(out.supported, 0.58) and out.greedy == 0.0


def test_text_features_of_long_texts_and_null_lengths(spark, tmp_path):
    from sparkloom.plans import texts

    rows = [(1, "Some words! " * 100 + "http://x.y", 1210), (2, "Two Words", None), (3, "short", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.slug, r.tokens, r.has_url) for r in texts.all_text_features(spark, str(tmp_path)).collect()}
    assert got == {1: ("some_words_" * 100 + "http_x_y", 201, True), 2: ("two_words", 2, False), 3: ("short", 1, False)}
