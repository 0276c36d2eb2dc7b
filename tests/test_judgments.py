"""Judgments, accuracy by source, messages in a shell, and small operators, against what is expected of each."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, context, judgments, runs, sampling, scoring
from sparkloom.sources import readers

KIND = "struct<label: string, confidence: int, final_answer_status: string, recommendation: string, summary: string, failure_modes: array<string>, evidence: array<struct<quote: string, explanation: string, severity: string>>, checked_aspects: map<string,string>>"
GOOD = {
    "label": "inconsistent", "confidence": 95, "final_answer_status": "incorrect", "recommendation": "keep", "summary": " wrong sum ", "failure_modes": ["other", "other", "mixed_base_reasoning"],
    "evidence": [{"quote": " $2 \\times 3$ = 7. ", "explanation": " no ", "severity": "high"}, {"quote": "not there", "explanation": "x", "severity": "low"}], "checked_aspects": {a: "failed" if a == "algebra" else "passed" for a in judgments.ASPECTS},
}
SOURCE = "What is it?\n- **So** 2 × 3\n = 7, thus"


def run(spark, j, source=SOURCE):
    rows = spark.createDataFrame([(json.dumps(j) if j is not None else None, source)], "j string, s string").select(F.from_json("j", KIND).alias("j"), "s")
    return judgments.validated(rows, "j", F.col("s")).first()


def test_quotes_and_downgrades(spark):
    r = run(spark, GOOD)
    assert r["reason"] is None and r["dropped"] == 1 and r["valid"]["recommendation"] == "drop" and r["valid"]["summary"] == "wrong sum"
    assert [e["quote"] for e in r["valid"]["evidence"]] == ["$2 \\times 3$ = 7."] and r["valid"]["failure_modes"] == ["other", "mixed_base_reasoning"] and r["valid"]["checked_aspects"]["algebra"] == "failed"
    r = run(spark, GOOD, "another text")
    assert r["dropped"] == 2 and (r["valid"]["label"], r["valid"]["recommendation"], r["valid"]["confidence"]) == ("suspect", "review", 60)
    assert r["valid"]["summary"] == judgments.DROPPED + "wrong sum" and r["valid"]["checked_aspects"]["algebra"] == "unclear" and r["valid"]["evidence"] == []
    fine = {**GOOD, "label": "consistent", "final_answer_status": "correct", "checked_aspects": {a: "not_applicable" for a in judgments.ASPECTS}}
    r = run(spark, fine)
    assert (r["valid"]["recommendation"], r["valid"]["failure_modes"], r["valid"]["evidence"], r["dropped"]) == ("keep", [], [], 0)
    r = run(spark, {**GOOD, "label": "inconsistent", "evidence": [], "confidence": 40})
    assert (r["valid"]["label"], r["valid"]["confidence"], r["valid"]["summary"]) == ("suspect", 40, "wrong sum")


@pytest.mark.parametrize(("change", "reason"), [
    ({"label": "fine"}, "invalid_label"), ({"label": None}, "invalid_label"), ({"confidence": 101}, "invalid_confidence"), ({"final_answer_status": "maybe"}, "invalid_final_answer_status"), ({"recommendation": "burn"}, "invalid_recommendation"),
    ({"summary": "  "}, "empty_summary"), ({"failure_modes": ["other", "typo"]}, "invalid_failure_modes"), ({"failure_modes": None}, "invalid_failure_modes"), ({"evidence": GOOD["evidence"] * 2}, "too_much_evidence"),
    ({"evidence": [{"quote": "", "explanation": "x", "severity": "low"}]}, "invalid_evidence"), ({"evidence": [{"quote": "a", "explanation": "x", "severity": "grave"}]}, "invalid_evidence"), ({"checked_aspects": {"algebra": "passed"}}, "invalid_aspects"),
    ({"checked_aspects": {a: "ok" for a in judgments.ASPECTS}}, "invalid_aspects"), ({"label": "consistent"}, "consistent_without_correct_answer"), ({"label": "consistent", "final_answer_status": "correct"}, "consistent_with_failed_aspect"),
    ({"failure_modes": []}, "inconsistent_without_failure_mode"),
])
def test_refused_judgments(spark, change, reason):
    r = run(spark, {**GOOD, **change})
    assert (r["reason"], r["valid"], r["dropped"]) == (reason, None, None)


def test_missing_judgment(spark):
    assert run(spark, None)["reason"] == "missing"


def test_accuracy_by_source(spark):
    frame = lambda rows: spark.createDataFrame(rows, "run string, step double, accuracy double")
    curve = frame([("a", 0.0, 0.1), ("a", 5.0, 0.2), ("b", 0.0, 0.3), ("b", 7.0, None)])
    combined = frame([("a", 5.0, 0.9), ("b", 0.0, 0.4), ("b", 3.0, 0.5), ("c", 2.0, 0.6)])
    files = frame([("a", 9.0, 0.9), ("d", 4.0, 0.7), ("e", 0.0, 0.8)])
    registry = spark.createDataFrame([("a", 0.0), ("c", 0.0), ("d", 0.05), ("e", 0.06), ("f", 0.07), ("g", None)], "run string, accuracy double")
    got = sorted(tuple(r) for r in runs.accuracy_points(curve, combined, files, registry, "run").collect())
    assert got == [
        ("a", 0, 0.1, True, True), ("a", 5, 0.2, False, True), ("b", 0, 0.4, True, True), ("b", 3, 0.5, False, True), ("c", 2, 0.6, False, True), ("d", 0, 0.05, True, False), ("d", 4, 0.7, False, False), ("e", 0, 0.8, True, False), ("f", 0, 0.07, True, False),
    ]


def test_combined_curve(spark):
    points = [("r", "a", 5, "x", 0.1), ("r", "a", 10, "x", None), ("r", "c", 4, "x", 0.3), ("q", "b", 2, "x", 0.4)]
    phases = [("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("q", "b", 1), ("z", "a", 1)]
    base = [("r", "x", 0.05), ("q", "x", None), ("z", "x", 0.5), ("r", "y", 0.06)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = runs.combined_curve(frame(points, "run string, phase string, step int, dataset string, accuracy double"), frame(phases, "run string, phase string, place int"), frame(base, "run string, dataset string, accuracy double"), "run", "phase", "place", "dataset")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([("r", "x", 5, "a", 0.1), ("r", "x", 10, "a", None), ("r", "x", 14, "c", 0.3), ("q", "x", 2, "b", 0.4), ("r", "x", 0, None, 0.05), ("r", "y", 0, None, 0.06)], key=str)


def test_messages_in_a_shell(spark):
    kind = "k int, base array<struct<role: string, content: string>>, s array<struct<role: string, content: string>>"
    shell = [("system", "be brief"), ("user", "old"), ("assistant", "x")]
    rows = [(0, shell, [("user", "a"), ("user", "b")]), (1, shell, [("system", "p"), ("assistant", "q ")]), (2, None, [("user", "a")]), (3, [("system", "z")], [("user", "a")]), (4, [], [("system", "a")])]
    got = {r["k"]: [tuple(m) for m in r["m"]] for r in spark.createDataFrame(rows, kind).select("k", context.in_shell(F.col("base"), F.col("s")).alias("m")).collect()}
    assert got == {0: [shell[0], ("user", "b"), shell[2]], 1: [shell[0], ("user", "p\n\nq"), shell[2]], 2: [("user", "a")], 3: [("system", "z"), ("user", "a")], 4: [("system", "a")]}


def test_records_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}], indent=1))
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n{"x": 4}\n')
    (tmp_path / "c.csv").write_text("x\n5\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.jsonl").write_text('{"x": 6}\n')
    (tmp_path / "d" / "two.jsonl").write_text('{"x": 7}\n')
    of = lambda name, **kw: sorted(r["x"] for r in readers.records(spark, str(tmp_path / name), "x int", **kw).collect())
    assert [of("a.json"), of("b.jsonl"), of("c.csv"), of("d")] == [[1, 2], [3, 4], [5], [6, 7]] and len(of("d", limit=1)) == 1


def test_small_operators(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("inf")), ("b", None)], "k string, v double")
    assert {r["k"]: r["m"] for r in rows.groupBy("k").agg(aggregates.finite_mean(F.col("v")).alias("m")).collect()} == {"a": 1.0, "b": None}
    out = sampling.balanced(spark.range(23), "id", [4, 5, 6], "seed").groupBy("scheduled").count().collect()
    assert sorted(tuple(r) for r in out) == [(4, 8), (5, 8), (6, 7)]
    assert sampling.balanced(spark.range(2), "id", [4, 5, 6], "seed").filter("scheduled is null").count() == 0
    row = rows.limit(1).select(scoring.record(F.lit("r"), F.lit(None).cast("string"), F.lit(0), "m").alias("x")).first()["x"]
    assert (row["score"], row["method"], row["extracted"], row["error"]) == (0, "m", None, "nothing extracted")
    context.register_strategy("own", ["$question!", "$question?"])
    try:
        assert context.STRATEGIES["own"].templates == ("$question!", "$question?")
    finally:
        del context.STRATEGIES["own"]
    got = [r[0] for r in spark.createDataFrame([("old",), ("new",), ("x",), (None,)], "n string").select(runs.canonical(F.col("n"), {"old": "new"}, ["new"])).collect()]
    assert got == ["new", "new", None, None]
