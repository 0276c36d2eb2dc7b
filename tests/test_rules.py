"""Rules that must give what the original scripts give, against plain Python statements of them."""

import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import hashing, numbers, text
from sparkloom.operators import predicates, runs
from sparkloom.sources import writers


def boxed(t):
    """Every balanced box by counting braces from each start."""
    values, starts = [], [m.end() for m in re.finditer(r"\\boxed\s*\{", t)]
    for start in starts:
        depth = 1
        for at in range(start, len(t)):
            depth += {"{": 1, "}": -1}.get(t[at], 0)
            if depth == 0:
                values.append(t[start:at].strip())
                break
    return values, len(values) != len(starts)


def test_boxes_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["{", "}", "{", "}", "\\boxed{", "\\boxed {", "\\boxed\n{", "x", " ", "\\boxed"]) for _ in range(rng.randrange(12))) for _ in range(2000)]
    texts += ["\\boxed {5}", "\\boxed{ 1 }", "\\boxed{" * 3000 + "}" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.boxes(F.col("t")).alias("b"), text.last_box(F.col("t")).alias("last")).collect()
    for r in rows:
        values, malformed = boxed(texts[r["k"]])
        assert (r["b"]["values"], r["b"]["malformed"], r["last"]) == (values, malformed, values[-1] if values else None), texts[r["k"]][:100]


VALUES = [None, 0.0, -0.0, 1.0, 1.234e-5, 1e-3, 5e-6, 0.00049999, 0.0005, 1.0005, 123456.789, -2.5, 1e16, 1e22, 123456789012.0, 9.9996, float("nan"), float("inf")]


def test_number_forms(spark):
    """Rates, numbers and CSV cells as format() rounds them."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "k int, v double")
    for r in rows.select("k", numbers.short_rate(F.col("v")).alias("r"), numbers.short_rate(F.col("v"), 12).alias("r12"), numbers.compact(F.col("v")).alias("c"), numbers.compact(F.col("v"), 0).alias("c0"), numbers.significant(F.col("v"), "double").alias("g")).collect():
        v = VALUES[r["k"]]
        if v is None or not math.isfinite(v):
            assert (r["r"], r["r12"], r["c"], r["c0"], r["g"]) == ("",) * 5
            continue
        for name, digits in (("r", 3), ("r12", 12)):
            mantissa, power = f"{v:.{digits}E}".split("E")
            assert r[name] == f"{mantissa.rstrip('0').rstrip('.')}e{int(power)}"
        for name, digits in (("c", 3), ("c0", 0)):
            assert float(r[name]) == round(v, digits) and not re.search(r"\.\d*0$|\.$", r[name]) and r[name] != "-0"
        assert r["g"] == ("0" if v == 0 else f"{v:.6g}")
    flags = spark.createDataFrame([(True, 3, None), (False, None, "x")], "b boolean, i int, s string").select(*(numbers.significant(F.col(c), k) for c, k in (("b", "boolean"), ("i", "int"), ("s", "string"))))
    assert sorted(tuple(r) for r in flags.collect()) == [("FALSE", "", "x"), ("TRUE", "3", "")]


def test_csv_cells(spark, tmp_path):
    rows = spark.createDataFrame([(0.1 + 0.2, True, "a,b", 1e-7), (None, None, None, float("nan"))], "z double, flag boolean, run string, a double")
    writers.write_union_csv(rows.coalesce(1), str(tmp_path / "c"), ["run", "absent"])
    lines = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")).splitlines()
    assert lines == ["run,a,flag,z", '"a,b",1e-07,TRUE,0.3', ",,,"]


def test_json_equals_the_standard_library(spark):
    records = [
        {"s": 'a "q" \\ é \U0001f600 \n\t\x01\x7f', "n": 2**62, "x": [1.5, None, 1e16, 1e-5, float("nan"), float("inf"), 3.0], "m": {"b": True, "a": False}, "d": {"k": None}},
        {"s": None, "n": None, "x": None, "m": None, "d": None}, {"s": "", "n": -1, "x": [], "m": {}, "d": {"k": "v"}},
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "k int, r struct<s: string, n: long, x: array<double>, m: map<string,boolean>, d: struct<k: string>>")
    kind = df.schema["r"].dataType
    out = df.select("k", "r", hashing.python_json(F.col("r")).alias("plain"), hashing.python_json(F.col("r"), sort_keys=True, blanks=False, ascii_only=True).alias("compact"))
    back = out.select("*", hashing.json_loaded_as(F.col("plain"), kind.simpleString()).alias("back"))
    for r in back.collect():
        want = records[r["k"]]
        assert json.loads(r["plain"]).keys() == want.keys()
        assert r["compact"] == json.dumps(want, sort_keys=True, separators=(",", ":"))
        assert r["plain"] == json.dumps(want, ensure_ascii=False).replace(json.dumps(want["m"]), r["plain"].split('"m": ')[1].split(', "d"')[0])
        assert str(r["back"]) == str(r["r"])


def test_tolerant_loading(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "{broken"), (3, '{"a": [1, null, {"b": 2}]}'), (4, "null"), (5, "12345678901234567890"), (6, '"x"')], "k int, t string")
    got = {r["k"]: r["j"] for r in rows.select("k", F.to_json(hashing.json_loaded(F.col("t"))).alias("j")).collect()}
    assert got == {0: None, 1: None, 2: '"{broken"', 3: '{"a":[1,null,{"b":2}]}', 4: "null", 5: "12345678901234567890", 6: '"x"'}


def test_progress_key(spark):
    key = spark.range(1).select(hashing.progress_key(F.lit("run é"), F.lit("local:/m"), F.lit("/a/./b/../c"))).first()[0]
    payload = json.dumps({"run_name": "run é", "model_identity": "local:/m", "output_root": "/a/c"}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    assert key == "run é::" + hashlib.sha256(payload.encode()).hexdigest()[:12]


@pytest.mark.parametrize(("question", "answer", "reason"), [
    ("What is 1+1?", " 2 ", None), ("What is 1+1?", "-.5/2.", None), ("1?", "1,000 / -7", None), ("1?", "1.5 / 2", "answer_not_numeric"), ("1?", "3x", "answer_not_numeric"), ("1?", "2\n3", "answer_not_numeric"),
    ("Why?", "2", "question_without_digit"), (" \t", "2", "missing_question"), ("1?", "\u2003", "missing_answer"), (None, "1", "missing_question"), ("1?", None, "missing_answer"),
])
def test_content_rules(spark, question, answer, reason):
    rows = spark.createDataFrame([(question, answer)], "q string, a string")
    assert rows.select(predicates.first_reason(predicates.content_rules(F.col("q"), F.col("a")))).first()[0] == reason


def test_noise(spark):
    rows = spark.createDataFrame([(0.1, 0.2, 1.0, 5.0), (0.1, 0.2, 2.0, 7.0), (0.1, 0.2, 1.0, 9.0), (0.0, 0.3, 1.0, 1.0), (0.0, 0.0, 2.0, 4.0), (0.0, 0.0, 1.0, 4.0), (None, None, 1.0, 0.0)], "f double, b double, alpha double, gain double")
    got = {(r["noise_type"], r["noise_scale"]): (r["alpha"], r["gain"]) for r in runs.noise_optima(rows, "f", "b", [], "alpha", "gain").collect()}
    assert got == {("feature", 0.2): (1.0, 7.0), ("behavior", 0.3): (1.0, 1.0), ("zero", 0.0): (1.0, 4.0), ("zero", None): (1.0, 0.0)}


def test_external_features_fall_back(spark):
    tasks = spark.createDataFrame([("a", 50.0, 2.0, 40.0), ("a", 60.0, None, 50.0), ("a", None, None, 45.0), ("b", None, 3.0, None), ("b", None, 5.0, None)], "run string, final double, delta double, registered double")
    average = spark.createDataFrame([("a", None, None, None, None), ("c", 10.0, 20.0, 15.0, 1.0), ("d", None, None, None, 2.5)], "run string, registered double, baseline double, final double, delta double")
    got = {r["run"]: (r["final"], r["delta"], r["components"]) for r in runs.external_features(tasks, average, "run").collect()}
    assert got == {"a": (55.0, 10.0, 2), "b": (None, 4.0, 2), "c": (15.0, 5.0, 0), "d": (None, 2.5, 0)}


def test_length_summary(spark):
    shown = [json.dumps({"length_field": "hf_token_length", "hf_token_length": {"mean": "7.5", "median": 6}, "main_mean_length": True, "num_responses_with_text": 0, "num_records": 9, "char_length": 3}), "{}", "[]", "no"]
    got = {r["k"]: r["x"] for r in spark.createDataFrame(list(enumerate(shown)), "k int, s string").select("k", runs.length_summary(F.col("s")).alias("x")).collect()}
    assert tuple(got[0]) == (None, 6.0, "hf_token_length", None, None, 7.5, 9.0)
    assert tuple(got[1]) == (None, None, "", None, None, None, None) and got[3] is None
