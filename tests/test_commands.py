"""Shell words, phase orders from commands and JSON without a depth limit, against plain Python."""

import json
import math
import os
import random
import shlex

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import numbers, text
from sparkloom.operators import runs


def test_shell_words_equal_the_standard_library(spark):
    rng = random.Random(8)
    commands = ["".join(rng.choice(["a", "b", " ", " ", "'", '"', "\\", "\n", "--x", "=", "\t", "é"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    commands += ["", " ", "''", '""', "a''b", "'unclosed", 'x "a \\" b" y', "a\\", "\\\n", "a\\\nb", '"a\\b"', "'a\\'"]

    def words(c):
        c = c.replace("\\\n", " ").replace("\n", " ")
        try:
            return shlex.split(c)
        except ValueError:
            return c.split()

    rows = spark.createDataFrame([(k, c) for k, c in enumerate(commands)], "k int, c string").select("k", text.shell_words(F.col("c")).alias("w"), text.option_value(F.col("c"), "x").alias("x")).collect()
    for r in rows:
        want = words(commands[r["k"]])
        assert r["w"] == want, commands[r["k"]]
        option = next((want[i + 1] if w == "--x" else w.split("=", 1)[1] for i, w in enumerate(want) if (w == "--x" and i + 1 < len(want)) or w.startswith("--x=")), None)
        assert r["x"] == option, commands[r["k"]]


def test_plain_paths(spark):
    paths = ["/a/b", "/a//b/", "/a/./b/../c", "/../a", "a/../../b", "", "/", ".", "../x/./y"]
    got = [r[0] for r in spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string").orderBy("k").select(text.plain_path(F.col("p"))).collect()]
    assert got == [os.path.normpath(p) if p not in ("", ".") else "" for p in paths]


def kahn(phases, needs):
    """A first-in queue over one run: phases {name: rank}, needs {(phase, needed)}."""
    needs = {(p, n) for p, n in needs if n in phases and p != n}
    left = {p: {n for q, n in needs if q == p} for p in phases}
    by = lambda p: (phases[p], p)
    queue, out = sorted((p for p in phases if not left[p]), key=by), []
    while queue:
        out.append(queue.pop(0))
        for p in sorted((p for p, n in needs if n == out[-1]), key=by):
            left[p].discard(out[-1])
            if not left[p]:
                queue.append(p)
    return out + sorted((p for p in phases if p not in out), key=by)


def test_places_equal_a_queue(spark):
    """A(0) sets D(1) free while B(2) waits: A, B, D. Several needs, circles and unknown phases too."""
    rng = random.Random(1)
    cases = [({"A": 0, "D": 1, "B": 2}, {("D", "A")}), ({"x": 1, "y": 0}, {("x", "y"), ("y", "x")}), ({"x": 1}, {("x", "gone"), ("x", "x")})]
    for _ in range(25):
        names = "abcdefgh"[: rng.randrange(1, 9)]
        cases.append(({n: rng.randrange(3) for n in names}, {(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(9))}))
    phases = [(k, p, r) for k, (ps, _) in enumerate(cases) for p, r in ps.items()]
    needs = [(k, p, n) for k, (_, ns) in enumerate(cases) for p, n in ns]
    out = runs.phase_places(spark.createDataFrame(phases, "run int, phase string, rank int"), spark.createDataFrame(needs, "run int, phase string, needed string"), "run", "phase", "needed", "rank").collect()
    for k, case in enumerate(cases):
        assert [r["phase"] for r in sorted(out, key=lambda r: r["place"]) if r["run"] == k] == kahn(*case), case


def test_order_from_commands(spark):
    rows = [
        ("r", "a", 0, "/e/r/a", "train --model_name org/base"), ("r", "b", 1, "/e/r/b", 'train --model_name "/e/r/c/checkpoint-10"'), ("r", "c", 2, "/e/r/c", "train --model_name=/e/x/../r/a"),
        ("s", "a", 0, "/e/s/a", None), ("s", "b", 1, "/e/s/b", "train --model_name other"),
        ("t", "a", 0, "/e/t/a", "train --model_name gone/b/checkpoint-3"), ("t", "b", 1, "/e/t/b", "train --model_name /e/t/aa"),
    ]
    phases = spark.createDataFrame(rows, "run string, phase string, rank int, folder string, command string")
    got = {r["run"]: r["phases"] for r in runs.command_order(phases, "run", "phase", "rank", "folder", "command").collect()}
    assert got == {"r": ["a", "c", "b"], "t": ["b", "a"]}


def flat(obj, prefix=""):
    out = {}
    for key, value in obj.items():
        name = f"{prefix}.{key}" if prefix else key
        if isinstance(value, dict):
            out.update(flat(value, name))
        elif not isinstance(value, bool):
            try:
                number = float(value)
            except (TypeError, ValueError):
                continue
            if math.isfinite(number):
                out[name] = number
    return out


def test_json_leaves_at_any_depth(spark):
    deep: dict = {"leaf": 7, "text": " 2.5 ", "under": "1_000", "bad": "1f", "hex": "0x1", "inf": "inf", "yes": True, "none": None, "list": [1, {"a": 2}], "empty": {}}
    objects: list = [{}, {"a": 1}, {"a": {"b": {"c": -1.5e3}}, "b": 2}, [1, 2], 5, None, "x"]
    for _ in range(12):
        deep = {"n": deep, "k": 1}
    objects.append(deep)
    rows = spark.createDataFrame([(k, json.dumps(o) if o is not None else None) for k, o in enumerate(objects)] + [(99, "{broken")], "k int, j string")
    got: dict = {}
    for r in runs.flat_json(rows, ["k"], "j").collect():
        got.setdefault(r["k"], {})[r["path"]] = r["value"]
    assert got == {k: flat(o) for k, o in enumerate(objects) if isinstance(o, dict) and flat(o)}
    assert got[7]["n." * 12 + "leaf"] == 7.0
    assert runs.flat_json(rows.limit(0), ["k"], "j").count() == 0


@pytest.mark.parametrize("value", ["1", " -2.5e3 ", "+.5", "5.", "1_0.2_5", "1__0", "_1", "1e", "nan", "1f", "1d", "0x10", "", "١", "1e400"])
def test_float_text_as_python_reads_it(spark, value):
    try:
        want = float(value) if value.isascii() and math.isfinite(float(value)) else None
    except ValueError:
        want = None
    assert spark.range(1).select(numbers.float_of_text(F.lit(value))).first()[0] == want
