"""Operators against plain Python: batching, ranking, expressions, questions, hashes, phases, upserts."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import hashing, numbers, text
from sparkloom.operators import joins, ordered, predicates, puzzles, runs, sampling
from sparkloom.plans import catalog
from sparkloom.sources import writers


@pytest.mark.parametrize("most_rows,most_size,chunk", [(5, 100, 20), (7, 60, 7), (3, 1000, 50), (64, 120, 500_000)])
def test_batches(spark, most_rows, most_size, chunk):
    rng = random.Random(most_rows)
    rows = [("hot" if i % 3 == 0 else rng.choice("abc"), i, rng.randrange(1, 50)) for i in range(600)]
    want, state = {}, {}
    for k, o, z in sorted(rows):
        batch, n, total = state.get(k, (0, 0, 0))
        if n and (n + 1 > most_rows or total + z > most_size):
            batch, n, total = batch + 1, 0, 0
        state[k], want[k, o] = (batch, n + 1, total + z), batch
    out = sampling.batches(spark.createDataFrame(rows, "k string, o long, z long"), "k", "o", "z", most_rows, most_size, chunk)
    assert {(r.k, r.o): r.batch for r in out.collect()} == want


def test_batches_refuse_rows_over_the_limit(spark):
    with pytest.raises(Exception, match="larger than a batch"):
        sampling.batches(spark.createDataFrame([("a", 1, 500)], "k string, o long, z long"), "k", "o", "z", 5, 100).collect()


def test_ranks_in_ranges_are_the_ranks(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(300)], "i long, k string")
    got = {r.i: r._rank for r in sampling.with_rank(rows, ["k"], "s", "i").collect()}
    want = {r.i: r.r for r in rows.withColumn("r", sampling.hash_rank(["k"], "s", "i")).collect()}
    assert got == want


@pytest.mark.parametrize("shown,value", [
    ("1+2*3", "7"), ("x = (3 * 0.5) / (9 - 3 * 1.5)", "1/3"), ("-2^2", "-4"), ("2^{-3}", "1/8"), ("1,000.5", "2001/2"), ("2**3**2", "512"), ("--1", "1"), ("\\dfrac{\\frac{1}{2}}{3}", "1/6"),
    ("\\left(1+2\\right)\\cdot 3", "9"), ("$7$", "7"), ("−3", "-3"), (".5", "1/2"), ("abc", None), ("", None), ("(1", None), ("1)", None), ("1/0", None), ("3 4", None), ("1e5", None), ("()", None), ("2^99", None), ("(" * 5000 + "1" + ")" * 5000, None),
])
def test_exact_expressions(shown, value):
    assert numbers.written(numbers.rational(shown)) == value


@pytest.mark.parametrize("shown,last,values,malformed", [
    ("a \\boxed{1} b \\boxed{x{y}z} c", "x{y}z", ["1", "x{y}z"], False), ("\\boxed{a \\boxed{b}", "b", ["b"], True), ("\\boxed{a} \\boxed{b", "a", ["a"], True), ("no box", None, [], False),
    ("\\boxed{open", None, [], True), ("\\boxed{}", "", [""], False), ("\\boxed{{}}}", "{}", ["{}"], False), (None, None, None, None),
])
def test_boxes(spark, shown, last, values, malformed):
    row = spark.createDataFrame([(shown,)], "t string").select(text.last_box(F.col("t")).alias("last"), text.boxes(F.col("t")).alias("b")).first()
    assert row["last"] == last and (row.b.values if row.b else None) == values and (row.b.malformed if row.b else None) == malformed


@pytest.mark.parametrize("question,answer", [
    ("What is 12 + 30?", "42"), ("Calculate 7 times 6.", "42"), ("Work out 3 divided by 6", "1/2"), ("Solve 3*x + 1 = 7 for x.", "2"), ("Solve 3x = 1 - x for x", "1/4"), ("Solve x + y = 5, x - y = 2 for y.", "3/2"),
    ("Solve x*x = 4 for x.", None), ("Solve x + y = 5 for x.", None), ("Solve 0*x = 1 for x.", None), ("Who is it?", None), ("", None),
])
def test_decimal_answers(question, answer):
    assert numbers.written(puzzles.solved(question)) == answer


def test_equivalent_answers():
    assert puzzles.same_value("(x+1)^2", "x^2 + 2x + 1") and puzzles.same_value("1; 2", "2;1") and puzzles.same_value("1,000", "1000") and puzzles.same_value("abc", "abc")
    assert not puzzles.same_value("(x+1)^2", "x^2 + 2x") and not puzzles.same_value("1;1", "1;2") and not puzzles.same_value("x", "y") and not puzzles.same_value("a b?", "c")


def test_style_flags_and_degenerate(spark):
    rows = spark.createDataFrame([("move to to one cells  now",), ("12 times 1",), ("3 - 0",), ("3 / 12",), (None,)], "t string")
    got = [(r.f, r.d) for r in rows.select(puzzles.style_flags(F.col("t")).alias("f"), puzzles.degenerate(F.col("t")).alias("d")).collect()]
    assert got[0][0] == ["double_space", "duplicated_preposition", "bad_singular_plural_one"]
    assert [d for _, d in got] == [None, "multiplication_by_one", "subtraction_of_zero", None, None]


def test_style_flags_take_words_of_ascii(spark):
    """As the query's SQL: letters beyond ASCII end words and fold to s and k, only a newline ends a line, a vertical tab is no blank."""
    texts = ["öin in im", "in inß", "öin inch", "To tO", "1 \u017ftep\u017f", "one\x0bcells", "one\fcells", "For the a\r\u2028b relation, the displacement is", "For the a\nb relation, the displacement is", "you can loc\u0131ate", "move forward for 1\n from \u017f\u212as’s position", "\u017fto to", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: ",".join(r["f"]) for r in rows.select("doc_id", puzzles.style_flags(F.col("text")).alias("f")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert found == dict(con.execute(catalog.oracle_sql()["style_faults"]).fetchall())
    assert [found[i] for i in (0, 1, 2, 7)] == ["duplicated_preposition", "duplicated_preposition", "", "legacy_relation_step"]


def test_hashes_equal_hashlib(spark):
    rows = [(1, 'a "quoted" ü \\ name', 0.5, True), (2, None, -3.0, False)]
    df = spark.createDataFrame(rows, "i long, s string, x double, b boolean")
    for r in df.select("*", hashing.python_json(F.struct("s", "i", "x", "b"), sort_keys=True).alias("j"), hashing.stable_hash([F.lit("v"), "s"], {1: F.col("x")}).alias("h"), hashing.hash_int63(F.col("i")).alias("n"), hashing.hash_unit_64(F.col("i")).alias("u")).collect():
        want = json.dumps({"s": r.s, "i": r.i, "x": r.x, "b": r.b}, sort_keys=True, ensure_ascii=False)
        whole = int(hashlib.sha256(str(r.i).encode()).hexdigest()[:16], 16)
        assert (r.j, r.h) == (want, hashlib.sha256("\n".join(["v", json.dumps(r.x), r.s if r.s is not None else "null"]).encode()).hexdigest()[:24])
        assert r.n == whole & (1 << 63) - 1 and r.u == pytest.approx(whole / 2**64, rel=1e-15)


def test_phases_follow_what_they_need(spark):
    phases = spark.createDataFrame([("r", "a", 3), ("r", "b", 1), ("r", "c", 2), ("r", "d", 0), ("q", "x", 1), ("q", "y", 0)], "run string, phase string, rank int")
    needs = spark.createDataFrame([("r", "d", "c"), ("r", "c", "b"), ("q", "x", "y"), ("q", "y", "x")], "run string, phase string, needed string")
    got = {(r.run, r.phase): r.place for r in runs.phase_places(phases, needs, "run", "phase", "needed", "rank").collect()}
    # b sets c free, which joins the queue behind a.
    assert got == {("r", "b"): 0, ("r", "a"): 1, ("r", "c"): 2, ("r", "d"): 3, ("q", "y"): 0, ("q", "x"): 1}


def test_pareto_compares_with_what_was_kept(spark):
    points = [(5.0, 1.0), (4.0, 1.0 - 6e-13), (3.0, 1.0 - 11e-13), (2.0, 0.5), (1.0, 0.7)]
    got = ordered.pareto(spark.createDataFrame([("k", *p) for p in points], "k string, gain double, loss double"), ["k"], "gain", "loss")
    assert sorted(r.gain for r in got.collect()) == [2.0, 3.0, 5.0]


def test_nan_is_larger_than_nothing(spark):
    rows = spark.createDataFrame([(1.0, "nan"), (float("nan"), "5"), (7.0, None)], "v double, t string")
    assert [predicates.where(rows, [c]).count() for c in ("v:gt:3", "t:gt:3", "v:lt:nan", "v:gte:1", "v:neq:7.0")] == [1, 1, 0, 2, 2]


def test_short_passages_meet_texts_by_their_letters(spark):
    texts, passages = [(1, "the cat sat on"), (2, "concatenate"), (3, "a b"), (4, "")], ["cat", "a", "at sat o", "concatenate", "zz", "", "a b"]
    found = joins.contained_passages(spark.createDataFrame(texts, "i int, t string"), "t", spark.createDataFrame([(p,) for p in passages], "p string"), "p")
    assert sorted((r.i, r.p) for r in found.collect()) == sorted((i, p) for i, t in texts for p in passages if p and p in t)


def test_splits_are_replaced_and_merged(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    writers.save_splits({"train": one, "eval": one}, f"{tmp_path}/d")
    with pytest.raises(FileExistsError):
        writers.save_splits({"train": two}, f"{tmp_path}/d")
    writers.save_splits({"train": two}, f"{tmp_path}/d", overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/d/train").count() == 5 and spark.read.parquet(f"{tmp_path}/d/eval").count() == 3
    assert not [p for p in (tmp_path / "d").iterdir() if p.name.startswith(".")]
    manifest = spark.createDataFrame([("a",), ("b",)], "shard string")
    parts = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "shard string, k int, v int")
    with pytest.raises(ValueError, match="missing"):
        writers.merge_complete(spark, manifest, parts.filter("shard = 'a'"), "shard", f"{tmp_path}/m", ["k"])
    for _ in range(2):
        writers.merge_complete(spark, manifest, parts, "shard", f"{tmp_path}/m", ["k"])
    writers.merge_complete(spark, manifest, parts.withColumn("v", F.col("v") + 1), "shard", f"{tmp_path}/m", ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/m/merged").collect()) == [("a", 1, 11), ("b", 2, 21)]


def test_upserts_do_not_depend_on_the_layout(spark):
    rows = [(1, i % 7, i) for i in range(50)]
    got = {writers.upserted(spark.createDataFrame(r, "k int, a int, b int").limit(0), spark.createDataFrame(r, "k int, a int, b int"), ["k"]).first() for r in (rows, rows[::-1])}
    assert len(got) == 1


def test_booleans_matches_and_short_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, ["a"], "x"), (2, False, [], "x"), (3, None, None, "y")], "_index long, ok boolean, tags array<string>, b string")
    assert [predicates.where(rows, [c]).count() for c in ("ok:eq:True", "ok:eq:true", "ok:neq:True", "ok:contains:tru")] == [1, 0, 2, 1]
    for form in ("json", "csv", "parquet"):
        writers.export_matches(rows, f"{tmp_path}/{form}", form)
        assert spark.read.format(form).option("header", True).load(f"{tmp_path}/{form}").count() == 3
    with pytest.raises(ValueError, match="too few"):
        sampling.nested(rows, "b", "_index", [1, 2], "s", strict=True)
    assert sampling.nested(rows, "b", "_index", [1, 2], "s").count() == 3


def test_variations_count_from_one(spark):
    from sparkloom.operators import context

    rows = spark.createDataFrame([(i, f"q{i}") for i in range(60)], "i long, question string")
    texts = [{r.teacher_text.split("\n\n")[1] for r in context.contextualised(rows, f"static_reasoning({k})", "i", 1).collect()} for k in ("1", "2", "3", "*")]
    assert [len(t) for t in texts] == [1, 1, 1, 3] and texts[3] == texts[0] | texts[1] | texts[2]
    assert {r.variation for r in context.contextualised(rows, "static_reasoning(*)", "i", 1).collect()} == {1, 2, 3}
    for bad in ("static_reasoning(0)", "static_reasoning(4)", "no_context(1,1)"):
        with pytest.raises(ValueError):
            context.contextualised(rows, bad, "i", 1)
