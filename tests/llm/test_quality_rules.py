"""Quality rules against a plain Python count of the same things."""

import random
import re
from collections import Counter

from sparkloom.llm import quality_rules as q

SPACE = "\x09\x0a\x0b\x0c\x0d "


def words_of(text):
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def counts(text):
    text = text or ""
    words, lines = words_of(text), [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def run(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    return {r["doc_id"]: r for r in q.quality_rules(docs).collect()}


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "The", "é", "# ", "<", " ", "  ", "\n", "\x0b", "\t", " ", "…"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += [None, "", " \n ", "one", "a b c d e a b c d e", "a a a a a a", "a b c d\na b c d\na b c d", "x " * 5000, "é ü " * 3 + "\U0001f600 " * 9]
    found = run(spark, texts)
    for k, text in enumerate(texts):
        r = found[k]
        n, chars, symbols, dup, repeat = counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), text
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_very_long_text_of_repeats_and_of_none(spark):
    long, plain = " ".join(f"w{i % 40_000}" for i in range(60_000)), " ".join(f"w{i}" for i in range(60_000))
    found = run(spark, [long, plain])
    assert found[0]["n_repeat_words"] == counts(long)[4] == 40_000 and found[1]["n_repeat_words"] == 0


def test_each_rule_rejects_what_it_names(spark):
    clean = "the cat of the house and the dog that is in it ran for a mile with us as we saw"
    cases = {
        "words": "too few words", "repeats": "one two three four five " * 4, "word_length": " ".join(f"{i}{'x' * 20}" for i in range(12)), "symbols": "# ".join(clean.split()),
        "letters": clean + " 1 2 3 4 5 6 7 8 9 10 11 12", "capitals": clean.upper(), "stop_words": " ".join(f"word{i}" for i in range(100)),
        "same_lines": "\n".join(["same words here"] * 8 + [clean]), "bullets": "\n".join(f"- item {i} of the list" for i in range(10)), "ellipses": "\n".join(f"item {i} of the list..." for i in range(10)),
    }
    found = run(spark, [*cases.values(), clean])
    for k, name in enumerate(cases):
        assert name in found[k]["failed"].split(","), name
        assert not found[k]["kept"]
    assert found[len(cases)]["kept"] and found[len(cases)]["failed"] == ""


def test_thresholds_at_their_bounds(spark):
    """Exactly 20 % of repeated words pass, one more fails; ten words pass."""
    at = " ".join(["a b c d e"] * 2 + [f"w{i}" for i in range(40)])
    over = " ".join(["a b c d e"] * 2 + [f"w{i}" for i in range(39)])
    found = run(spark, [at, over, "the of and to in is that for was on"])
    assert [found[k]["base_failed"] for k in range(3)] == [False, True, False]


def test_own_table_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id long, text string")
    out = q.quality_rules(docs, rules=(q.Rule("few", "n_words", at_least=2),), base=()).collect()
    assert sorted((r["n_words"], r["kept"], r["failed"]) for r in out) == [(0, False, "few"), (3, True, ""), (3, True, "")]
    assert q.quality_rules(docs.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = q.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("split(text") == 2
