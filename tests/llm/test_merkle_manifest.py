"""The manifest against a plain recursive tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(row):
    """All levels of a tree, leaves first."""
    levels = [row]
    while len(row) > 1:
        row = [h(*row[i : i + 2]) for i in range(0, len(row), 2)]
        levels.append(row)
    return levels


def brute(rows):
    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    for part in trees.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    levels = {n: climb([leaf_of(r) for r in trees[n]]) for n in names}
    top = climb([levels[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            leaf, fold, beside = leaf_of(row), leaf_of(row, int(tampered)), []
            for part, i in ((levels[name], at), (top, place)):
                for level in part[:-1]:
                    run = level[i // 2 * 2 : i // 2 * 2 + 2]
                    slot = i % 2
                    beside += [x for k, x in enumerate(run) if k != slot]
                    fold = h(*(fold if k == slot else x for k, x in enumerate(run)))
                    i //= 2
            out.append((row[0], leaf, levels[name][-1][0], top[-1][0], h(*beside), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, levels=mm.LEVELS, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("tree", F.lit("x"))
    out = mm.merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, levels)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_equals_brute_force(spark, levels):
    """Trees of 1 to 33 leaves, a null lang, null fields, texts that hold what separates fields, ids out of order."""
    rng = random.Random(levels)
    rows, k = [], 0
    for lang, n in ((None, 5), ("", 1), ("=", 2), ("de", 3), ("é", 4), ("zz", 33), ("Z", 16), ("en", 9)):
        for _ in range(n):
            k += 1
            rows.append((k * 7919 % 1009, rng.choice([None, "s", "1:a"]), lang, rng.choice([None, 0, 5, 2**63 - 1]), rng.choice([None, "", "-", "é\n" * 3, "x" * 70_000])))
    assert run(spark, rows, levels) == brute(rows)


def test_many_trees_and_rounds(spark):
    rows = [(k, "s", f"l{k % 23}", k, "t") for k in range(400)] + [(k, "s", "hot", k, "t") for k in range(1000, 1300)]
    assert run(spark, rows, 2) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, None, None, None, None)], [(1, "s", "en", 1, "a"), (2, "s", "en", 1, "a")], [(7, "s", "en", 1, "a"), (7, "s", "de", 1, "a")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "s", "en", 1, "a")] * 3 + [(None, "s", "en", 1, "b")] + [(5, "s", "en", 1, "a")] * 4 + [(5, "t", "en", None, "a"), (4, "s", "en", 1, "a")]
    assert run(spark, rows, 1) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_changed_byte_shows_everywhere(spark):
    rows = [(k, "s", "en", k, f"text {k}") for k in range(20)]
    before = run(spark, rows)
    after = run(spark, [*rows[:7], (7, "s", "en", 7, "text 7."), *rows[8:]])
    assert {r[3] for r in before}.isdisjoint(r[3] for r in after)
    tampered = [r[0] for r in before if not r[6]]
    assert tampered == [k for k in sorted(range(20), key=str) if zlib.crc32(str(k).encode()) % 7 == 0]
    assert sum(x[1] != y[1] for x, y in zip(sorted(before), sorted(after), strict=True)) == 1


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_layout_does_not_matter(spark, partitions):
    rows = [(k, "s", ("en", "de")[k % 3 == 0], k, "t") for k in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert run(spark, rows, 3, parts=5) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
