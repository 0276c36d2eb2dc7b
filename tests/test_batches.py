"""Size-bounded batches against a loop, on any layout of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import places, sampling


def loop(rows, most_rows, most_size):
    out, by_key = {}, {}
    for key, order, size in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]) if r[0] is not None else (False, "", r[1])):
        batch, count, total = by_key.get(key, (0, 0, 0))
        if count and (count >= most_rows or total + size > most_size):
            batch, count, total = batch + 1, 0, 0
        by_key[key] = batch, count + 1, total + size
        out[key, order] = batch
    return out


@pytest.fixture
def layout(spark):
    """Sets shuffle partitions and adaptive execution for one test."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda *values: [spark.conf.set(n, v) for n, v in zip(names, values, strict=True)]
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize(("partitions", "adaptive"), [("1", "true"), ("8", "false"), ("64", "true"), ("64", "false")])
def test_equal_to_a_loop_on_every_layout(spark, layout, partitions, adaptive):
    """One key holds half of all rows; blocks are small, so keys are joined from many; some sizes are zero."""
    layout(partitions, adaptive)
    rng = random.Random(int(partitions))
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), k, rng.choice([0, 1, 1, 7, 30, 100])) for k in range(4000)]
    frame = spark.createDataFrame(rows, "key string, ord long, size long").repartition(9)
    for most_rows, most_size, block in ((5, 100, 16), (40, 300, 64), (1, 100, 50), (10_000, 10**9, 1)):
        got = {(r["key"], r["ord"]): r["batch"] for r in sampling.batches(frame, "key", "ord", "size", most_rows, most_size, block).collect()}
        assert got == loop(rows, most_rows, most_size)


def test_many_rows_of_few_keys(spark, layout):
    """All rows come out, with more than one sort partition and adaptive execution."""
    layout("64", "true")
    frame = spark.range(40_000).select((F.col("id") % 3).alias("key"), "id", (F.xxhash64("id") % 50 + 60).alias("size"))
    rows = [tuple(r) for r in frame.collect()]
    got = {(r["key"], r["id"]): r["batch"] for r in sampling.batches(frame, "key", "id", "size", 20, 1000, 500).collect()}
    assert got == loop(rows, 20, 1000)


def test_too_large_and_empty(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 2, 50)], "key string, ord long, size long")
    with pytest.raises(Exception, match="larger than a batch"):
        sampling.batches(frame, "key", "ord", "size", 2, 10).collect()
    assert sampling.batches(frame.limit(0), "key", "ord", "size", 2, 10).count() == 0


def test_parts(spark):
    frame = spark.createDataFrame([("a", k, 5) for k in range(5)], "key string, ord long, size long")
    parts = sampling.batch_parts(sampling.batches(frame, "key", "ord", "size", 2, 10), "key", "size", "audit").orderBy("part").collect()
    assert [(r["part"], r["input_file"], r["request_count"], r["size_bytes"]) for r in parts] == [(0, "audit_input_000.jsonl", 2, 10), (1, "audit_input_001.jsonl", 2, 10), (2, "audit_input_002.jsonl", 1, 5)]


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_numbered(spark, layout, partitions):
    layout(partitions, "true")
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.randrange(50), rng.choice([None, 1, 5])) for _ in range(500)]
    got = places.numbered(spark.createDataFrame(rows, "key string, v int, w int").repartition(5), ["key"], ["v"], "w").collect()
    for key in ("a", None, "b"):
        group = sorted((r for r in got if r["key"] == key), key=lambda r: r["_at"])
        assert [r["_at"] for r in group] == list(range(len(group))) and all(r["_size"] == len(group) for r in group)
        assert [r["v"] for r in group] == sorted(r[1] for r in rows if r[0] == key)
        assert [r["_before"] for r in group] == [sum(x["w"] or 0 for x in group[:i]) for i in range(len(group))]
