"""Seeded draws equal Python's, exact quantiles and ranks of large groups, recovered cells, occupancy means."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import seeded, vectors
from sparkloom.operators import audits, places, runs, stats


def rng_of(*parts):
    return random.Random(int(hashlib.sha256("::".join(map(str, parts)).encode()).hexdigest()[:16], 16))


def test_draws_equal_the_random_module(spark):
    """Ten thousand seeds: indices, options, weights and shuffles."""
    seed = seeded.seed_of(37, "data", F.col("id"))
    weights = {3: 0.1, 1: 0.6, 2: 0.3}
    rows = spark.range(10_000).select("id", seeded.chosen_index(7)(seed).alias("i"), seeded.chosen(["a", "b", "c"])(seed).alias("c"), seeded.chosen_by_weight(weights)(seed).alias("w"), seeded.shuffled(range(9))(seed).alias("s")).collect()
    for r in rows:
        draw = lambda f: f(rng_of(37, "data", r["id"]))  # noqa: B023, E731
        order = list(range(9))
        draw(lambda rng: rng.shuffle(order))  # noqa: B023
        assert (r["i"], r["c"], r["w"], r["s"]) == (draw(lambda g: g.randrange(7)), draw(lambda g: g.choice(["a", "b", "c"])), draw(lambda g: g.choices([1, 2, 3], weights=[0.6, 0.3, 0.1])[0]), order)
    with pytest.raises(ValueError):
        seeded.chosen_by_weight({1: -1.0, 2: 3.0})
    assert spark.range(1).select(seeded.chosen_index(3)(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("policy", ["shuffled_cycle", "random"])
def test_epochs(spark, policy):
    valid = [1, 2, 4, 8, 9]
    rows = spark.range(60).select("id", (F.col("id") % 10).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("epoch"))
    out = rows.select("*", seeded.epoch_variation(valid, F.col("base"), F.col("epoch"), 5, F.lit("é"), F.col("id"), policy=policy).alias("v")).collect()
    for r in out:
        if r["epoch"] == 0:
            want = r["base"]
        elif r["base"] not in valid:
            want = None
        elif policy == "random":
            want = valid[rng_of("context_epoch_variation", 5, "é", r["id"], policy, r["epoch"]).randrange(5)]
        else:
            order = list(valid)
            rng_of("context_epoch_variation", 5, "é", r["id"], policy).shuffle(order)
            want = order[(order.index(r["base"]) + r["epoch"]) % 5]
        assert r["v"] == want, r
    with pytest.raises(ValueError):
        seeded.epoch_variation(valid, F.col("base"), F.col("epoch"), policy="none")


def test_paths_never_meet_themselves(spark):
    names, weights = [f"n{k}" for k in range(12)], {1: 0.5, 2: 0.5}
    rows = spark.range(300).select("id", (F.col("id") % 11).alias("hops")).withColumn("p", seeded.backbone(names, weights, 0.3)(seeded.seed_of("g", F.col("id")), F.col("hops"), F.lit(2), F.lit(-1))).collect()
    flips, total = 0, 0
    for r in rows:
        assert len(r["p"]) == r["hops"]
        at, seen, stops = (2, -1), {(2, -1)}, [e["parent"] for e in r["p"]] + [e["child"] for e in r["p"][-1:]]
        assert len(set(stops)) == len(stops) and all(a["child"] == b["parent"] for a, b in zip(r["p"], r["p"][1:], strict=False))
        for e in r["p"]:
            dx, dy = seeded.DIRECTIONS[e["direction"]]
            at = at[0] + dx * e["distance"], at[1] + dy * e["distance"]
            assert (e["x"], e["y"]) == at and at not in seen
            seen.add(at)
            flips, total = flips + e["reversed"], total + 1
    assert 0.2 < flips / total < 0.4
    again = spark.range(300).repartition(7).select("id", seeded.backbone(names, weights, 0.3)(seeded.seed_of("g", F.col("id")), F.col("id") % 11, F.lit(2), F.lit(-1)).alias("p")).collect()
    assert {r["id"]: r["p"] for r in again} == {r["id"]: r["p"] for r in rows}
    draw = lambda hops, **kw: spark.range(1).select(seeded.backbone(names, **kw)(seeded.seed_of("x"), F.lit(hops), F.lit(0), F.lit(0))).collect()
    with pytest.raises(Exception, match="don't reach"):
        draw(12, weights=weights)
    with pytest.raises(Exception, match="no free place"):
        draw(9, weights={0: 1.0}, tries=5)
    assert draw(None, weights=weights)[0][0] is None


@pytest.mark.parametrize("partitions", ["1", "32"])
def test_quantiles_equal_numpy(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = np.random.default_rng(int(partitions))
        rows = [("hot", float(x)) for x in rng.choice([1.5, 2.0, 2.5, 1e300, -1e-300], 500)] + [("wide", float(x)) for x in rng.standard_normal(997) * 10.0 ** rng.integers(-9, 9, 997)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
        frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
        shares = (0.0, 0.1, 0.5, 0.99, 1.0)
        got = {r["k"]: tuple(r)[1:] for r in places.exact_quantiles(frame, ["k"], "v", shares, [f"q{i}" for i in range(5)]).collect()}
        assert set(got) == {"hot", "wide", "one", None}
        for k in got:
            assert np.allclose(got[k], np.quantile([v for g, v in rows if g == k and v is not None], shares), rtol=1e-12)
        whole = places.exact_quantiles(frame, [], "v", (0.25,)).first()[0]
        assert math.isclose(whole, np.quantile([v for _, v in rows if v is not None], 0.25), rel_tol=1e-12)
        assert places.exact_quantiles(frame.filter("v is null"), [], "v", (0.25,)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_signed_ranks_equal_brute_force(spark):
    """One group of all rows, ties and zeros, and groups too small to be tested."""
    rng = random.Random(9)
    rows = [("all", float(rng.randrange(-40, 60)) / 4) for _ in range(3000)] + [("few", 1.0), ("few", -2.0), ("zero", 0.0), (None, 3.0), ("nan", float("nan"))]
    got = {r["k"]: r for r in stats.wilcoxon(spark.createDataFrame(rows, "k string, d double").repartition(5), ["k"], "d").collect()}
    assert set(got) == {"all", "few", "zero", None}
    values = sorted((abs(d), d) for k, d in rows if k == "all" and d)
    ranks: dict = {}
    for i, (a, _) in enumerate(values):
        ranks.setdefault(a, []).append(i + 1)
    plus = sum(sum(ranks[a]) / len(ranks[a]) for a, d in values if d > 0)
    n, ties = len(values), sum(len(x) ** 3 - len(x) for x in ranks.values())
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    assert got["all"]["n_pairs"] == 3000 and got["all"]["w_plus"] == plus and got["all"]["median_d"] == float(np.median([d for k, d in rows if k == "all"]))
    assert math.isclose(got["all"]["p"], math.erfc(abs(plus - n * (n + 1) / 4) / math.sqrt(2 * spread)), rel_tol=1e-9)
    assert (got["few"]["w_plus"], got["few"]["p"], got["zero"]["w_plus"], got["zero"]["median_d"], got[None]["w_plus"]) == (1.0, None, 0.0, 0.0, 1.0)


def test_recovered_cells(spark):
    runs_of = [("a", "1", 5.0, 0), ("a", "2", 6.0, 0), ("a", "1", 5.0, 1), ("b", "1", 5.0, 0), ("b", "2", 6.0, 0), ("b", "1", 5.5, 1), ("c", "1", 5.0, 0), ("d", "1", 1.0, 0), ("d", "2.0", 2.0, 1), ("d", "3", 9.0, 0), ("d", "x", 9.0, 0), ("e", "1", None, 1), ("e", "1", None, 0), ("e", "2", 1.0, 1), ("z", "1", 1.0, 0), ("z", "2", 1.0, 0)]
    history = [("e", "1"), ("e", "2"), ("e", "2"), ("a", "1")]
    frame = spark.createDataFrame(runs_of, "cell string, seed string, v double, source int")
    cells = spark.createDataFrame([("a", 3, False), ("b", 2, False), ("c", 1, False), ("d", 0, None), ("e", 4, True)], "cell string, place int, needs_history boolean")
    told = spark.createDataFrame(history, "cell string, seed string")
    found = audits.recovered_cells(frame, told, cells, "cell", "seed", [1, 2], "source")
    assert sorted(tuple(r) for r in found.collect()) == [("a", 3), ("d", 0), ("e", 4)]
    assert sorted(r["cell"] for r in audits.recovered_cells(frame, None, cells, "cell", "seed", [1, 2], "source").collect()) == ["a", "d"]
    assert sorted(r["cell"] for r in audits.recovered_cells(frame, told.filter("seed = '1'"), cells, "cell", "seed", [1, 2], "source").collect()) == ["a", "d"]
    rows = audits.recovered_rows(frame, found, ["cell", "seed"], "cell", "seed", [1, 2], "source").orderBy("cell", "seed").collect()
    assert [(r["cell"], r["seed"], r["v"], r["place"]) for r in rows] == [("a", "1", 5.0, 3), ("a", "2", 6.0, 3), ("d", "1", 1.0, 0), ("d", "2.0", 2.0, 0), ("e", "1", None, 4), ("e", "2", 1.0, 4)]


def test_state_geometry_and_means(spark):
    rng = np.random.default_rng(4)
    p, q, t = (x / x.sum(axis=1, keepdims=True) for x in rng.random((3, 6, 5)))
    p[0], q[0] = q[0].copy(), q[0]
    rows = [(k, 0, k % 2 == 0, p[k].tolist(), q[k].tolist(), t[k].tolist()) for k in range(6)]
    mass = rng.random(6)
    states = spark.createDataFrame(rows, "state int, depth int, trained boolean, p array<double>, q array<double>, t array<double>")
    states = states.select("state", "depth", "trained", runs.state_geometry(F.col("p"), F.col("q"), F.col("t")).alias("g")).select("state", "depth", "trained", "g.*")
    got = {r["state"]: r for r in states.collect()}
    f, gap = p - q, np.log(p) - np.log(q)
    r = p * (gap - (p * gap).sum(axis=1, keepdims=True))
    cosine = (f * r).sum(axis=1)[1:] / np.linalg.norm(f, axis=1)[1:] / np.linalg.norm(r, axis=1)[1:]
    assert got[0]["cosine"] is None and got[0]["comparable"] == 0.0 and np.allclose([got[k]["cosine"] for k in range(1, 6)], cosine)
    assert np.allclose([got[k]["forward_kl"] for k in range(6)], (q * -gap).sum(axis=1)) and np.allclose([got[k]["target_support"] for k in range(6)], [p[k][t[k].argmax()] for k in range(6)])
    occupied = spark.createDataFrame([(k, 0, float(mass[k])) for k in range(6)], "state int, depth int, mass double")
    means = runs.occupancy_means(states, occupied, ["forward_kl"], 3, ["cosine"], ["tv"]).first()
    tv = 0.5 * np.abs(f).sum(axis=1)
    assert math.isclose(means["forward_kl"], (mass * (q * -gap).sum(axis=1)).sum() / 3) and math.isclose(means["cosine"], (mass[1:] * cosine).sum() / mass[1:].sum()) and math.isclose(means["tv_held_out"], (mass * tv)[1::2].sum() / mass[1::2].sum())
    assert runs.occupancy_means(states.filter("trained"), occupied, ["tv"], 3, [], ["tv"]).first()["tv_held_out"] is None
    assert vectors.TINY > 0
