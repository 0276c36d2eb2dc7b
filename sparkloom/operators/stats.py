"""Experimental statistics: signed-rank tests, pooled rows, cross-fitted choices, frontiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered
from .places import exact_quantiles, ranked_values, same

#: Pairs up to which the signed-rank null distribution is exact, if there are no zeros and ties.
EXACT = 50


def exact_two_sided(n: int, statistic: float) -> float:
    """P of a signed-rank sum of n distinct ranks at least as extreme, from the count of subsets by sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k]
    low = min(statistic, n * (n + 1) / 2 - statistic)
    return float(min(1.0, 2 * ways[: int(math.floor(low)) + 1].sum() / 2.0**n))


@F.pandas_udf(T.DoubleType())
def signed_rank_p(n: pd.Series, plus: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    """The p-value from pairs without zeros, their positive rank sum, sum of t^3 - t over ties, and zeros."""
    def one(m, w, t, z):
        if not m or m != m:
            return None
        m = int(m)
        if m + z <= EXACT and not t and not z:
            return exact_two_sided(m, w)
        spread = m * (m + 1) * (2 * m + 1) / 24 - t / 48
        return math.erfc(abs(w - m * (m + 1) / 4) / math.sqrt(2 * spread)) if spread > 0 else None

    return pd.Series([one(*x) for x in zip(n, plus, ties, zeros, strict=True)], dtype="float64")


def wilcoxon(rows: DataFrame, keys: Sequence[str], difference: str, least: int = 6, vanishing: float = 1e-8) -> DataFrame:
    """keys, n_pairs, median_d, w_plus, p: the two-sided signed-rank test per group, which may be of any size.

    Pairs are counted by the size of their difference, and the counts numbered over ranges, so the average rank of pairs that tie
    follows from how many lie below, and no task gets a whole group. Only four sums per group go through Python, for the null
    distribution: exact up to EXACT pairs without ties or zeros, else normal. p is null for under `least` pairs or all but zero ones.
    """
    d = F.col(difference)
    valid = rows.filter(d.isNotNull() & ~F.isnan(d.cast("double"))).select(*keys, d.alias("_d"), F.abs(d).alias("_abs"))
    ranked = ranked_values(valid.filter("_d <> 0"), keys, "_abs", [F.count_if(F.col("_d") > 0).alias("_plus")])
    rank = F.col("before") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(rank * F.col("_plus")).alias("w_plus"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1)).alias("_ties"))
    pairs = valid.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.max("_abs").alias("_top"))
    medians = exact_quantiles(valid, keys, "_d", [0.5], ["median_d"])
    out = pairs.alias("a").join(medians.alias("b"), same("a", "b", keys)).select("a.*", "b.median_d")
    out = out.alias("a").join(sums.alias("b"), same("a", "b", keys), "left").select("a.*", F.coalesce("b._n", F.lit(0)).alias("_n"), F.coalesce("b.w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("b._ties", F.lit(0)).alias("_ties"))
    p = signed_rank_p(F.col("_n").cast("double"), F.col("w_plus"), F.col("_ties").cast("double"), (F.col("n_pairs") - F.col("_n")).cast("double"))
    return out.withColumn("p", F.when((F.col("n_pairs") >= least) & (F.col("_top") > vanishing), p)).select(*keys, "n_pairs", "median_d", "w_plus", "p")


def tests_with_holm(pairs: DataFrame, family: Sequence[str], task: str, difference: str) -> DataFrame:
    """One test per family and task, Holm-adjusted within each family over the tasks that can be tested."""
    return ordered.holm(wilcoxon(pairs, [*family, task], difference), family, "p", task)


def pooled(pairs: DataFrame, family: Sequence[str], kind: Column, value: str) -> DataFrame:
    """median and n of each kind and of ALL kinds, by grouping sets in one pass."""
    rows = pairs.withColumn("kind", kind)
    sets = [[*family], [*family, "kind"]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *family, "kind").agg(F.grouping("kind").alias("_all"), F.count(value).alias("n_pairs"), F.median(value).alias("median_d"))
    return out.select(*family, F.when(F.col("_all") == 1, "ALL").otherwise(F.col("kind")).alias("kind"), "n_pairs", "median_d")


def cross_fit(rows: DataFrame, keys: Sequence[str], seed: str, choice: str, objective: str) -> DataFrame:
    """Rows of each fold (seed modulo 2) at the choice whose mean objective is best on the other fold."""
    folds = rows.withColumn("fold", F.pmod(F.col(seed), F.lit(2)))
    means = folds.groupBy(*keys, "fold", choice).agg(F.avg(objective).alias("_m"))
    chosen = ordered.best(means, [*keys, "fold"], "_m", F.col(choice)).select(*keys, (1 - F.col("fold")).alias("fold"), choice)
    return folds.join(chosen, [*keys, "fold", choice])


def matched_frontier(rows: DataFrame, keys: Sequence[str], method: str, gain: str, loss: str, at: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """keys, method, q, level, least_loss: over the gains that all methods reach, the least loss with at least that gain."""
    spans = rows.groupBy(*keys, method).agg(F.min(gain).alias("lo"), F.max(gain).alias("hi"))
    common = spans.groupBy(*keys).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).filter("lo <= hi")
    levels = common.select(*keys, F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("q"), "lo", "hi").withColumn("level", F.col("lo") + F.col("q") * (F.col("hi") - F.col("lo")))
    joined = rows.join(levels.drop("lo", "hi"), list(keys)).filter(F.col(gain) >= F.col("level"))
    return joined.groupBy(*keys, method, "q", "level").agg(F.min(loss).alias("least_loss"))


def endpoint_contrast(rows: DataFrame, keys: Sequence[str], axis: str, metrics: Sequence[str], low=0, high=1) -> DataFrame:
    """Each metric at the axis's high end less at its low end, where both are there."""
    at = lambda m, v: F.max(F.when(F.col(axis) == v, F.col(m)))
    return rows.groupBy(*keys).agg(*((at(m, high) - at(m, low)).alias(f"d_{m}") for m in metrics)).dropna(subset=[f"d_{m}" for m in metrics], how="all")


def common_choice(rows: DataFrame, keys: Sequence[str], choice: str, axis: str, objective: str, low=0, high=1) -> DataFrame:
    """One choice a key for both ends of an axis: the best mean of the two objectives; and their contrast there."""
    at = lambda v: F.avg(F.when(F.col(axis) == v, F.col(objective)))
    both = rows.groupBy(*keys, choice).agg(at(low).alias("_lo"), at(high).alias("_hi")).dropna(subset=["_lo", "_hi"])
    found = ordered.best(both.withColumn("objective", (F.col("_lo") + F.col("_hi")) / 2), keys, "objective", F.col(choice))
    return found.select(*keys, choice, "objective", (F.col("_hi") - F.col("_lo")).alias("contrast"))


def completion(expected: DataFrame, observed: DataFrame, keys: Sequence[str], want: str, have: str) -> DataFrame:
    """status: missing, row_count_mismatch or complete for every expected cell."""
    joined = expected.join(observed, list(keys), "left")
    status = F.when(F.col(have).isNull(), "missing").when(F.col(have) != F.col(want), "row_count_mismatch").otherwise("complete")
    return joined.withColumn("status", status)


def paired_invariance(left: DataFrame, right: DataFrame, key: str, controls: Sequence[str]) -> DataFrame:
    """(control, n_pairs, n_equal) of paired rows, nulls compared as values."""
    other = right.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in controls))
    cells = F.array(*(F.struct(F.lit(c).alias("control"), F.col(c).eqNullSafe(F.col(f"_{c}")).alias("same")) for c in controls))
    rows = left.join(other, key).select(F.explode(cells).alias("x")).select("x.*")
    return rows.groupBy("control").agg(F.count("*").alias("n_pairs"), F.count_if("same").alias("n_equal"))


def grid(spark, factors: dict[str, Sequence]) -> DataFrame:
    """All combinations of a few factors' levels: a table as small as the design."""
    out = None
    for name, levels in factors.items():
        side = spark.createDataFrame([(v,) for v in levels], [name])
        out = side if out is None else out.crossJoin(side)
    return out


def missing_cells(design: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the design that have no run yet."""
    return design.join(done, list(keys), "left_anti")
