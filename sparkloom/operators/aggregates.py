"""Aggregations over runs and datasets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.numbers import finite


def accuracy(score: Column) -> list[Column]:
    """accuracy (0 for none), correct, total."""
    return [F.coalesce(F.avg(score), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum(score.cast("long")), F.lit(0)).alias("correct"), F.count(score).alias("total")]


def bucket(key: Column) -> Column:
    """The key; <missing> for null and blank ones."""
    return F.coalesce(F.nullif(F.trim(key.cast("string")), F.lit("")), F.lit("<missing>"))


def accuracy_by(rows: DataFrame, key: str, score: str) -> DataFrame:
    return rows.groupBy(bucket(F.col(key)).alias("bucket")).agg(*accuracy(F.col(score)))


def pass_at(rows: DataFrame, key: str, order: str, score: str, n: int) -> DataFrame:
    """(questions, acc_at_1, pass_at_n) over candidates in order: the first one's mean score, and any of the first n."""
    from pyspark.sql import Window

    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    per = ranked.filter(F.col("_rank") <= n).groupBy(key).agg(F.max(F.when(F.col("_rank") == 1, F.col(score))).alias("one"), F.max(score).alias("any"))
    return per.agg(F.count("*").alias("questions"), F.avg("one").alias("acc_at_1"), F.avg("any").alias("pass_at_n"))


def finite_mean(c: Column) -> Column:
    return F.avg(finite(c))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over positive weights; null without any."""
    use = (weight > 0) & value.isNotNull()
    return F.try_divide(F.sum(F.when(use, value * weight)), F.sum(F.when(use, weight)))


def geometric_growth(x: Column) -> Column:
    """The geometric mean of 1 + x; null if any x is -1 or less."""
    return F.when(F.min(x) > -1, F.exp(F.avg(F.when(x > -1, F.log1p(x)))))


def floored_geometric(x: Column, floor: float = 1e-3) -> Column:
    return F.exp(F.avg(F.log(F.greatest(x, F.lit(floor)))))


def summary(c: Column, name: str = "") -> list[Column]:
    """count, mean, median, min and max."""
    return [f(c).alias(name + n) for n, f in (("count", F.count), ("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]


def sample_stats(c: Column) -> list[Column]:
    """n, mean, sample deviation (0 for one value), min and max."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def quantiles(c: Column, at: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> list[Column]:
    """Exact quantiles by linear interpolation."""
    return [F.percentile(c, F.lit(q)).alias(f"p{round(q * 100)}") for q in at]


def metric_summary(rows: DataFrame, metrics: str, keys: Sequence[str] = ()) -> DataFrame:
    """The summary of each key of a map column."""
    return rows.select(*keys, F.explode(metrics).alias("metric", "value")).groupBy(*keys, "metric").agg(*summary(F.col("value")))


def cell_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean, median, deviation and count of many metrics in one aggregation."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp), ("count", F.count))]
    return rows.groupBy(*keys).agg(*aggs)


def normal_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, standard error, 95 % limits, shares of positive and negative values and a two-sided z p-value."""
    from sparkloom.functions.vectors import normal_two_sided

    c = F.col(value)
    out = rows.filter(c.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), (F.stddev_samp(c) / F.sqrt(F.count("*"))).alias("se"), F.avg((c > 0).cast("double")).alias("share_positive"), F.avg((c < 0).cast("double")).alias("share_negative")
    )
    z = F.try_divide(F.col("mean"), F.col("se"))
    return out.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se"), "p": F.when(F.col("se") > 0, normal_two_sided(z))})


def distinct_values(c: Column) -> Column:
    """Distinct values, null as one of them."""
    return F.count_distinct(F.coalesce(c.cast("string"), F.lit("\u0000null")))


def varying(rows: DataFrame, cell: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(cell, column, n) of the columns that aren't constant in a cell, where they must be."""
    counts = rows.groupBy(*cell).agg(*(distinct_values(F.col(c)).alias(c) for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))
    return counts.select(*cell, F.explode(cells).alias("x")).select(*cell, "x.*").filter("n > 1")


def seed_coverage(rows: DataFrame, keys: Sequence[str], seed: str, first: int, last: int) -> DataFrame:
    """rows, distinct, least and largest seed, and the seeds missing from and beyond first..last."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(seed).alias("n_seeds"), F.min(seed).alias("least"), F.max(seed).alias("largest"), F.collect_set(F.col(seed).cast("long")).alias("_seen"))
    wanted = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    return out.withColumns({"n_missing": F.size(F.array_except(wanted, "_seen")), "n_unexpected": F.size(F.array_except("_seen", wanted))}).drop("_seen")


def complete_cells(rows: DataFrame, keys: Sequence[str], seed: str, seeds: Sequence[int]) -> DataFrame:
    """Cells that have exactly the seeds expected, each once."""
    want = F.array_sort(F.array(*(F.lit(int(s)).cast("long") for s in seeds)))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col(seed).cast("long"))).alias("seen"))
    return found.filter((F.col("seen") == want) & (F.col("n") == len(seeds))).select(*keys)


def entropy_bits(rows: DataFrame, category: str) -> DataFrame:
    """The Shannon entropy of a category's counts in bits."""
    counts = rows.groupBy(category).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("total")))).alias("bits"), F.count("*").alias("categories"))


def label_shares(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n, percent): counts in two levels, unknown for null keys, and percent of the key's rows."""
    from pyspark.sql import Window

    counts = rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key), label).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def transitions(rows: DataFrame, first: str, second: str, ok: Column) -> DataFrame:
    return rows.filter(ok).groupBy(F.concat(F.col(first).cast("string"), F.lit("->"), F.col(second).cast("string")).alias("transition")).agg(F.count("*").alias("n"))


def nested_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) over the elements of an array column."""
    return rows.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Pearson's r with its n; null for fewer than `least` pairs or a constant side."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    ok = (F.col("n") >= least) & (F.col("_x") > 1e-14) & (F.col("_y") > 1e-14)
    return sums.select(*keys, "n", F.when(ok, F.try_divide(F.col("_c"), F.col("_x") * F.col("_y"))).alias("r"))


def slope(rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """The line's slope, for at least so many distinct x."""
    ok = finite(F.col(x).cast("double")).isNotNull() & finite(F.col(y).cast("double")).isNotNull()
    out = rows.filter(ok).groupBy(*keys).agg(F.count_distinct(x).alias("n_x"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    return out.select(*keys, "n_x", F.when(F.col("n_x") >= least, F.try_divide("_c", "_v")).alias("slope"))


def quadratic(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """c0, c1, c2 of the least-squares parabola, for at least three distinct x: by power sums about the mean of x."""
    from pyspark.sql import Window

    at = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_m", F.avg(x).over(Window.partitionBy(*keys)))
    d, v = F.col(x) - F.col("_m"), F.col(y)
    s = at.groupBy(*keys).agg(F.count_distinct(x).alias("n_x"), F.first("_m").alias("m"), F.count("*").alias("n"), *(F.sum(d**k).alias(f"s{k}") for k in (2, 3, 4)), *(F.sum(v * d**k).alias(f"t{k}") for k in (0, 1, 2)))
    n, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = n * s2 * s4 - n * s3 * s3 - s2 * s2 * s2
    c = (n * s2 * t2 - n * s3 * t1 - s2 * s2 * t0) / det
    b = (t1 - c * s3) / s2
    a = (t0 - c * s2) / n
    m = F.col("m")
    ok = F.col("n_x") >= 3
    return s.select(*keys, "n_x", F.when(ok, a - b * m + c * m * m).alias("c0"), F.when(ok, b - 2 * c * m).alias("c1"), F.when(ok, c).alias("c2"))


def row_mean(*columns: str, partial: bool = False) -> Column:
    """The mean across columns: null if any is, or, with partial, of those that are there."""
    if not partial:
        return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    have = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have))


def axis_counts(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """How many rows each combination of factors has."""
    return rows.groupBy(*axes).agg(F.count("*").alias("n"))


def seeds_per_cell(rows: DataFrame, cell: Sequence[str], seed: str) -> DataFrame:
    """(seeds, cells): how many cells have each number of different seeds."""
    per = rows.groupBy(*cell).agg(F.count_distinct(seed).alias("seeds"))
    return per.groupBy("seeds").agg(F.count("*").alias("cells"))


def distinct_phrases(rows: DataFrame, keys: Sequence[str], phrases: Column) -> DataFrame:
    """keys, phrases: how many different texts stand in nested lists of texts."""
    return rows.select(*keys, F.explode(F.flatten(phrases)).alias("_phrase")).groupBy(*keys).agg(F.count_distinct("_phrase").alias("phrases"))


def least_squares(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """keys, coefficients (of 1 and the features), rss, n: an ordinary fit per group, by pseudo-inverse where it is singular.

    Rows meet in sums of products only, combined before the shuffle; the small system of a group is solved in its one row.
    """
    whole = rows.dropna(subset=[*features, target])
    terms = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    y = F.col(target).cast("double")
    k = len(terms)
    products = F.array(*(F.sum(a * b) for a in terms for b in terms))
    sums = whole.groupBy(*keys).agg(products.alias("xx"), F.array(*(F.sum(a * y) for a in terms)).alias("xy"), F.sum(y * y).alias("yy"), F.count("*").alias("n"))

    @F.pandas_udf("coefficients array<double>, rss double")
    def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(xx, xy, yy, strict=True):
            a = np.array(a).reshape(k, k)
            scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
            w = np.linalg.pinv(a / np.outer(scale, scale), hermitian=True) @ (np.array(b) / scale) / scale
            out.append((w.tolist(), max(0.0, c - 2 * w @ np.array(b) + w @ a @ w)))
        return pd.DataFrame(out, columns=["coefficients", "rss"])

    return sums.withColumn("fit", solve("xx", "xy", "yy")).select(*keys, "fit.coefficients", "fit.rss", "n")
