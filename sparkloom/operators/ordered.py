"""Window and ordered analytics: fills, deltas, first and last means, selections, envelopes, adjustments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def onwards(w):
    return w.rowsBetween(0, Window.unboundedFollowing)


def filled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nulls filled by the last value before, then by the first one after."""
    w = window(keys, *order)
    return rows.withColumns({c: F.coalesce(F.last(c, True).over(so_far(w)), F.first(c, True).over(onwards(w))) for c in columns})


def known_delta(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """previous and delta against the last value before that isn't null."""
    previous = F.last(value, True).over(before(window(keys, *order)))
    return rows.withColumn("previous", previous).withColumn("delta", F.col(value) - F.col("previous"))


def from_start(rows: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """baseline, the value at step 0, and the delta from it."""
    base = F.max(F.when(F.col(step) == 0, F.col(value))).over(Window.partitionBy(*keys))
    return rows.withColumn("baseline", base).withColumn("delta", F.col(value) - F.col("baseline"))


def ends(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 3) -> DataFrame:
    """first_mean and last_mean of n values that aren't null, and the delta."""
    valid = rows.filter(F.col(value).isNotNull())
    ranked = valid.withColumns({
        "_f": F.row_number().over(window(keys, *order)),
        "_l": F.row_number().over(window(keys, *(F.col(o).desc() for o in order))),
    })
    out = ranked.groupBy(*keys).agg(F.avg(F.when(F.col("_f") <= n, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("_l") <= n, F.col(value))).alias("last_mean"))
    return out.withColumn("delta", F.col("last_mean") - F.col("first_mean"))


def centred_mean(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """smooth: the mean of the values up to width // 2 rows away; the value itself for a width of 1 or up to 2 rows."""
    half = width // 2
    n = F.count("*").over(Window.partitionBy(*keys))
    mean = F.avg(value).over(window(keys, *order).rowsBetween(-half, half))
    return rows.withColumn("smooth", F.when((n > 2) & F.lit(width > 1), mean).otherwise(F.col(value)))


def offsets(rows: DataFrame, keys: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """offset: the sum of the lengths before."""
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(before(window(keys, *order))), F.lit(0)))


def keep_first(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """One row a key: the first in order."""
    return rows.withColumn("_rank", F.row_number().over(window(keys, *order))).filter("_rank = 1").drop("_rank")


def richest(rows: DataFrame, keys: Sequence[str], metrics: str, seq: str) -> DataFrame:
    """One row a key: with the most metrics, the later one of equals."""
    return keep_first(rows, keys, F.size(metrics).desc(), F.col(seq).desc())


def latest_ok(rows: DataFrame, keys: Sequence[str], ok: Column, seq: str) -> DataFrame:
    """One row a key: the last that is ok, else the last."""
    return keep_first(rows, keys, ok.desc(), F.col(seq).desc())


def best(rows: DataFrame, keys: Sequence[str], objective: str, *ties) -> DataFrame:
    """One row a key: the largest objective, ties in the order given."""
    return keep_first(rows, keys, F.col(objective).desc_nulls_last(), *ties)


def sweep_prefix(rows: DataFrame, keys: Sequence[str], rate: str, value: str) -> DataFrame:
    """Rows up to the rate with the best value (the smallest such), of keys where it beats the first rate's."""
    peak = best(rows, keys, value, F.col(rate)).select(*keys, F.col(rate).alias("_peak"), F.col(value).alias("_best"))
    start = keep_first(rows, keys, F.col(rate)).select(*keys, F.col(value).alias("_start"))
    joined = rows.join(peak, list(keys)).join(start, list(keys))
    return joined.filter((F.col(rate) <= F.col("_peak")) & (F.col("_best") > F.col("_start"))).drop("_peak", "_best", "_start")


def covered_choice(rows: DataFrame, keys: Sequence[str], choice: str, rate: str, value: str, least: int = 3) -> DataFrame:
    """One choice a key: of those with at least min(least, the most) distinct rates, the one with the best value."""
    per = rows.groupBy(*keys, choice).agg(F.count_distinct(rate).alias("n_rates"), F.max(value).alias("best"))
    need = F.least(F.lit(least), F.max("n_rates").over(Window.partitionBy(*keys)))
    return keep_first(per.withColumn("_need", need).filter("n_rates >= _need").drop("_need"), keys, F.col("best").desc(), F.col(choice))


def upper_envelope(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows above all rows before."""
    top = F.max(value).over(before(window(keys, *order)))
    return rows.withColumn("_top", top).filter(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def delta_from_lowest(rows: DataFrame, keys: Sequence[str], value: str, among: Column) -> DataFrame:
    """rows with delta: the value less the group's lowest among some of its rows; null where there are none."""
    low = rows.filter(among).groupBy(*keys).agg(F.min(value).alias("_low"))
    a, b = rows.alias("a"), low.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left").select("a.*", (F.col(f"a.{value}") - F.col("b._low")).alias("delta"))


def pareto(rows: DataFrame, keys: Sequence[str], gain: str, loss: str, slack: float = 1e-12) -> DataFrame:
    """Rows that no row kept before them, by falling gain and rising loss, undercuts in loss less a slack.

    What is kept has a lower loss than all before it. Of such rows one that is lower by more than the slack is kept whatever came before; only
    runs of rows that come closer to each other than that are looked at one after the other, each for itself.
    """
    order = F.col(gain).desc(), F.col(loss)
    lowest = F.min(loss).over(before(window(keys, *order)))
    lower = rows.withColumn("_least", lowest).filter(F.col("_least").isNull() | (F.col(loss) < F.col("_least")))
    clear = F.col("_least").isNull() | (F.col(loss) < F.col("_least") - slack)
    runs = lower.withColumn("_run", F.sum(clear.cast("long")).over(window(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_clear", clear)
    seen = F.collect_list(F.col(loss).cast("double")).over(window([*keys, "_run"], *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = lambda losses: F.aggregate(losses, F.lit(float("inf")), lambda last, x: F.when(x < last - slack, x).otherwise(last))
    kept = runs.withColumn("_seen", seen).filter(F.col("_clear") | (last(F.col("_seen")) < last(F.slice("_seen", 1, F.size("_seen") - 1))))
    return kept.drop("_least", "_run", "_clear", "_seen")


def drawdown(rows: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """peak, final, drawdown (peak less final), and low_gap (first less lowest)."""
    w = [F.struct(step, value)]
    out = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias("peak"), F.min(value).alias("low"), F.max(w[0])[value].alias("final"), F.min(w[0])[value].alias("first"))
    return out.select(*keys, "peak", "final", (F.col("peak") - F.col("final")).alias("drawdown"), (F.col("first") - F.col("low")).alias("low_gap"))


def holm(rows: DataFrame, family: Sequence[str], p: str, tie: str) -> DataFrame:
    """p_holm within each family: the running maximum of (m - rank) p, at most 1; null and NaN stay out and null."""
    ok = rows.filter(F.col(p).isNotNull() & ~F.isnan(p))
    w = window(family, p, tie)
    m = F.count("*").over(Window.partitionBy(*family))
    scaled = ok.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    done = scaled.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(so_far(w)))).drop("_s")
    return done.unionByName(rows.filter(F.col(p).isNull() | F.isnan(p)).withColumn("p_holm", F.lit(None).cast("double")))


def benjamini_hochberg(rows: DataFrame, family: Sequence[str], p: str, tie: str) -> DataFrame:
    """q within each family: the running minimum, from the largest p down, of m p / rank, within 0 and 1."""
    ok = rows.filter(F.col(p).isNotNull() & ~F.isnan(p))
    w, m = window(family, p, tie), F.count("*").over(Window.partitionBy(*family))
    scaled = ok.withColumn("_r", F.row_number().over(w)).withColumn("_s", m * F.col(p) / F.col("_r"))
    down = so_far(window(family, F.col("_r").desc()))
    done = scaled.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_s").over(down)))).drop("_r", "_s")
    return done.unionByName(rows.filter(F.col(p).isNull() | F.isnan(p)).withColumn("q", F.lit(None).cast("double")))


def matched_flag(rows: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """matched: whether any row of the key has the flag."""
    return rows.withColumn("matched", F.max(flag.cast("int")).over(Window.partitionBy(*keys)) == 1)


def median_baseline(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """rows with the median of their group as baseline: an aggregate and a join, so no group needs sorting in one task."""
    return rows.join(rows.groupBy(*keys).agg(F.median(value).alias("baseline")), list(keys))


def placed_null_last(rows: DataFrame, keys: Sequence[str], value: str, *ties: str) -> DataFrame:
    """rows with `place`, from 1 within keys, by value with nulls and NaN last."""
    from sparkloom.functions.numbers import null_last

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(null_last(F.col(value)), *ties)))
