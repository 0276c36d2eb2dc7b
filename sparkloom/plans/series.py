"""Queries over step series: events stand in, a user as a run and an event type as a metric, ordered by event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import aggregates, ordered, runs
from sparkloom.streaming import steps

from .registry import query, table

RUN = ["user_id", "event_type"]


def points(spark, folder):
    """Events with gaps: every fifth value is missing."""
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


P = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events) p"
W = "PARTITION BY user_id, event_type ORDER BY event_id"


@query(f"SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM {P}")
def filled_both_ways(spark, folder):
    return ordered.filled(points(spark, folder), RUN, ["event_id"], ["value"]).select("event_id", "value")


@query(f"SELECT event_id, previous, value - previous AS delta FROM (SELECT event_id, value, last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM {P})")
def known_deltas(spark, folder):
    return ordered.known_delta(points(spark, folder), RUN, ["event_id"], "value").select("event_id", "previous", "delta")


@query(f"WITH r AS (SELECT user_id, event_type, value, row_number() OVER ({W}) AS f, row_number() OVER ({W} DESC) AS l FROM {P} WHERE value IS NOT NULL), m AS (SELECT user_id, event_type, avg(value) FILTER (f <= 3) AS first_mean, avg(value) FILTER (l <= 3) AS last_mean FROM r GROUP BY ALL) SELECT *, last_mean - first_mean AS delta FROM m")
def first_and_last_means(spark, folder):
    return ordered.ends(points(spark, folder), RUN, ["event_id"], "value")


@query(f"SELECT event_id, CASE WHEN n > 2 THEN m ELSE value END AS smooth FROM (SELECT event_id, value, count(*) OVER (PARTITION BY user_id, event_type) AS n, avg(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {P})")
def centred_means(spark, folder):
    return ordered.centred_mean(points(spark, folder), RUN, ["event_id"], "value", 5).select("event_id", "smooth")


@query("WITH l AS (SELECT user_id, event_type, count(*) AS length FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM l")
def phase_offsets(spark, folder):
    lengths = table(spark, folder, "events").groupBy(*RUN).agg(F.count("*").alias("length"))
    return ordered.offsets(lengths, ["user_id"], ["event_type"], "length").select(*RUN, "offset")


@query(f"SELECT user_id, event_type, max(value) AS peak, arg_max(value, event_id) AS final, max(value) - arg_max(value, event_id) AS drawdown, arg_min(value, event_id) - min(value) AS low_gap FROM {P} WHERE value IS NOT NULL GROUP BY ALL")
def drawdowns(spark, folder):
    return ordered.drawdown(points(spark, folder), RUN, "event_id", "value")


@query(f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 50 THEN 1 ELSE 0 END DESC, event_id DESC) AS r FROM {P}) WHERE r = 1")
def latest_good_rows(spark, folder):
    good = F.coalesce(F.col("value") > 50, F.lit(False))
    return ordered.latest_ok(points(spark, folder), RUN, good, "event_id").select(*RUN, "event_id")


@query("SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, max(event_id) AS event_id FROM events GROUP BY ALL")
def resumed_steps(spark, folder):
    """Of the records of one step, the one with the most metrics stays, and of those the latest."""
    rows = table(spark, folder, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("metrics", F.create_map("event_type", "value"))
    return ordered.richest(rows, ["user_id", "hour"], "metrics", "event_id").select("user_id", "hour", "event_id")


@query(f"SELECT event_id, value FROM (SELECT event_id, value, max(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {P}) WHERE value > top OR (top IS NULL)")
def upper_envelopes(spark, folder):
    return ordered.upper_envelope(points(spark, folder), RUN, ["event_id"], "value").select("event_id", "value")


@query(f"SELECT user_id, event_type, count(value) AS count, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max FROM {P} GROUP BY ALL")
def numeric_summaries(spark, folder):
    return points(spark, folder).groupBy(*RUN).agg(*aggregates.summary(F.col("value")))


@query(f"SELECT event_type, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, sum(CASE WHEN event_id % 7 > 0 THEN value * (event_id % 7) END) / sum(CASE WHEN value IS NOT NULL AND event_id % 7 > 0 THEN event_id % 7 END) AS weighted, exp(avg(ln(greatest(value, 0.001)))) AS floored, exp(avg(ln(1 + value))) AS growth FROM {P} GROUP BY ALL")
def means_of_kinds(spark, folder):
    v = F.col("value")
    return points(spark, folder).groupBy("event_type").agg(*aggregates.sample_stats(v), aggregates.weighted_mean(v, F.col("event_id") % 7).alias("weighted"), aggregates.floored_geometric(v).alias("floored"), aggregates.geometric_growth(v).alias("growth"))


@query("SELECT event_type, CASE WHEN sx > 1e-14 AND sy > 1e-14 AND n >= 4 THEN c / (sx * sy) END AS r, n FROM (SELECT event_type, count(*) AS n, covar_pop(value, CAST(user_id AS DOUBLE)) AS c, stddev_pop(value) AS sx, stddev_pop(CAST(user_id AS DOUBLE)) AS sy FROM events WHERE value IS NOT NULL GROUP BY ALL)")
def guarded_correlations(spark, folder):
    return aggregates.correlation(table(spark, folder, "events").withColumn("user_id", F.col("user_id").cast("double")), ["event_type"], "user_id", "value")


@query("SELECT event_type, count(DISTINCT user_id) AS n_x, CASE WHEN count(DISTINCT user_id) >= 4 THEN regr_slope(value, CAST(user_id AS DOUBLE)) END AS slope FROM events WHERE value IS NOT NULL GROUP BY ALL")
def linear_slopes(spark, folder):
    return aggregates.slope(table(spark, folder, "events"), ["event_type"], "user_id", "value")


@query("""WITH e AS (SELECT event_type, user_id, value, avg(user_id) OVER (PARTITION BY event_type) AS m FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
s AS (SELECT event_type, count(DISTINCT user_id) AS n_x, max(m) AS m, count(*) AS n, sum((user_id - m) ** 2) AS s2, sum((user_id - m) ** 3) AS s3, sum((user_id - m) ** 4) AS s4, sum(value) AS t0, sum(value * (user_id - m)) AS t1, sum(value * (user_id - m) ** 2) AS t2 FROM e GROUP BY event_type),
c AS (SELECT *, (s2 * (n * t2 - s2 * t0) - n * s3 * t1) / (s2 * (n * s4 - s2 * s2) - n * s3 * s3) AS c2 FROM s), b AS (SELECT *, (t1 - c2 * s3) / s2 AS b1, (t0 - c2 * s2) / n AS b0 FROM c)
SELECT event_type, n_x, CASE WHEN n_x >= 3 THEN b0 - b1 * m + c2 * m * m END AS c0, CASE WHEN n_x >= 3 THEN b1 - 2 * c2 * m END AS c1, CASE WHEN n_x >= 3 THEN c2 END AS c2 FROM b""")
def quadratic_fits(spark, folder):
    """Least-squares parabolas by power sums."""
    return aggregates.quadratic(table(spark, folder, "events"), ["event_type"], "user_id", "value")


@query("WITH a AS (SELECT user_id AS run, event_id // 1000 AS step, avg(value) AS accuracy FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id AS run, event_id // 1000 AS step, avg(value) AS length FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT run, step, accuracy, length FROM a FULL JOIN b USING (run, step)")
def merged_step_series(spark, folder):
    side = lambda kind, name: table(spark, folder, "events").filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 1000).alias("step")).agg(F.avg("value").alias(name))
    return runs.merged_series(side("click", "accuracy"), side("view", "length"), ["run", "step"]).select("run", "step", "accuracy", "length")


@query("""WITH g AS (SELECT user_id AS run, event_type AS dataset, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS step FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run, dataset ORDER BY step DESC) AS k FROM g WHERE value IS NOT NULL),
p AS (SELECT run, dataset, avg(value) FILTER (k <= 3) AS final, max(value) FILTER (step = 0) AS base FROM r GROUP BY ALL)
SELECT run, max(final) FILTER (dataset = 'click') AS click_final, max(final - base) FILTER (dataset = 'click') AS click_delta, max((final - base) / nullif(abs(base), 0)) FILTER (dataset = 'click') AS click_relative FROM p GROUP BY run""")
def per_run_rows(spark, folder):
    step = F.row_number().over(ordered.window(["run", "dataset"], "event_id")) - 1
    rows = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("dataset"), "event_id", "value").withColumn("step", step)
    return runs.seed_rows(rows, "run", "step", "dataset", "value", ["click"])


@query("SELECT event_id, k AS k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL")
def parsed_properties(spark, folder):
    """Numeric leaves of JSON text, through VARIANT."""
    return runs.flat_json(table(spark, folder, "events"), ["event_id"], "props").filter("path = 'k'").select("event_id", F.col("value").alias("k"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def hourly_means(spark, folder):
    """The batch form of the windowed stream."""
    out = steps.windowed_means(table(spark, folder, "events"), "ts", ["event_type"], "value")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, folder):
    out = steps.sessions(table(spark, folder, "events"), "ts", ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("SELECT event_type, avg(CASE WHEN isfinite(value) THEN value END) AS mean, count(*) AS n FROM events GROUP BY ALL")
def finite_means(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(aggregates.finite_mean(F.col("value")).alias("mean"), F.count("*").alias("n"))
