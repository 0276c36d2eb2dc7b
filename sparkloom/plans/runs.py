"""Queries over runs: resolved settings, phases, external evaluations, checkpoint series, walks. Business tables stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import numbers, seeded
from sparkloom.operators import aggregates, audits, ordered, runs

from .registry import query, table

RATES = "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_discount > 0.02 THEN l_discount END AS a, CASE WHEN l_tax > 0.01 THEN l_tax END AS b FROM lineitem) r"


def rates(spark, folder):
    """Line items with a recorded rate and one from a name, each of which may be missing."""
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("b"))


@query(f"SELECT l_orderkey, l_linenumber, coalesce(a, b, l_quantity) AS value, (coalesce(a <> b, false) OR coalesce(a <> l_quantity, false) OR coalesce(b <> l_quantity, false)) AS conflict FROM {RATES}")
def resolved_settings(spark, folder):
    found = runs.resolved([F.col("a"), F.col("b"), F.col("l_quantity")])
    return rates(spark, folder).select("l_orderkey", "l_linenumber", found.alias("x")).select("l_orderkey", "l_linenumber", "x.value", "x.conflict")


@query(f"SELECT l_orderkey, l_linenumber, coalesce(a, b) AS value, coalesce(abs(a - b) > 1e-12 * greatest(abs(a), abs(b)), false) AS conflict FROM {RATES}")
def rate_conflicts(spark, folder):
    found = runs.rate_conflict(F.col("a"), F.col("b"))
    return rates(spark, folder).select("l_orderkey", "l_linenumber", found.alias("x")).select("l_orderkey", "l_linenumber", "x.value", "x.conflict")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS phase FROM part WHERE p_size % 3 = 0 OR p_size % 3 = 2 AND p_size % 2 = 0")
def single_phase_runs(spark, folder):
    k = F.col("p_size") % 3
    phases = F.when(k == 0, F.array("p_type")).when(k == 1, F.array("p_type", "p_brand"))
    return runs.single_phase(table(spark, folder, "part"), phases, F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).select("p_partkey", "phase")


NAMES = "(SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'fwd_' WHEN 1 THEN 'rev_' WHEN 2 THEN 'jsd_' ELSE 'x_' END || CASE WHEN p_size % 2 = 0 THEN 'teacher' ELSE 'student' END || CASE p_partkey % 3 WHEN 0 THEN '_frozen' WHEN 1 THEN '_ema_0.' || p_size ELSE '_sync' END AS name FROM part) n"


def names(spark, folder):
    k, j = F.col("p_partkey") % 4, F.col("p_partkey") % 3
    name = F.concat(F.when(k == 0, "fwd_").when(k == 1, "rev_").when(k == 2, "jsd_").otherwise("x_"), F.when(F.col("p_size") % 2 == 0, "teacher").otherwise("student"), F.when(j == 0, F.lit("_frozen")).when(j == 1, F.concat(F.lit("_ema_0."), "p_size")).otherwise(F.lit("_sync")))
    return table(spark, folder, "part").select("p_partkey", "p_size", name.alias("name"))


@query(f"""SELECT p_partkey, CASE split_part(name, '_', 1) WHEN 'fwd' THEN 'forward' WHEN 'rev' THEN 'reverse' WHEN 'jsd' THEN 'jsd' END AS direction, regexp_extract(name, 'teacher|student') AS role,
 regexp_extract(name, 'frozen|ema|sync') AS reference, CASE WHEN name LIKE '%frozen%' THEN 0.0 ELSE TRY_CAST(regexp_extract(name, 'ema_?([0-9.]+)', 1) AS DOUBLE) END AS rate FROM {NAMES}""")
def method_parts(spark, folder):
    return names(spark, folder).select("p_partkey", runs.method_factors(F.col("name")).alias("x")).select("p_partkey", "x.*")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS loss, CASE WHEN l_quantity > 25 THEN l_discount - l_tax END AS gap, CASE WHEN l_quantity > 25 THEN 4 ELSE 2 END AS n FROM lineitem")
def merged_metric_maps(spark, folder):
    nested = F.create_map(F.lit("loss"), "l_extendedprice", F.lit("student_entropy"), "l_tax")
    top = F.when(F.col("l_quantity") > 25, F.create_map(F.lit("loss"), F.lit(0.0), F.lit("teacher_entropy"), "l_discount")).otherwise(F.create_map(F.lit("loss"), F.lit(0.0)))
    rows = table(spark, folder, "lineitem").withColumn("m", runs.merged_metrics(nested, top))
    return rows.select("l_orderkey", "l_linenumber", F.try_element_at("m", F.lit("loss")).alias("loss"), F.try_element_at("m", F.lit("entropy_gap")).alias("gap"), F.size("m").alias("n"))


@query("SELECT event_id FROM events WHERE event_id > 0 AND (event_type = 'click' OR value > 100)")
def genuine_events(spark, folder):
    metrics = F.map_from_arrays(F.array(F.col("event_type"), F.when(F.col("value") > 100, "loss").otherwise("lr")), F.array("value", "value"))
    return runs.genuine_steps(table(spark, folder, "events").withColumn("m", metrics), "event_id", "m", ["click", "loss"]).select("event_id")


@query("SELECT event_id, user_id FROM (SELECT *, min(r) OVER (PARTITION BY user_id) AS best FROM (SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS r FROM events)) WHERE r = best")
def first_sources(spark, folder):
    rows = table(spark, folder, "events")
    parts = [rows.filter("event_type = 'error'"), rows.filter("event_type = 'click'"), rows.filter("event_type not in ('error', 'click')")]
    return runs.fallback_points(parts, ["user_id"]).select("event_id", "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_summaries(spark, folder):
    return runs.latest_summary(table(spark, folder, "events").withColumn("step", F.floor(F.col("value") / 10)), ["user_id"], "step", "event_id").select("user_id", "event_id")


@query("WITH l AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT user_id, event_type, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l) SELECT event_id, CAST(o + event_id AS BIGINT) AS global_step FROM events JOIN o USING (user_id, event_type)")
def learning_curves(spark, folder):
    rows = table(spark, folder, "events")
    phases = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return runs.learning_curve(rows, phases, "user_id", "event_type", "event_type", "n", "event_id").select("event_id", "global_step")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_retailprice END AS value FROM part")
def external_metrics(spark, folder):
    """Metric names of several forms; the retail price always stands under the one that is to win."""
    k, price, size = F.col("p_partkey") % 5, F.col("p_retailprice"), F.col("p_size").cast("double")
    pairs = [("acc,none", size, "acc", price), ("acc,create_test", size, "acc,none", price), ("acc,zzz", size, "acc,create_test", price), ("acc,zzz", price, "accuracy", size)]
    m = F.create_map(F.lit("f1"), price)
    for i, (a, x, b, y) in enumerate(pairs):
        m = F.when(k == i, F.create_map(F.lit(a), x, F.lit(b), y)).otherwise(m)
    return table(spark, folder, "part").select("p_partkey", runs.external_metric(m, "acc").alias("value"))


@query("""WITH v AS (SELECT o_custkey AS c_custkey, o_orderpriority AS task, count(*) / 64.0 AS v FROM orders GROUP BY ALL), b AS (SELECT c_custkey, '1-URGENT' AS task, CAST(c_nationkey AS DOUBLE) AS b FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, task, round(100 * v, 4) AS percent, round(round(100 * v, 4) - b, 4) AS delta, avg(round(100 * v, 4)) OVER (PARTITION BY c_custkey) AS average FROM v LEFT JOIN b USING (c_custkey, task)""")
def external_summaries(spark, folder):
    values = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("task")).agg((F.count("*") / 64.0).alias("v"))
    base = table(spark, folder, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.lit("1-URGENT").alias("task"), F.col("c_nationkey").cast("double").alias("b"))
    return runs.external_summary(values, "c_custkey", "task", "v", base, "b").select("c_custkey", "task", "percent", "delta", "average")


@query("SELECT p_brand, max(p_retailprice) FILTER (p_type = 'ECONOMY') AS ECONOMY_price, max(p_size) FILTER (p_type = 'STANDARD') AS STANDARD_size, max(p_size) FILTER (p_type = 'none') AS none_size FROM part GROUP BY p_brand")
def flattened_tasks(spark, folder):
    rows = table(spark, folder, "part").withColumn("m", F.create_map(F.lit("price"), "p_retailprice", F.lit("size"), F.col("p_size").cast("double")))
    return runs.flattened_results(rows, ["p_brand"], "p_type", "m", [("ECONOMY", "price"), ("STANDARD", "size"), ("none", "size")])


#: Line items as the tasks of an order's evaluation: registered baselines, summaries with gaps, raw or percent results.
TASKS = """(SELECT l_orderkey AS run, l_linenumber AS task, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 100 END AS registered, CASE WHEN l_suppkey % 3 > 0 THEN l_discount * 100 END AS baseline,
  coalesce(CASE WHEN l_quantity > 30 THEN l_quantity END, CASE WHEN l_quantity < 10 THEN l_discount * 100.0 END) AS final, CASE WHEN l_suppkey % 4 > 0 THEN l_tax END AS delta, CASE WHEN l_quantity > 25 THEN l_tax END AS se, l_discount AS sp FROM lineitem) t"""
FEATURES = f"""SELECT run, task, registered, f AS final, coalesce(f - base, delta) AS delta, coalesce(se, sp / 100.0) AS stderr FROM (SELECT *, coalesce(registered, baseline) AS base, coalesce(final, coalesce(registered, baseline) + delta) AS f FROM {TASKS})"""


def evaluated_tasks(spark, folder):
    when = lambda test, c: F.when(F.expr(test), F.expr(c))
    registered, baseline, delta = when("l_linenumber % 2 = 0", "l_tax * 100"), when("l_suppkey % 3 > 0", "l_discount * 100"), when("l_suppkey % 4 > 0", "l_tax")
    final = runs.percent_value(when("l_quantity > 30", "l_quantity"), when("l_quantity < 10", "l_discount"))
    found = runs.task_features(registered, baseline, final, delta, when("l_quantity > 25", "l_tax"), F.col("l_discount"))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("task"), registered.alias("registered"), found.alias("x")).select("run", "task", "registered", "x.*")


@query(FEATURES)
def task_feature_rows(spark, folder):
    return evaluated_tasks(spark, folder)


@query(f"""WITH f AS ({FEATURES}), m AS (SELECT run, avg(final) AS f, avg(delta) AS d, avg(registered) AS r, count(*) FILTER (final IS NOT NULL OR delta IS NOT NULL) AS n FROM f GROUP BY run),
a AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 0 THEN 40.0 END AS r, CASE WHEN o_orderkey % 3 = 0 THEN 30.0 END AS b, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS f, CASE WHEN o_orderkey % 7 = 0 THEN 1.5 END AS d FROM orders WHERE o_orderkey % 4 > 0)
SELECT run, coalesce(a.f, m.f) AS final, coalesce(coalesce(a.f, m.f) - coalesce(a.r, a.b, m.r), a.d, m.d) AS delta, coalesce(n, 0) AS components FROM m FULL JOIN a USING (run)""")
def external_feature_rows(spark, folder):
    """What an order's evaluation comes to; every fourth order has no summary of the average."""
    when = lambda test, c: F.when(F.expr(test), F.expr(c))
    average = table(spark, folder, "orders").filter("o_orderkey % 4 > 0").select(
        F.col("o_orderkey").alias("run"), when("o_orderkey % 5 = 0", "40.0D").alias("registered"), when("o_orderkey % 3 = 0", "30.0D").alias("baseline"),
        when("o_orderkey % 2 = 0", "o_totalprice").alias("final"), when("o_orderkey % 7 = 0", "1.5D").alias("delta"),
    )
    return runs.external_features(evaluated_tasks(spark, folder), average, "run")


@query("SELECT l_orderkey, l_linenumber, l_quantity - l_tax AS baseline, l_discount * 100 AS stderr_percent FROM lineitem")
def rebuilt_baselines(spark, folder):
    return runs.rebuilt_results(table(spark, folder, "lineitem"), "l_quantity", "l_tax", "l_discount").select("l_orderkey", "l_linenumber", "baseline", "stderr_percent")


@query("""WITH e AS (SELECT user_id AS run, event_id % 9 AS step, event_type, max(value) AS a FROM events GROUP BY ALL),
c AS (SELECT run, step, a FROM e WHERE event_type = 'error' AND (run % 3 > 0 OR step = 0)), m AS (SELECT run, step, a FROM e WHERE event_type = 'click' AND run % 2 = 0 AND run NOT IN (SELECT run FROM c WHERE step > 0)),
k AS (SELECT coalesce(m.run, c.run) AS run, coalesce(m.step, c.step) AS step, coalesce(m.a, c.a) AS a FROM c FULL JOIN m ON m.run = c.run AND m.step = c.step),
f AS (SELECT run, step, a FROM e WHERE event_type NOT IN ('error', 'click') AND step > run % 2 AND run NOT IN (SELECT run FROM k)), f1 AS (SELECT run, step, max(a) AS a FROM f GROUP BY ALL),
g AS (SELECT DISTINCT run, 0 AS step, run / 7.0 AS a FROM e WHERE run NOT IN (SELECT run FROM k) AND run NOT IN (SELECT run FROM f1 WHERE step = 0))
SELECT run, step, a AS accuracy, step = 0 AS is_baseline, true AS persisted FROM k UNION ALL SELECT run, step, a, step = 0, false FROM f1 UNION ALL SELECT run, step, a, true, false FROM g""")
def accuracy_point_sources(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 9).alias("step"), "event_type", "value")
    of = lambda test: rows.filter(test).groupBy("run", "step").agg(F.max("value").alias("accuracy"))
    curve = of("event_type = 'error' and (run % 3 > 0 or step = 0)")
    registry = rows.select("run").distinct().withColumn("accuracy", F.col("run") / 7.0)
    return runs.accuracy_points(curve, of("event_type = 'click' and run % 2 = 0"), of("event_type not in ('error', 'click') and step > run % 2"), registry, "run")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'houses' WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN c_mktsegment END AS name FROM customer")
def canonical_names(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", runs.canonical(F.col("c_mktsegment"), {"BUILDING": "houses"}, ["AUTOMOBILE", "MACHINERY"]).alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_tax - l_discount > 0 AS forward_wins, l_tax - l_discount - 0.01 > 0 OR l_tax - l_discount + 0.01 < 0 AS certain FROM lineitem")
def forward_wins(spark, folder):
    d = F.col("l_tax") - F.col("l_discount")
    return audits.wins(table(spark, folder, "lineitem").withColumns({"d": d, "low": d - 0.01, "high": d + 0.01}), "d", "low", "high").select("l_orderkey", "l_linenumber", "forward_wins", "certain")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's3/' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'plain/' || substr(url, 8) ELSE url END AS path FROM pages")
def remapped_paths(spark, folder):
    return table(spark, folder, "pages").select("page_id", runs.remapped(F.col("url"), [("https://", "s3/"), ("http://", "plain/")]).alias("path"))


@query("SELECT l_returnflag, CASE WHEN sum(l_discount) <> 0 THEN sum(l_discount * l_quantity) / sum(l_discount) END AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_state_means(spark, folder):
    return runs.weighted_state_mean(table(spark, folder, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("SELECT avg(m) AS mean FROM (SELECT l_orderkey, sum(l_quantity * u) / greatest(sum(u), 1.0) AS m FROM (SELECT *, CASE WHEN l_discount > 0.03 AND l_linenumber >= 2 THEN 1.0 ELSE 0.0 END AS u FROM lineitem) GROUP BY l_orderkey)")
def masked_means(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("mask", (F.col("l_discount") > 0.03).cast("double"))
    return runs.masked_sequence_mean(rows, "l_orderkey", "l_quantity", "mask", 2, "l_linenumber")


@query("SELECT avg(n) AS mean, min(n) AS least, max(n) AS largest, avg(CASE WHEN n >= 300 THEN 1.0 ELSE 0.0 END) AS clipped, coalesce(avg(n) FILTER (e), 0.0) AS ended_mean FROM (SELECT length(text) AS n, text LIKE '%.' AS e FROM conversations)")
def response_lengths(spark, folder):
    return runs.length_stats(table(spark, folder, "conversations").withColumn("n", F.length("text")), "n", 300, F.col("text").like("%."))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS main_mean, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 5.5 END END AS main_median,
 CASE o_orderkey % 3 WHEN 0 THEN 'char_length' WHEN 1 THEN 'whitespace_token_length' ELSE '' END AS main_unit, o_totalprice AS char_mean, CASE WHEN o_orderkey % 2 = 0 THEN 2.5 END AS whitespace_mean, CAST(NULL AS DOUBLE) AS token_mean,
 CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 ELSE o_custkey END * 1.0 AS responses FROM orders""")
def length_summaries(spark, folder):
    """JSON summaries whose main field is named in one of two places or none, with fields that aren't there."""
    k, s = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    shown = F.concat(
        F.lit('{"main_mean_length": '), F.when(k % 4 > 0, s("o_totalprice")).otherwise('""'), F.lit(', "char_length": {"mean": '), s("o_totalprice"), F.lit(', "median": "'), s("o_custkey"), F.lit('"}, '),
        F.when(k % 2 == 0, F.lit('"whitespace_token_length": {"mean": 2.5, "median": 5.5}, ')).otherwise(F.lit('"whitespace_token_length": null, ')),
        F.when(k % 3 == 0, F.lit('"length_field_used_for_main_mean": "char_length", "length_field": "x", ')).when(k % 3 == 1, F.lit('"length_field_used_for_main_mean": "", "length_field": "whitespace_token_length", ')).otherwise(F.lit("")),
        F.lit('"num_responses_with_text": '), (k % 5).cast("string"), F.lit(', "num_records": '), s("o_custkey"), F.lit("}"),
    )
    return table(spark, folder, "orders").select("o_orderkey", runs.length_summary(shown).alias("x")).select("o_orderkey", "x.*")


FILES = "(SELECT c_nationkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '_original' ELSE '' END || c_custkey AS path FROM customer)"


@query(f"SELECT c_nationkey, path FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY path LIKE '%original%', path) AS r FROM {FILES}) WHERE r = 1")
def primary_response_files(spark, folder):
    rows = table(spark, folder, "customer").select("c_nationkey", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "_original").otherwise(""), "c_custkey").alias("path"))
    return runs.primary_files(rows, ["c_nationkey"], "path")


@query("""WITH p AS (SELECT c_nationkey, c_mktsegment AS d, min(c_custkey) AS i FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL), f AS (SELECT DISTINCT c_nationkey, c_mktsegment AS d FROM customer),
a AS (SELECT f.*, i FROM f LEFT JOIN p USING (c_nationkey, d)) SELECT c_nationkey, d AS c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY i NULLS LAST, d) AS place FROM a""")
def dataset_orders(spark, folder):
    rows = table(spark, folder, "customer")
    return runs.datasets_in_order(rows.filter("c_custkey % 3 = 0"), rows, "c_nationkey", "c_custkey", "c_mktsegment")


@query("SELECT o_orderkey AS run, step, value, row_number() OVER (PARTITION BY o_orderkey ORDER BY step NULLS LAST, i) AS place FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS i, unnest([CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END, o_orderkey % 50, 7]) AS step, unnest([o_totalprice, 1.0, 2.0]) AS value FROM orders)")
def checkpoint_points(spark, folder):
    cell = lambda s, v: F.struct(s.cast("long").alias("step"), v.alias("value"))
    points = F.array(cell(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.col("o_totalprice")), cell(F.col("o_orderkey") % 50, F.lit(1.0)), cell(F.lit(7), F.lit(2.0)))
    return runs.checkpoint_series(table(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), points.alias("points")), ["run"], "points")


@query("SELECT p_partkey, seed, step, CASE seed WHEN 0 THEN p_retailprice + step ELSE p_size * step END AS value FROM part, (SELECT unnest([0, 1]) AS seed), (SELECT unnest([0, 1, 2]) AS step)")
def tensor_series(spark, folder):
    steps = F.array(F.lit(0), F.lit(1), F.lit(2))
    tensor = F.array(F.transform(steps, lambda s: F.col("p_retailprice") + s), F.transform(steps, lambda s: (F.col("p_size") * s).cast("double")))
    return runs.tensor_rows(table(spark, folder, "part").withColumn("t", tensor), ["p_partkey"], "t")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN 'feature' WHEN l_discount > 0.02 THEN 'behavior' ELSE 'zero' END AS noise FROM lineitem")
def noise_types(spark, folder):
    noise = runs.noise_type(F.col("l_tax") - 0.04, F.col("l_discount") - 0.02)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", noise.alias("noise"))


@query("""WITH m AS (SELECT CASE WHEN l_tax > 0 THEN 'feature' WHEN l_discount > 0 THEN 'behavior' ELSE 'zero' END AS noise_type, greatest(l_tax, l_discount) AS noise_scale, l_returnflag, l_linenumber, avg(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
SELECT noise_type, noise_scale, l_returnflag, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY noise_type, noise_scale, l_returnflag ORDER BY l_quantity DESC, l_linenumber) AS r FROM m) WHERE r = 1""")
def noise_optima(spark, folder):
    return runs.noise_optima(table(spark, folder, "lineitem"), "l_tax", "l_discount", ["l_returnflag"], "l_linenumber", "l_quantity")


@query("SELECT p_brand, p_type, p_size, p_partkey, arg_min(p_name, p_partkey) AS p_name FROM (SELECT p_brand, p_type, p_size, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS m, p_partkey, p_name FROM part) WHERE p_partkey = m GROUP BY ALL")
def unique_settings(spark, folder):
    return runs.unique_experiments(table(spark, folder, "part").drop("p_retailprice"), "p_partkey", ["p_name"])


@query(f"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'forced' WHEN p_size % 5 = 0 THEN 'commands' WHEN name LIKE '%\\_sync' ESCAPE '\\' OR name LIKE '%\\_frozen' ESCAPE '\\' THEN 'suffix' WHEN p_size % 3 = 0 THEN 'existing' ELSE 'default' END AS source,
 CASE WHEN p_size % 7 = 0 THEN 'f' WHEN p_size % 5 = 0 THEN 'a-b' WHEN name LIKE '%\\_sync' ESCAPE '\\' THEN 'sft-rl' WHEN name LIKE '%\\_frozen' ESCAPE '\\' THEN 'sft' WHEN p_size % 3 = 0 THEN 'e' ELSE 'd1-d2' END AS phases FROM {NAMES}""")
def phase_order_sources(spark, folder):
    s, none = F.col("p_size"), F.array().cast("array<string>")
    at = lambda k, *p: F.when(s % k == 0, F.array(*map(F.lit, p))).otherwise(none)
    order = runs.phase_order(at(7, "f"), F.lit(None).cast("array<string>"), at(5, "a", "b"), runs.suffix_phases(F.col("name"), {"_sync": ["sft", "rl"], "_frozen": ["sft"]}), none, at(3, "e"), ["d1", "d2"])
    return names(spark, folder).select("p_partkey", order.alias("x")).select("p_partkey", "x.source", F.array_join("x.order", "-").alias("phases"))


#: Suppliers of a nation as the phases of a run: the i-th one was trained on the model of the i // 2-th, the first on none.
#: Their commands name it in several ways.
PHASES = """SELECT s_nationkey AS run, s_name AS phase, s_suppkey % 3 AS rank, '/runs/' || s_nationkey || '/' || replace(s_name, '#', '_') AS folder, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier"""
#: In the order of a queue: by level, then by the places of all above.
QUEUE = f"""WITH RECURSIVE p AS ({PHASES}),
q AS (SELECT run, phase, i, 0 AS depth, [lpad(CAST(rank AS VARCHAR), 4, '0') || phase] AS path FROM p WHERE i = 1
 UNION ALL SELECT p.run, p.phase, p.i, depth + 1, list_append(path, lpad(CAST(rank AS VARCHAR), 4, '0') || p.phase) FROM q JOIN p ON p.run = q.run AND p.i // 2 = q.i),
o AS (SELECT run, phase, CAST(row_number() OVER (PARTITION BY run ORDER BY depth, path) - 1 AS INTEGER) AS place, count(*) OVER (PARTITION BY run) AS n FROM q)
"""


def phase_commands(spark, folder):
    from pyspark.sql import Window

    phases = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_name").alias("phase"), (F.col("s_suppkey") % 3).alias("rank"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("i"))
    phases = phases.withColumn("folder", F.concat(F.lit("/runs/"), "run", F.lit("/"), F.replace("phase", F.lit("#"), F.lit("_"))))
    a, b = phases.alias("a"), phases.alias("b")
    phases = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.expr("a.i div 2") == F.col("b.i")), "left").select("a.*", F.col("b.phase").alias("_needed"), F.col("b.folder").alias("_model"))
    how = F.col("i") % 4
    option = (
        F.when(F.col("_model").isNull(), F.lit("--model_name=base/model"))
        .when(how == 0, F.concat(F.lit("\\\n  --model_name '"), "_model", F.lit("/checkpoint-50'")))
        .when(how == 1, F.concat(F.lit('--model_name="'), "_model", F.lit('/./logs/../checkpoint-7"')))
        .when(how == 2, F.concat(F.lit("--model_name elsewhere/"), F.regexp_replace("_needed", "#", r"\\#"), F.lit("/checkpoint-9")))
        .otherwise(F.concat(F.lit("--model_name "), "_model"))
    )
    return phases.select("run", "phase", "rank", "folder", "_needed", F.concat(F.lit("python train.py --note 'a \"b\"' --lr 1e-5 "), option, F.lit(" --model_name ignored --seed 3\n")).alias("command"))


@query(QUEUE + "SELECT run, phase, place FROM o")
def phase_placements(spark, folder):
    phases = phase_commands(spark, folder)
    return runs.phase_places(phases, phases.select("run", "phase", F.col("_needed").alias("needed")).dropna(), "run", "phase", "needed", "rank")


@query(QUEUE + "SELECT run, string_agg(phase, '>' ORDER BY place) AS phases FROM o WHERE n > 1 GROUP BY run")
def command_orders(spark, folder):
    """The same order, read from the phases' commands."""
    out = runs.command_order(phase_commands(spark, folder), "run", "phase", "rank", "folder", "command")
    return out.select("run", F.array_join("phases", ">").alias("phases"))


@query("""WITH RECURSIVE d AS (SELECT event_id, CAST('{"t": "' || event_type || '", "v": "' || CAST(user_id AS VARCHAR) || '", "on": true, "x": ' || repeat('{"n": ', CAST(event_id % 14 AS INTEGER)) || props || repeat('}', CAST(event_id % 14 AS INTEGER)) || '}' AS JSON) AS j FROM events),
w AS (SELECT event_id, CAST(NULL AS VARCHAR) AS path, j FROM d
 UNION ALL SELECT event_id, concat_ws('.', path, k), json_extract(j, '$."' || k || '"') FROM (SELECT event_id, path, j, unnest(json_keys(j)) AS k FROM w WHERE json_type(j) = 'OBJECT'))
SELECT event_id, path, TRY_CAST(json_extract_string(j, '$') AS DOUBLE) AS value FROM w WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') AND TRY_CAST(json_extract_string(j, '$') AS DOUBLE) IS NOT NULL""")
def nested_leaves(spark, folder):
    """Numeric leaves up to 15 levels deep."""
    deep = F.expr("int(event_id % 14)")
    text = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "v": "'), F.col("user_id").cast("string"), F.lit('", "on": true, "x": '), F.repeat(F.lit('{"n": '), deep), "props", F.repeat(F.lit("}"), deep), F.lit("}"))
    return runs.flat_json(table(spark, folder, "events").select("event_id", text.alias("j")), ["event_id"], "j")


def tree(spark, folder):
    """A prefix tree: the root's children are the regions, theirs the nations, with uneven probabilities."""
    from pyspark.sql import Window

    w = Window.partitionBy("state")
    top = table(spark, folder, "region").select(F.lit(0).cast("long").alias("state"), F.lit(0).alias("depth"), (F.col("r_regionkey") + 1).cast("long").alias("child"), (F.col("r_regionkey") + 1).cast("double").alias("n"))
    low = table(spark, folder, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("state"), F.lit(1).alias("depth"), (F.col("n_nationkey") + 100).cast("long").alias("child"), (F.col("n_nationkey") + 1).cast("double").alias("n"))
    return top.unionByName(low).withColumn("p", F.col("n") / F.sum("n").over(w)).select("state", "depth", "child", "p")


TREE = """t AS (SELECT 0 AS state, 0 AS depth, r_regionkey + 1 AS child, (r_regionkey + 1.0) / sum(r_regionkey + 1.0) OVER () AS p FROM region
 UNION ALL SELECT n_regionkey + 1, 1, n_nationkey + 100, (n_nationkey + 1.0) / sum(n_nationkey + 1.0) OVER (PARTITION BY n_regionkey) FROM nation)"""


@query(f"""WITH {TREE}, e AS (SELECT *, sum(p) OVER (PARTITION BY state ORDER BY child) AS top, lead(child) OVER (PARTITION BY state ORDER BY child) IS NULL AS last FROM t),
w AS (SELECT range AS walk, CAST(('0x' || substr(sha256('occ' || chr(10) || range || chr(10) || 0), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u0, CAST(('0x' || substr(sha256('occ' || chr(10) || range || chr(10) || 1), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u1 FROM range(2000)),
a AS (SELECT walk, u1, child AS state FROM w JOIN e ON e.state = 0 AND u0 >= top - p AND (u0 < top OR last)), b AS (SELECT walk, child AS state FROM a JOIN e USING (state) WHERE u1 >= top - p AND (u1 < top OR last))
SELECT 0 AS state, 0 AS depth, 1.0 AS share UNION ALL SELECT state, 1, count(*) / 2000.0 FROM a GROUP BY state UNION ALL SELECT state, 2, count(*) / 2000.0 FROM b GROUP BY state""")
def walk_shares(spark, folder):
    return runs.sampled_occupancy(tree(spark, folder), 2, 2000, "occ")


@query(f"WITH {TREE} SELECT 0 AS state, 0 AS depth, 1.0 AS mass UNION ALL SELECT child, 1, p FROM t WHERE depth = 0 UNION ALL SELECT b.child, 2, a.p * b.p FROM t a JOIN t b ON b.state = a.child WHERE a.depth = 0")
def exact_occupancy(spark, folder):
    return runs.occupancy(tree(spark, folder), 2)


#: A state's children as vectors: the tree's own probabilities, and those of another rule.
STATES = f"""{TREE}, u AS (SELECT *, (child % 7 + 1.0) / sum(child % 7 + 1.0) OVER (PARTITION BY state) AS q FROM t),
s AS (SELECT state, depth, sum(q * ln(q / p)) AS forward_kl, 0.5 * sum(abs(p - q)) AS tv, -sum(p * ln(p)) AS student_entropy, sqrt(sum((p - q) * (p - q))) AS forward_norm, sum(p * ln(p / q)) AS k, list(p) AS ps, list(q) AS qs FROM u GROUP BY ALL),
g AS (SELECT u.state, sum((p - q) * p * (ln(p / q) - k)) AS d, sqrt(sum(p * p * (ln(p / q) - k) ** 2)) AS n FROM u JOIN s USING (state) GROUP BY u.state),
m AS (SELECT 0 AS state, 0 AS depth, 1.0 AS mass UNION ALL SELECT child, 1, p FROM t WHERE depth = 0)"""


@query(f"""WITH {STATES} SELECT sum(mass * forward_kl) / 2 AS forward_kl, sum(mass * tv) / 2 AS tv, sum(mass * student_entropy) / 2 AS student_entropy, sum(mass * forward_norm) / 2 AS forward_norm,
 sum(mass * d / (forward_norm * n)) FILTER (forward_norm * n > 1e-20) / sum(mass) FILTER (forward_norm * n > 1e-20) AS cosine, sum(mass * tv) FILTER (state % 2 = 1) / sum(mass) FILTER (state % 2 = 1) AS tv_held_out
FROM s JOIN g USING (state) JOIN m USING (state, depth)""")
def occupancy_geometry(spark, folder):
    """Geometry of the tree's states, weighted by how often they are met; states with odd numbers are held out."""
    from pyspark.sql import Window

    edges = tree(spark, folder)
    edges = edges.withColumn("w", F.col("child") % 7 + 1.0).withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy("state")))
    lists = edges.groupBy("state", "depth").agg(F.array_sort(F.collect_list(F.struct("child", "p", "q"))).alias("x"))
    geometry = runs.state_geometry(F.col("x.p"), F.col("x.q"), F.col("x.q"))
    states = lists.select("state", "depth", (F.col("state") % 2 == 0).alias("trained"), geometry.alias("g")).select("state", "depth", "trained", "g.*")
    return runs.occupancy_means(states, runs.occupancy(edges, 1), ["forward_kl", "tv", "student_entropy", "forward_norm"], 2, ["cosine"], ["tv"])


@query(f"WITH {TREE} SELECT (SELECT sum(a.p * b.p) FROM t a JOIN t b ON b.state = a.child WHERE a.depth = 0 AND a.child % 2 = 0 AND b.child % 2 = 0) AS supported, (SELECT a.p * b.p FROM t a JOIN t b ON b.state = a.child WHERE a.depth = 0 AND a.child % 5 = 0 ORDER BY a.p DESC, b.p DESC LIMIT 1) * 0 AS greedy")
def path_successes(spark, folder):
    """Only even children are supported; the likeliest first step is to an odd one, so the greedy path isn't."""
    return audits.path_success(tree(spark, folder).withColumn("supported", F.col("child") % 2 == 0), 2)


STEPS, TRIES = 6, 20


@query(f"""WITH a AS (SELECT s_suppkey, unnest(range({TRIES})) AS attempt FROM supplier),
d AS (SELECT s_suppkey, attempt, list_transform(range(1, {STEPS + 1}), lambda k: CAST(floor(CAST(('0x' || substr(sha256('walk' || chr(10) || s_suppkey || chr(10) || attempt || chr(10) || k), 1, 13)) AS BIGINT) / 4503599627370496.0 * 4) AS INTEGER)) AS dirs FROM a),
p AS (SELECT s_suppkey, attempt, list_transform(range(0, {STEPS + 1}), lambda k: [coalesce(len(list_filter(dirs[1:k], lambda x: x = 0)), 0) - coalesce(len(list_filter(dirs[1:k], lambda x: x = 2)), 0), coalesce(len(list_filter(dirs[1:k], lambda x: x = 1)), 0) - coalesce(len(list_filter(dirs[1:k], lambda x: x = 3)), 0)]) AS path FROM d),
f AS (SELECT s_suppkey, min(attempt) AS attempt, arg_min(path, attempt) AS path FROM p WHERE len(list_distinct(path)) = {STEPS + 1} GROUP BY s_suppkey)
SELECT s_suppkey, CAST(attempt AS INTEGER) AS attempt, path[{STEPS + 1}][1] AS x, path[{STEPS + 1}][2] AS y FROM f""")
def free_walks(spark, folder):
    found = runs.free_paths(table(spark, folder, "supplier").select("s_suppkey"), "s_suppkey", STEPS, "walk", TRIES)
    return found.select("s_suppkey", "attempt", F.element_at("path", -1)["x"].alias("x"), F.element_at("path", -1)["y"].alias("y"))


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS b_y FROM lineitem GROUP BY ALL),
w AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS wa, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s) SELECT l_returnflag, round(my - wa * ma - wb * mb, 3) AS base, round(wa, 5) AS quantity, round(wb, 3) AS discount, n FROM w""")
def least_squares_fits(spark, folder):
    fits = aggregates.least_squares(table(spark, folder, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice")
    at = lambda i, digits: F.round(F.element_at("coefficients", i), digits)
    return fits.select("l_returnflag", at(1, 3).alias("base"), at(2, 5).alias("quantity"), at(3, 3).alias("discount"), "n")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 <> 0 THEN value END NULLS LAST, event_id) AS place FROM events")
def null_last_places(spark, folder):
    rows = table(spark, folder, "events").withColumn("v", F.when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 == 2, F.lit(None)).otherwise(F.col("value")))
    kept = rows.withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")).when(F.col("event_id") % 2 == 0, F.lit(float("nan"))))
    return ordered.placed_null_last(kept, ["user_id"], "v", "event_id").select("event_id", "place")


@query("SELECT event_id, value - base AS delta FROM events JOIN (SELECT user_id, event_type, min(value) FILTER (event_id < 100) AS base FROM events GROUP BY ALL) USING (user_id, event_type)")
def deltas_from_lowest(spark, folder):
    rows = ordered.delta_from_lowest(table(spark, folder, "events"), ["user_id", "event_type"], "value", F.col("event_id") < 100)
    return rows.select("event_id", "delta")


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN least(greatest(p_partkey / p_size, 0.0), 1.0) END AS fraction, CASE WHEN p_size = 0 THEN '0e0' WHEN p_size % 10 = 0 THEN p_size // 10 || 'e-4' WHEN p_size < 10 THEN p_size || 'e-5' ELSE p_size // 10 || '.' || p_size % 10 || 'e-4' END AS rate, CASE WHEN p_size % 10 = 0 THEN CAST(p_size // 10 AS VARCHAR) ELSE p_size // 10 || '.' || p_size % 10 END AS number FROM part")
def short_rates(spark, folder):
    rate, number = numbers.short_rate(F.col("p_size") / 100000.0), numbers.compact(F.col("p_size") / 10.0)
    return table(spark, folder, "part").select("p_partkey", numbers.progress_fraction(F.col("p_partkey"), F.col("p_size")).alias("fraction"), rate.alias("rate"), number.alias("number"))


#: Line items as runs of cells (parts of an order) from two sources; some rows differ between them, some cells lack a seed.
RECOVERED = """r AS (SELECT o_custkey AS cell, o_orderkey % 3 AS seed, o_totalprice AS v, o_orderkey % 2 AS source FROM orders),
c AS (SELECT cell, seed, count(DISTINCT v) AS versions FROM r GROUP BY ALL), w AS (SELECT cell FROM c GROUP BY cell HAVING count(*) = 3 AND max(versions) = 1),
h AS (SELECT DISTINCT o_custkey AS cell, o_orderkey % 3 AS seed FROM orders WHERE o_orderstatus <> 'P'), t AS (SELECT cell FROM h GROUP BY cell HAVING count(*) = 3)"""


def recovery(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("cell"), (F.col("o_orderkey") % 3).cast("string").alias("seed"), F.floor(F.col("o_totalprice") / 300000).alias("v"), (F.col("o_orderkey") % 2).alias("source"), "o_orderstatus")
    cells = table(spark, folder, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 2 == 0).alias("needs_history"))
    return rows.drop("o_orderstatus"), rows.filter("o_orderstatus <> 'P'").select("cell", "seed"), cells


@query(f"WITH {RECOVERED.replace('o_totalprice AS v', 'floor(o_totalprice / 300000) AS v')} SELECT c_custkey AS cell, c_nationkey AS place FROM customer WHERE c_custkey IN (SELECT cell FROM w) AND (c_custkey % 2 = 1 OR c_custkey IN (SELECT cell FROM t))")
def recovered_cells(spark, folder):
    rows, history, cells = recovery(spark, folder)
    return audits.recovered_cells(rows, history, cells, "cell", "seed", [0, 1, 2], "source")


@query(f"WITH {RECOVERED.replace('o_totalprice AS v', 'floor(o_totalprice / 300000) AS v')} SELECT cell, CAST(seed AS VARCHAR) AS seed, CAST(max(v) AS BIGINT) AS v FROM r WHERE cell IN (SELECT cell FROM w) AND (cell % 2 = 1 OR cell IN (SELECT cell FROM t)) AND cell IN (SELECT c_custkey FROM customer) GROUP BY ALL")
def recovered_runs(spark, folder):
    """One row for each seed of a recovered cell; what several sources give is the same."""
    rows, history, cells = recovery(spark, folder)
    complete = audits.recovered_cells(rows, history, cells, "cell", "seed", [0, 1, 2], "source")
    return audits.recovered_rows(rows, complete, ["cell", "seed"], "cell", "seed", [0, 1, 2], "source").select("cell", "seed", "v")


@query()
def epoch_variations(spark, folder):
    """The prompt variation of each customer in each of five epochs: the Mersenne Twister has no SQL."""
    rows = table(spark, folder, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("epoch"))
    base = F.pmod("c_custkey", F.lit(6)) + 1
    found = seeded.epoch_variation(range(1, 7), base, F.col("epoch"), 37, "science", F.col("c_custkey"), "gold_answer")
    return rows.select("c_custkey", "epoch", found.alias("variation"))


@query()
def backbone_paths(spark, folder):
    """A path over parts' types for each part, as many hops as its size asks for; drawn, so without SQL."""
    names = [f"point {k}" for k in range(30)]
    seed = seeded.seed_of("graph", F.col("p_partkey"))
    path = seeded.backbone(names, {1: 0.6, 2: 0.3, 3: 0.1})(seed, F.col("p_size") % 12 + 1, F.lit(0), F.lit(0))
    return table(spark, folder, "part").select("p_partkey", F.posexplode(path).alias("hop", "e")).select("p_partkey", "hop", "e.*")


@query("""WITH e AS (SELECT user_id AS run, event_type AS phase, event_id % 6 + 1 AS step, 'd' || event_id % 2 AS dataset, max(CASE WHEN event_id % 10 > 0 THEN value END) AS accuracy FROM events WHERE NOT (user_id % 4 = 0 AND event_type = 'click') GROUP BY ALL),
l AS (SELECT run, phase, max(step) AS n FROM e GROUP BY ALL), o AS (SELECT run, phase, coalesce(sum(n) OVER (PARTITION BY run ORDER BY phase DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l)
SELECT run, dataset, CAST(o + step AS BIGINT) AS global_step, phase, accuracy FROM e JOIN o USING (run, phase) UNION ALL SELECT DISTINCT run, dataset, 0, NULL, run / 2.0 FROM e WHERE run % 3 > 0""")
def combined_curves(spark, folder):
    """Phases in falling order of their names; some runs lack one, every third has no baseline."""
    from pyspark.sql import Window

    rows = table(spark, folder, "events").filter("not (user_id % 4 = 0 and event_type = 'click')").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), (F.col("event_id") % 6 + 1).alias("step"), F.concat(F.lit("d"), F.col("event_id") % 2).alias("dataset"), F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("v"))
    points = rows.groupBy("run", "phase", "step", "dataset").agg(F.max("v").alias("accuracy"))
    phases = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(F.col("phase").desc())))
    baselines = rows.select("run", "dataset").distinct().withColumn("accuracy", F.when(F.col("run") % 3 > 0, F.col("run") / 2))
    return runs.combined_curve(points, phases, baselines, "run", "phase", "place", "dataset")
