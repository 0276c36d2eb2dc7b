"""Queries over factor grids: TPC-H-like tables stand in for cells of experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import numbers
from sparkloom.operators import aggregates, joins, ordered, runs, stats

from .registry import query, table

L = "(SELECT l_suppkey AS task, l_linenumber AS lr, l_returnflag AS role, l_linestatus AS side, l_discount AS rate, l_partkey AS seed, l_extendedprice AS acq, l_quantity AS ret FROM lineitem) l"


def cells(spark, folder):
    """lineitem as runs: task, lr, role, side, rate, seed and two outcomes."""
    names = {"l_suppkey": "task", "l_linenumber": "lr", "l_returnflag": "role", "l_linestatus": "side", "l_discount": "rate", "l_partkey": "seed", "l_extendedprice": "acq", "l_quantity": "ret"}
    return table(spark, folder, "lineitem").select(*(F.col(k).alias(v) for k, v in names.items()))


def paired(spark, folder):
    """role and task with the difference of the two sides' mean outcomes by learning rate."""
    pairs = joins.matched_pairs(cells(spark, folder), F.col("side") == "F", ["role", "task", "lr"], ["acq"])
    return pairs.select("role", "task", "lr", F.round(F.col("acq_a") - F.col("acq_b"), 6).alias("d"))


@query()
def signed_rank_tests(spark, folder):
    """Flagship: matched pairs, a signed-rank test per role and learning rate, Holm-adjusted within the role.

    The p-values' null distribution has no SQL; tests hold it against published values and brute force.
    """
    return stats.tests_with_holm(paired(spark, folder), ["role"], "lr", "d")


PAIRS = f"""(WITH m AS (SELECT role, task, lr, avg(acq) FILTER (side = 'F') AS a, avg(acq) FILTER (side = 'O') AS b FROM {L} GROUP BY ALL)
SELECT role, task, lr, round(a - b, 6) AS d FROM m WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"""WITH r AS (SELECT role, lr, d, rank() OVER (PARTITION BY role, lr, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY role, lr, d = 0, abs(d)) - 1) / 2.0 AS k FROM {PAIRS} p)
SELECT role, lr, count(*) AS n_pairs, median(d) AS median_d, CAST(coalesce(sum(k) FILTER (d > 0), 0) AS DOUBLE) AS w_plus FROM r GROUP BY role, lr""")
def signed_rank_sums(spark, folder):
    return stats.wilcoxon(paired(spark, folder), ["role", "lr"], "d").drop("p")


@query(f"SELECT role, task, lr, avg(acq) FILTER (side = 'F') AS acq_a, avg(acq) FILTER (side = 'O') AS acq_b, avg(ret) FILTER (side = 'F') AS ret_a, avg(ret) FILTER (side = 'O') AS ret_b FROM {L} GROUP BY role, task, lr HAVING count(*) FILTER (side = 'F') > 0 AND count(*) FILTER (side = 'O') > 0")
def matched_pairs(spark, folder):
    return joins.matched_pairs(cells(spark, folder), F.col("side") == "F", ["role", "task", "lr"], ["acq", "ret"])


@query(f"WITH c AS (SELECT task, role, rate, avg(acq) AS acq FROM {L} GROUP BY ALL) SELECT a.task, a.role, a.rate, a.acq AS acq_a, b.acq AS acq_b FROM c a JOIN c b ON a.task = b.task AND a.role = b.role AND b.rate = 0 WHERE a.rate <> 0")
def pairs_against_frozen(spark, folder):
    return joins.against_level(cells(spark, folder), "rate", 0.0, ["task", "role"], ["acq"])


@query(f"SELECT task, avg(acq) FILTER (role = 'A') - avg(acq) FILTER (role = 'R') AS d_acq FROM {L} GROUP BY task HAVING count(*) FILTER (role = 'A') > 0 AND count(*) FILTER (role = 'R') > 0")
def method_contrast(spark, folder):
    return joins.contrast(cells(spark, folder), "role", "A", "R", ["task"], ["acq"])


@query(f"WITH w AS (SELECT task, lr, avg(acq) FILTER (role = 'A') AS a, avg(acq) FILTER (role = 'N') AS n, avg(acq) FILTER (role = 'R') AS r FROM {L} GROUP BY ALL HAVING a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL) SELECT task, lr, 'A' AS route, a AS value FROM w UNION ALL SELECT task, lr, 'N', n FROM w UNION ALL SELECT task, lr, 'R', r FROM w")
def route_rows(spark, folder):
    return joins.routes(cells(spark, folder), "role", ["A", "N", "R"], ["task", "lr"], "acq")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def one_to_one_lookup(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    left = nation.select("n_nationkey", "n_name")
    right = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return joins.one_to_one(left, right, ["n_nationkey"])


@query(f"SELECT role, side, avg(acq) AS acq_mean, median(acq) AS acq_median, stddev_samp(acq) AS acq_std, count(acq) AS acq_count, avg(ret) AS ret_mean, median(ret) AS ret_median, stddev_samp(ret) AS ret_std, count(ret) AS ret_count FROM {L} GROUP BY role, side")
def cell_summaries(spark, folder):
    return aggregates.cell_summary(cells(spark, folder), ["role", "side"], ["acq", "ret"])


@query(f"SELECT role, count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) AS share_positive, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0 END) AS share_negative, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)) AS low, avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)) AS high FROM {PAIRS} p GROUP BY role")
def normal_intervals(spark, folder):
    return aggregates.normal_summary(paired(spark, folder), ["role"], "d").drop("p")


@query(f"SELECT role, 'side' AS \"column\", count(DISTINCT side) AS n FROM {L} GROUP BY role HAVING count(DISTINCT side) > 1")
def varying_columns(spark, folder):
    return aggregates.varying(cells(spark, folder), ["role"], ["side"])


@query(f"SELECT role, count(*) AS n_rows, count(DISTINCT lr) AS n_seeds, min(lr) AS least, max(lr) AS largest, CAST(len(list_filter(range(0, 6), lambda x: NOT list_contains(list(DISTINCT lr), x))) AS INTEGER) AS n_missing, CAST(count(DISTINCT lr) FILTER (lr > 5) AS INTEGER) AS n_unexpected FROM {L} GROUP BY role")
def seed_coverage(spark, folder):
    return aggregates.seed_coverage(cells(spark, folder), ["role"], "lr", 0, 5)


@query("SELECT o_custkey FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 3)) AS seen, count(*) AS n FROM orders GROUP BY o_custkey) WHERE seen = [0, 1, 2] AND n = 3")
def complete_cells(spark, folder):
    rows = table(spark, folder, "orders").withColumn("seed", F.col("o_orderkey") % 3)
    return aggregates.complete_cells(rows, ["o_custkey"], "seed", [0, 1, 2])


@query(f"SELECT role, CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind END AS kind, count(d) AS n_pairs, median(d) AS median_d FROM (SELECT role, d, CASE WHEN task % 2 = 0 THEN 'CONTRADICTORY' ELSE 'ORDINARY' END AS kind FROM {PAIRS} p) GROUP BY GROUPING SETS ((role), (role, kind))")
def pooled_rows(spark, folder):
    kind = F.when(F.col("task") % 2 == 0, "CONTRADICTORY").otherwise("ORDINARY")
    return stats.pooled(paired(spark, folder), ["role"], kind, "d")


@query(f"WITH f AS (SELECT *, seed % 2 AS fold FROM {L}), m AS (SELECT role, lr, fold, rate, avg(acq) AS m FROM f GROUP BY ALL), c AS (SELECT role, lr, 1 - fold AS fold, rate FROM (SELECT *, row_number() OVER (PARTITION BY role, lr, fold ORDER BY m DESC, rate) AS k FROM m) WHERE k = 1) SELECT role, lr, fold, rate, count(*) AS n, avg(acq) AS acq FROM f JOIN c USING (role, lr, fold, rate) GROUP BY ALL")
def cross_fitted_choice(spark, folder):
    return stats.cross_fit(cells(spark, folder), ["role", "lr"], "seed", "rate", "acq").groupBy("role", "lr", "fold", "rate").agg(F.count("*").alias("n"), F.avg("acq").alias("acq"))


POINTS = f"(SELECT role, side, lr, rate, avg(acq) AS gain, avg(ret) AS loss FROM {L} GROUP BY ALL)"


def outcome_points(spark, folder):
    return cells(spark, folder).groupBy("role", "side", "lr", "rate").agg(F.avg("acq").alias("gain"), F.avg("ret").alias("loss"))


@query(f"WITH p AS {POINTS}, s AS (SELECT role, side, min(gain) AS lo, max(gain) AS hi FROM p GROUP BY ALL), c AS (SELECT role, max(lo) AS lo, min(hi) AS hi FROM s GROUP BY role HAVING max(lo) <= min(hi)), v AS (SELECT role, CAST(q AS DOUBLE) AS q, lo + q * (hi - lo) AS level FROM c, (SELECT unnest([0, 0.25, 0.5, 0.75, 1]) AS q)) SELECT p.role, p.side, v.q, v.level, min(p.loss) AS least_loss FROM p JOIN v ON p.role = v.role AND p.gain >= v.level GROUP BY ALL")
def matched_frontiers(spark, folder):
    return stats.matched_frontier(outcome_points(spark, folder), ["role"], "side", "gain", "loss")


@query(f"SELECT role, side, lr, rate FROM (SELECT *, min(loss) OVER (PARTITION BY role, side ORDER BY gain DESC, loss ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM {POINTS}) WHERE least IS NULL OR loss < least - 1e-12")
def pareto_frontier(spark, folder):
    return ordered.pareto(outcome_points(spark, folder), ["role", "side"], "gain", "loss").select("role", "side", "lr", "rate")


@query(f"SELECT role, side, lr, rate, gain FROM (SELECT *, row_number() OVER (PARTITION BY role, side ORDER BY gain DESC, rate, lr) AS k FROM {POINTS}) WHERE k = 1")
def best_points(spark, folder):
    return ordered.best(outcome_points(spark, folder), ["role", "side"], "gain", "rate", "lr").select("role", "side", "lr", "rate", "gain")


@query(f"WITH p AS (SELECT role, rate, avg(acq) AS v FROM {L} GROUP BY ALL), k AS (SELECT role, arg_max(rate, v) AS peak, max(v) AS best, arg_min(v, rate) AS start FROM p GROUP BY role) SELECT role, rate, v FROM p JOIN k USING (role) WHERE rate <= peak AND best > start")
def sweep_prefixes(spark, folder):
    rows = cells(spark, folder).groupBy("role", "rate").agg(F.avg("acq").alias("v"))
    return ordered.sweep_prefix(rows, ["role"], "rate", "v")


@query(f"WITH p AS (SELECT role, lr, count(DISTINCT rate) AS n_rates, max(ret) AS best FROM {L} GROUP BY ALL), q AS (SELECT *, least(3, max(n_rates) OVER (PARTITION BY role)) AS need FROM p) SELECT role, lr, n_rates, best FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY best DESC, lr) AS k FROM q WHERE n_rates >= need) WHERE k = 1")
def covered_choices(spark, folder):
    return ordered.covered_choice(cells(spark, folder), ["role"], "lr", "rate", "ret")


@query(f"SELECT task, max(acq) FILTER (side = 'F') - max(acq) FILTER (side = 'O') AS d_acq FROM {L} GROUP BY task HAVING d_acq IS NOT NULL")
def endpoint_contrasts(spark, folder):
    return stats.endpoint_contrast(cells(spark, folder), ["task"], "side", ["acq"], "O", "F")


@query(f"WITH b AS (SELECT role, rate, avg(acq) FILTER (side = 'O') AS lo, avg(acq) FILTER (side = 'F') AS hi FROM {L} GROUP BY ALL HAVING lo IS NOT NULL AND hi IS NOT NULL) SELECT role, rate, (lo + hi) / 2 AS objective, hi - lo AS contrast FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY (lo + hi) / 2 DESC, rate) AS k FROM b) WHERE k = 1")
def common_choices(spark, folder):
    return stats.common_choice(cells(spark, folder), ["role"], "rate", "side", "acq", "O", "F")


@query("SELECT c_custkey, coalesce(o.n, 0) AS n_orders, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n <> 10 THEN 'row_count_mismatch' ELSE 'complete' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON c_custkey = o_custkey")
def completion_status(spark, folder):
    want = table(spark, folder, "customer").select("c_custkey", F.lit(10).alias("want"))
    have = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return stats.completion(want, have, ["c_custkey"], "want", "n_orders").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "status")


@query("SELECT 'o_orderstatus' AS control, count(*) AS n_pairs, count(*) FILTER (a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus) AS n_equal FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1")
def paired_invariance(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return stats.paired_invariance(rows, rows.withColumn("o_orderkey", F.col("o_orderkey") + 1), "o_orderkey", ["o_orderstatus"])


P_SQL = f"(SELECT role, lr, abs(avg(d)) / (abs(avg(d)) + stddev_samp(d)) AS p FROM {PAIRS} x GROUP BY ALL)"


def pseudo_p(spark, folder):
    """Numbers between 0 and 1 as p-values, for the adjustments."""
    size = F.abs(F.avg("d"))
    return paired(spark, folder).groupBy("role", "lr").agg((size / (size + F.stddev_samp("d"))).alias("p"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY p, lr) AS k, count(*) OVER (PARTITION BY role) AS m FROM {P_SQL}) SELECT role, lr, p, least(1, max((m - k + 1) * p) OVER (PARTITION BY role ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p_holm FROM r")
def holm_adjusted(spark, folder):
    return ordered.holm(pseudo_p(spark, folder), ["role"], "p", "lr")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY p, lr) AS k, count(*) OVER (PARTITION BY role) AS m FROM {P_SQL}) SELECT role, lr, p, greatest(0, least(1, min(m * p / k) OVER (PARTITION BY role ORDER BY k DESC ROWS UNBOUNDED PRECEDING))) AS q FROM r")
def benjamini_hochberg_adjusted(spark, folder):
    return ordered.benjamini_hochberg(pseudo_p(spark, folder), ["role"], "p", "lr")


@query("SELECT o_orderkey, o_totalprice - m AS above FROM orders JOIN (SELECT o_orderpriority, median(o_totalprice) AS m FROM orders GROUP BY ALL) USING (o_orderpriority)")
def median_baselines(spark, folder):
    rows = ordered.median_baseline(table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice")
    return rows.select("o_orderkey", (F.col("o_totalprice") - F.col("baseline")).alias("above"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax > 0.02 THEN (l_discount - 0.02) / (l_tax - 0.02) END AS headroom, CASE WHEN l_tax > 0.02 THEN greatest(0, least(1, (l_discount - 0.02) / (l_tax - 0.02))) END AS bounded, (l_extendedprice - l_quantity) / nullif(abs(l_quantity), 0) AS relative, greatest(0, least(1, l_linenumber / 5.0)) AS progress FROM lineitem")
def progress_measures(spark, folder):
    now, base, top = F.col("l_discount"), F.lit(0.02), F.col("l_tax")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", numbers.headroom_progress(now, base, top).alias("headroom"), numbers.bounded_progress(now, base, top).alias("bounded"),
        numbers.relative_delta(F.col("l_extendedprice"), F.col("l_quantity")).alias("relative"), numbers.progress_fraction(F.col("l_linenumber"), F.lit(5.0)).alias("progress"),
    )


@query("SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey < 2")
def left_lookup(spark, folder):
    nation = table(spark, folder, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, folder, "supplier").join(F.broadcast(nation), "s_nationkey", "left").select("s_suppkey", "n_name")  # 25 nations


@query("SELECT a.k AS n_nationkey, a.k2 AS r FROM (SELECT n.n_nationkey AS k, x AS k2 FROM nation n, (SELECT unnest([0, 1, 2]) AS x)) a WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = a.k AND c.c_custkey % 3 = a.k2 AND c.c_acctbal > 9000)")
def missing_cells(spark, folder):
    levels = [r[0] for r in table(spark, folder, "nation").select("n_nationkey").collect()]  # 25 rows: a design's factor
    design = stats.grid(spark, {"n_nationkey": levels, "r": [0, 1, 2]})
    done = table(spark, folder, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 3).alias("r")).distinct()
    return stats.missing_cells(design, done, ["n_nationkey", "r"])


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'ECONOMY' WHEN p_type LIKE 'LARGE%' THEN 'LARGE' WHEN p_type LIKE 'LARGE B%' THEN 'LARGE B' ELSE p_type END AS method FROM part")
def prefix_methods(spark, folder):
    known = spark.createDataFrame([("ECONOMY",), ("LARGE",)], "prefix string")
    return runs.longest_prefix(table(spark, folder, "part").select("p_partkey", "p_type"), "p_type", known, "prefix").select("p_partkey", "method")


@query("SELECT l_returnflag AS role, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag")
def pricing_summary(spark, folder):
    rows = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy(F.col("l_returnflag").alias("role")).agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, l_returnflag, avg(l_quantity) AS g, avg(l_extendedprice) AS f FROM lineitem GROUP BY ALL),
p AS (SELECT l_suppkey, l_linenumber, max(g) FILTER (l_returnflag = 'R') AS rg, max(f) FILTER (l_returnflag = 'R') AS rf, max(g) FILTER (l_returnflag = 'A') AS fg, max(f) FILTER (l_returnflag = 'A') AS ff, max(g) FILTER (l_returnflag = 'N') AS zg, max(f) FILTER (l_returnflag = 'N') AS zf FROM c GROUP BY ALL)
SELECT l_suppkey, l_linenumber, rg - zg AS acquisition_gain, rf - zf AS forgetting_cost, fg - rg AS forward_acquisition_gain, ff - rf AS forward_forgetting_cost, rg AS reverse_alpha, fg AS forward_alpha FROM p WHERE rg IS NOT NULL AND fg IS NOT NULL AND zg IS NOT NULL""")
def lever_comparisons(spark, folder):
    """Return flags as reverse, forward and frozen; cells that lack one of the three fall out."""
    keys = ["l_suppkey", "l_linenumber"]
    cells = table(spark, folder, "lineitem").groupBy(*keys, "l_returnflag").agg(F.avg("l_quantity").alias("gain"), F.avg("l_extendedprice").alias("forgetting")).withColumn("alpha", F.col("gain"))
    chosen = cells.withColumn("direction", F.when(F.col("l_returnflag") == "R", "reverse").when(F.col("l_returnflag") == "A", "forward"))
    return joins.lever_comparison(chosen, cells.filter("l_returnflag = 'N'"), keys, "direction", "alpha", "gain", "forgetting")
