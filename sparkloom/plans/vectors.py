"""Queries over probability vectors: embeddings as logits, the next row's as the teacher's."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import vectors as v

from .registry import query, table


def policies(spark, folder):
    """vec_id with the student's and the teacher's probabilities."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", v.softmax(F.col("embedding")).alias("p"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("teacher"), F.col("p").alias("q"))
    return rows.join(other, "vec_id").select("vec_id", "embedding", "teacher", "p", "q")


LONG = """WITH e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e),
b AS (SELECT s.vec_id, s.i, s.x, t.x AS y, s.p, t.p AS q, (s.p + t.p) / 2 AS m, 0.7 * s.p + 0.3 * t.p AS m3 FROM s JOIN s t ON t.vec_id = s.vec_id + 1 AND t.i = s.i)
"""


@query(LONG + "SELECT vec_id, -sum(p * ln(p)) AS entropy FROM s GROUP BY vec_id")
def entropies(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", v.entropy(v.softmax(F.col("embedding"))).alias("entropy"))


@query(LONG + "SELECT vec_id, sum(q * (ln(q) - ln(p))) AS forward_kl, sum(p * (ln(p) - ln(q))) AS reverse_kl, sum(q * (ln(q) - ln(m)) + p * (ln(p) - ln(m))) / 2 AS jsd, sum(0.3 * q * (ln(q) - ln(m3)) + 0.7 * p * (ln(p) - ln(m3))) AS jsd3, sum(abs(p - q)) / 2 AS tv, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine FROM b GROUP BY vec_id")
def divergences(spark, folder):
    p, q = F.col("p"), F.col("q")
    return policies(spark, folder).select("vec_id", v.kl(q, p).alias("forward_kl"), v.kl(p, q).alias("reverse_kl"), v.jsd(p, q).alias("jsd"), v.jsd(p, q, 0.3).alias("jsd3"), v.total_variation(p, q).alias("tv"), v.cosine(F.col("embedding"), F.col("teacher")).alias("cosine"))


@query(LONG + "SELECT vec_id, avg(exp(ln(q) - ln(p)) - (ln(q) - ln(p)) - 1) AS k3, avg(least(exp(ln(p) - ln(q)), 2.0)) AS ratio, -ln(max(p) FILTER (i = 1)) AS cross_entropy FROM b GROUP BY vec_id")
def token_estimates(spark, folder):
    gap = F.zip_with("q", "p", lambda q, p: F.log(q) - F.log(p))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return policies(spark, folder).select("vec_id", mean(F.transform(gap, v.k3)).alias("k3"), mean(F.transform(gap, lambda r: v.importance_ratio(-r, F.lit(0.0), 2.0))).alias("ratio"), (-F.log(F.element_at("p", 1))).alias("cross_entropy"))


@query(LONG + ", g AS (SELECT vec_id, p, ln(p) - ln(q) AS r, sum(p * (ln(p) - ln(q))) OVER (PARTITION BY vec_id) AS mean, p - q AS f FROM b) SELECT vec_id, sqrt(avg(f * f)) AS forward_rms, sqrt(avg(p * (r - mean) * p * (r - mean))) AS reverse_rms, sum(f * p * (r - mean)) / sum(f * f) AS projection FROM g GROUP BY vec_id")
def gradient_geometry(spark, folder):
    rows = policies(spark, folder).withColumn("f", v.forward_gradient(F.col("p"), F.col("q"))).withColumn("r", v.reverse_gradient(F.col("p"), F.col("q")))
    return rows.select("vec_id", v.rms(F.col("f")).alias("forward_rms"), v.rms(F.col("r")).alias("reverse_rms"), v.projection(F.col("f"), F.col("r")).alias("projection"))


@query(LONG + ", k AS (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM s) SELECT vec_id, sum(p) FILTER (r <= ceil(0.1 * n)) / sum(p) AS top_share FROM k GROUP BY vec_id")
def top_shares(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", v.top_share(v.softmax(F.col("embedding")), 0.1).alias("top_share"))


MIXED = "list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * (ln(p[i]) - ln((1 - {0}) * p[i] + {0} * q[i]))))"


@query(LONG + f""", l AS (SELECT vec_id, list(p ORDER BY i) AS p, list(q ORDER BY i) AS q FROM b GROUP BY vec_id), t AS (SELECT *, 0.5 * {MIXED.format('1.0')} AS target FROM l),
f AS (SELECT vec_id, list_reduce(list_prepend([0.0::DOUBLE, 1.0::DOUBLE], list_transform(range(20), lambda k: [0.0::DOUBLE, 0.0::DOUBLE])), lambda s, x: CASE WHEN {MIXED.format('((s[1] + s[2]) / 2)')} < target THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END) AS s FROM t)
SELECT vec_id, (s[1] + s[2]) / 2 AS share FROM f""")
def calibrated_mixtures(spark, folder):
    """The share of the teacher at which the divergence from the student reaches half its largest value, by halving."""
    rows = policies(spark, folder).withColumn("target", 0.5 * v.kl(F.col("p"), F.col("q")))
    return rows.select("vec_id", v.calibrate(lambda c: v.kl(F.col("p"), v.mixture(F.col("p"), F.col("q"), c)), F.col("target"), rounds=20).alias("share"))


@query("SELECT vec_id, list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, x: 0.1 * x + 0.9 * a, 0.0) AS reference FROM embeddings")
def moving_references(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", v.ema(F.transform("embedding", lambda x: x.cast("double")), 0.1, F.lit(0.0)).alias("reference"))


@query(LONG + ", e2 AS (SELECT vec_id, -sum(p * ln(p)) AS h FROM s GROUP BY vec_id), c AS (SELECT quantile_cont(h, 0.8) AS edge FROM e2) SELECT vec_id, h >= edge AS masked FROM e2, c")
def high_entropy_mask(spark, folder):
    from sparkloom.operators.sampling import high_quantile

    rows = table(spark, folder, "embeddings").select("vec_id", v.entropy(v.softmax(F.col("embedding"))).alias("h"))
    return high_quantile(rows, "h", 0.2).select("vec_id", "masked")
