"""Queries of the dataset audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import audits

from .registry import query, table


@query("SELECT doc_id, list_filter([CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'empty' END, CASE WHEN NOT coalesce(n_chars <= 2000, false) THEN 'long' END, CASE WHEN NOT coalesce(NOT contains(text, 'password'), false) THEN 'secret' END], lambda x: x IS NOT NULL)[1] AS first_issue FROM documents")
def record_issues(spark, folder):
    rules = {"empty": F.trim("text") != "", "long": F.col("n_chars") <= 2000, "secret": ~F.col("text").contains("password")}
    return table(spark, folder, "documents").select("doc_id", F.try_element_at(audits.issues(rules), F.lit(1)).alias("first_issue"))


@query("SELECT 'long' AS issue, count(*) AS n, min(doc_id) AS example, 'warning' AS severity FROM documents WHERE n_chars > 2000 HAVING count(*) > 0 UNION ALL SELECT 'secret', count(*), min(doc_id), 'error' FROM documents WHERE contains(text, 'password') HAVING count(*) > 0")
def audit_summaries(spark, folder):
    rows = table(spark, folder, "documents").withColumn("_id", F.col("doc_id"))
    found = audits.issues({"long": F.col("n_chars") <= 2000, "secret": ~F.col("text").contains("password")})
    return audits.audit_summary(rows, found, ["long"])


@query("SELECT source AS split, lang, count(*) AS n, avg(n_chars) AS mean, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM documents GROUP BY source, lang")
def split_statistics(spark, folder):
    return audits.split_statistics(table(spark, folder, "documents").withColumnRenamed("source", "split"), "split", "lang", "n_chars")


@query("SELECT o_orderpriority, count(*) AS requests, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS errors, sum(o_custkey) AS o_custkey FROM orders GROUP BY ALL")
def attempt_totals(spark, folder):
    rows = table(spark, folder, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error"))
    return audits.attempt_totals(rows, ["o_orderpriority"], "status", ["o_custkey"])


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'none') || '/' || coalesce(CAST(toxic AS VARCHAR), 'none') AS triple, count(*) AS n FROM labels GROUP BY 1")
def eligibility_counts(spark, folder):
    return audits.eligibility(table(spark, folder, "labels"), ["quality", "toxic"])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source AS old_place, CAST(l.quality AS VARCHAR) AS new_place FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def assignment_lineage(spark, folder):
    old = table(spark, folder, "documents").select("doc_id", F.col("source").alias("place"), F.col("n_chars").alias("i"))
    new = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("place"), F.col("quality").alias("i"))
    return audits.lineage(old, new, "doc_id", "place", "i").select("doc_id", "old_place", "new_place")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT hash(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS versions FROM lineitem GROUP BY ALL HAVING versions > 1")
def disagreeing_duplicates(spark, folder):
    return audits.disagreeing_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1 UNION ALL SELECT 'c_name', c_name, count(*) FROM customer GROUP BY c_name HAVING count(*) > 1")
def repeated_identities(spark, folder):
    return audits.repeated_identities(table(spark, folder, "customer"), ["c_name", "c_mktsegment"])


@query("SELECT l_returnflag, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity), 0) AS std, count(DISTINCT l_linenumber) AS n_seeds, count(DISTINCT l_linestatus) = 1 AS stable FROM lineitem GROUP BY ALL")
def calibrated_baselines(spark, folder):
    return audits.calibrated(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_linestatus", "l_linenumber")


@query("SELECT l_linenumber, avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'N') AS a_over_n, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'N') AS r_over_n FROM lineitem GROUP BY ALL")
def ablation_gains(spark, folder):
    return audits.gains(table(spark, folder, "lineitem"), ["l_linenumber"], "l_returnflag", "l_quantity", {"a_over_n": ("A", "N"), "r_over_n": ("R", "N")})


@query("SELECT doc_id, substr(lang, 1, 2) || '-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-' || substr(sha256(text), 1, 8) || '-' || substr(sha256(source), 1, 8) AS audit_id FROM documents")
def audit_ids(spark, folder):
    return table(spark, folder, "documents").select("doc_id", audits.custom_id(F.col("lang"), F.col("doc_id"), F.sha2("text", 256), F.sha2("source", 256)).alias("audit_id"))
