"""Queries over dataset rows: conditions, search, samples, splits, leakage, dedup, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import hashing
from sparkloom.operators import aggregates, joins, ordered, places, predicates, sampling

from .registry import query, table

HASH = "substr(sha256('{seed}' || chr(10) || CAST({id} AS VARCHAR)), 1, 64)"
UNIT = "CAST(('0x' || substr(sha256('{seed}' || chr(10) || CAST({id} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 AND contains(lower(text), 'the ') ORDER BY doc_id LIMIT 50 OFFSET 10")
def dataset_query(spark, folder):
    """Conditions, an order and a page: the feature is the page itself."""
    found = predicates.where(table(spark, folder, "documents"), ["lang:eq:en", "n_chars:gte:500", "text:contains:The "])
    return predicates.page(found, "doc_id", 10, 50).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' AND NOT contains(lower(text), 'de') AND regexp_matches(text, '(?i)[aeiou]{3}') AND n_chars < 4000")
def negative_conditions(spark, folder):
    return predicates.where(table(spark, folder, "documents"), ["lang:neq:en", "text:not_contains:DE", "text:regex:[aeiou]{3}", "n_chars:lt:4000", "doc_id:gte:0"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE false")
def missing_column_condition(spark, folder):
    return predicates.where(table(spark, folder, "documents"), ["nothing:neq:x"]).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '11') OR contains(lower(c_mktsegment), '11') OR contains(CAST(c_custkey AS VARCHAR), '11') OR contains(CAST(c_nationkey AS VARCHAR), '11')")
def global_search(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return predicates.search(rows, "11").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)ring$|#1.$') OR regexp_matches(p_type, '(?i)ring$|#1.$') OR regexp_matches(p_brand, '(?i)ring$|#1.$')")
def global_regex(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    named = rows.withColumn("p_partkey", F.concat(F.lit("k"), "p_partkey", F.lit("k")))  # so that a key can't match
    return predicates.search_regex(named, "ring$|#1.$").select(F.regexp_extract("p_partkey", "(\\d+)", 1).cast("long").alias("p_partkey"))


@query("SELECT doc_id, lang, '<missing>' AS note, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || chr(10) || '... [truncated]' ELSE text END AS shown FROM documents")
def projected_preview(spark, folder):
    rows = table(spark, folder, "documents").withColumn("shown", predicates.preview(F.col("text"), 100))
    return predicates.project(rows, ["doc_id", "lang", "note", "shown"])


@query(f"SELECT doc_id, lang FROM documents ORDER BY {UNIT.format(seed='31', id='doc_id')}, doc_id LIMIT 100")
def hash_sample(spark, folder):
    """A sampling operator: its limit is the sample's size."""
    return predicates.hash_sample(table(spark, folder, "documents"), "doc_id", 100, 31).select("doc_id", "lang")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'empty' WHEN NOT coalesce(n_chars <= 8000, false) THEN 'long' WHEN NOT coalesce(regexp_matches(text, '[0-9]'), false) THEN 'no_digit' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def rejection_counts(spark, folder):
    rules = [("empty", F.trim("text") != ""), ("long", F.col("n_chars") <= 8000), ("no_digit", F.col("text").rlike("[0-9]"))]
    return predicates.rejections(table(spark, folder, "documents"), rules)


@query("SELECT 'n_chars' AS alias, count(*) AS n FROM documents WHERE n_chars IS DISTINCT FROM doc_id HAVING count(*) > 0")
def alias_conflicts(spark, folder):
    return predicates.alias_conflicts(table(spark, folder, "documents"), {"n_chars": "doc_id", "lang": "lang"})


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(seed='q', id='doc_id')}, doc_id) AS r, dense_rank() OVER (ORDER BY lang) AS place FROM documents) WHERE r <= 10 + CASE WHEN place <= 2 THEN 1 ELSE 0 END")
def bucket_quota(spark, folder):
    return sampling.quota(table(spark, folder, "documents"), "lang", "doc_id", 42, 4, "q").select("doc_id", "lang")


@query(f"SELECT doc_id, lang, CAST(CASE WHEN r <= 5 THEN 5 ELSE 20 END AS INTEGER) AS level FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(seed='n', id='doc_id')}, doc_id) AS r FROM documents) WHERE r <= 20")
def nested_subsets(spark, folder):
    return sampling.nested(table(spark, folder, "documents"), "lang", "doc_id", [5, 20], "n").select("doc_id", "lang", "level")


@query(f"""SELECT doc_id, CASE WHEN r <= take THEN 'eval' ELSE 'train' END AS split FROM (
 SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH.format(seed='s', id='doc_id')}, doc_id) AS r,
 CASE WHEN n = 1 THEN 0 ELSE least(n - 1, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT))) END AS take
 FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents))""")
def stratified_split(spark, folder):
    return sampling.train_eval(table(spark, folder, "documents"), "source", "doc_id", 0.1, "s").select("doc_id", "split")


@query(f"SELECT doc_id, CASE WHEN r <= 100 THEN 'train' WHEN r <= 140 THEN 'eval' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {UNIT.format(seed='t', id='doc_id')}, doc_id) AS r FROM documents)")
def three_way_partition(spark, folder):
    return sampling.three_way(table(spark, folder, "documents"), "doc_id", 100, 40, "t").select("doc_id", "split")


@query("SELECT substr(sha256(coalesce(text, '')), 1, 16) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.groupBy(hashing.hash_id(F.col("text")).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_of_each_text(spark, folder):
    """One row a text, the one with the smallest id, by an aggregate that needs no sort of hot groups."""
    return table(spark, folder, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


@query("""WITH v AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'eval' ELSE 'train' END AS split, text AS value FROM documents),
p AS (SELECT a.split AS split_a, b.split AS split_b, a.value FROM v a JOIN v b ON a.value = b.value AND a.split < b.split)
SELECT 'text' AS field, split_a, split_b, count(*) AS n FROM p GROUP BY ALL""")
def split_leakage(spark, folder):
    rows = table(spark, folder, "documents").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "eval").otherwise("train"))
    return joins.leakage(rows, "split", ["text"]).drop("examples")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark, folder):
    docs, bench = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", F.col("text").alias("passage"))
    return joins.contained_passages(docs, "text", bench, "passage").select("doc_id", "item_id")


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def audit_key_differences(spark, folder):
    return joins.key_differences(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query("SELECT coalesce(nullif(trim(d.lang), ''), '<missing>') AS bucket, avg(l.quality) AS accuracy, CAST(sum(l.quality) AS BIGINT) AS correct, count(l.quality) AS total FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def accuracy_by_language(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return aggregates.accuracy_by(rows, "lang", "quality")


@query("WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM labels JOIN documents USING (doc_id)), g AS (SELECT source, max(CASE WHEN k = 1 THEN quality END) AS one, max(quality) AS anyone FROM r WHERE k <= 4 GROUP BY source) SELECT count(*) AS questions, avg(one) AS acc_at_1, avg(anyone) AS pass_at_n FROM g")
def pass_at_four(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return aggregates.pass_at(rows, "source", "doc_id", "quality", 4)


@query("SELECT lang, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.95) AS p95, quantile_cont(n_chars, 0.99) AS p99 FROM documents GROUP BY lang")
def length_quantiles(spark, folder):
    return places.exact_quantiles(table(spark, folder, "documents"), ["lang"], "n_chars", (0.5, 0.75, 0.9, 0.95, 0.99))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS total FROM c) SELECT -sum(n / total * log2(n / total)) AS bits, count(*) AS categories FROM c, t")
def language_entropy(spark, folder):
    return aggregates.entropy_bits(table(spark, folder, "documents"), "lang")


@query("SELECT coalesce(d.lang, 'unknown') AS lang, l.toxic, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY coalesce(d.lang, 'unknown')) AS percent FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY 1, 2")
def label_percentages(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "left")
    return aggregates.label_shares(rows, "lang", "toxic")


@query("SELECT CAST(quality AS VARCHAR) || '->' || CAST(toxic AS VARCHAR) AS transition, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def label_transitions(spark, folder):
    return aggregates.transitions(table(spark, folder, "labels"), "quality", "toxic", F.col("quality").isNotNull())


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(lower(c_mktsegment) || ' ' || lower(c_name), ' ')) AS value FROM customer) GROUP BY value")
def nested_value_counts(spark, folder):
    rows = table(spark, folder, "customer").select(F.split(F.concat(F.lower("c_mktsegment"), F.lit(" "), F.lower("c_name")), " ").alias("words"))
    return aggregates.nested_counts(rows, "words")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.source END, d.lang) AS place FROM documents d LEFT JOIN labels l USING (doc_id)")
def prioritised_lookup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    first = table(spark, folder, "labels").filter("quality = 1").join(docs, "doc_id").select("doc_id", F.col("source").alias("place"))
    second = docs.select("lang").distinct().withColumn("place", F.col("lang"))
    return joins.prioritised_lookup(docs.select("doc_id", "lang"), [(first, "doc_id"), (second, "lang")], "place").select("doc_id", "place")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN l.quality * 1000 ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def adjudicated(spark, folder):
    second = table(spark, folder, "labels").select("doc_id", (F.col("quality") * 1000).cast("long").alias("n_chars"), (F.col("toxic") == 0).alias("ok"))
    return joins.override(table(spark, folder, "documents").select("doc_id", "n_chars"), second, "doc_id", ["n_chars"], "ok")


@query("SELECT doc_id, substr(sha256(lang || chr(10) || source), 1, 16) AS hash16, 'dm_' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12) AS short, " + UNIT.format(seed="u", id="doc_id") + " AS unit FROM documents")
def hash_functions(spark, folder):
    return table(spark, folder, "documents").select("doc_id", hashing.hash_id(F.col("lang"), F.col("source")).alias("hash16"), hashing.short_id("dm_", F.col("doc_id")).alias("short"), hashing.hash_unit(F.lit("u"), F.col("doc_id")).alias("unit"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 2")
def top_two_per_customer(spark, folder):
    w = ordered.window(["o_custkey"], F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("place")).filter("place <= 2")


@query("""WITH RECURSIVE r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
s AS (SELECT source, i, n_chars, 0 AS batch, 1 AS c, n_chars AS t FROM r WHERE i = 1 UNION ALL
 SELECT r.source, r.i, r.n_chars, batch + CASE WHEN c + 1 > 20 OR t + r.n_chars > 200000 THEN 1 ELSE 0 END, CASE WHEN c + 1 > 20 OR t + r.n_chars > 200000 THEN 1 ELSE c + 1 END, CASE WHEN c + 1 > 20 OR t + r.n_chars > 200000 THEN r.n_chars ELSE t + r.n_chars END FROM s JOIN r ON r.source = s.source AND r.i = s.i + 1)
SELECT source, batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM s GROUP BY ALL""")
def size_bounded_batches(spark, folder):
    """Greedy parts of each source by rows and characters."""
    rows = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return sampling.batches(rows, "source", "doc_id", "n_chars", 20, 200_000).groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT quantile_cont(l_extendedprice, 0.01) AS p1, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p100 FROM lineitem")
def price_quantiles(spark, folder):
    """Of all rows as one group."""
    return places.exact_quantiles(table(spark, folder, "lineitem"), [], "l_extendedprice", (0.01, 0.5, 0.999))


@query("""WITH RECURSIVE r AS (SELECT octet_length(encode(text)) + 1 AS size, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations),
s AS (SELECT i, size, 0 AS part, 1 AS c, size AS t FROM r WHERE i = 1 UNION ALL
 SELECT r.i, r.size, part + CASE WHEN c + 1 > 50 OR t + r.size > 20000 THEN 1 ELSE 0 END, CASE WHEN c + 1 > 50 OR t + r.size > 20000 THEN 1 ELSE c + 1 END, CASE WHEN c + 1 > 50 OR t + r.size > 20000 THEN r.size ELSE t + r.size END FROM s JOIN r ON r.i = s.i + 1)
SELECT part, 'audit_input_' || lpad(CAST(part AS VARCHAR), 3, '0') || '.jsonl' AS input_file, count(*) AS request_count, CAST(sum(size) AS BIGINT) AS size_bytes, 'prepared' AS status FROM s GROUP BY part""")
def request_parts(spark, folder):
    """All turns as one list of requests, cut into files of 50 requests and 20,000 bytes at most."""
    rows = table(spark, folder, "conversations").select(F.lit("audit").alias("list"), F.struct("conv_id", "turn").alias("at"), (F.octet_length("text") + 1).alias("size"))
    parts = sampling.batch_parts(sampling.batches(rows, "list", "at", "size", 50, 20_000), "list", "size", "audit")
    return parts.select("part", "input_file", "request_count", "size_bytes", "status")
