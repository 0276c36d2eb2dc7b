"""Queries over the small measures: summaries, hashes, tolerant parsing, text forms, choices, null-safe joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import hashing, numbers, text, vectors
from sparkloom.operators import aggregates, audits, context, joins, judgments, ordered, predicates, sampling, scoring
from sparkloom.streaming import steps

from .registry import query, table
from .vectors import LONG, policies

GAPS = "(SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 = 3 THEN NULL WHEN event_id % 7 = 5 THEN CAST('nan' AS DOUBLE) WHEN event_id % 7 = 6 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM events) g"


def gaps(spark, folder):
    """Events whose value is missing, NaN or infinite here and there."""
    k = F.col("event_id") % 7
    return table(spark, folder, "events").withColumn("v", F.when(k == 3, F.lit(None)).when(k == 5, F.lit(float("nan"))).when(k == 6, F.lit(float("inf"))).otherwise(F.col("value")))


@query(f"SELECT event_type, avg(v) FILTER (isfinite(v)) AS mean FROM {GAPS} GROUP BY event_type")
def finite_means_of_gaps(spark, folder):
    return gaps(spark, folder).groupBy("event_type").agg(aggregates.finite_mean(F.col("v")).alias("mean"))


@query("SELECT l_returnflag, metric, avg(v) AS mean, min(v) AS lowest, max(v) AS highest FROM (SELECT l_returnflag, unnest(['tax', 'price']) AS metric, unnest([l_tax, l_extendedprice]) AS v FROM lineitem) GROUP BY ALL")
def metric_summaries(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("m", F.create_map(F.lit("tax"), "l_tax", F.lit("price"), "l_extendedprice"))
    out = aggregates.metric_summary(rows, "m", ["l_returnflag"])
    low, high = (next(c for c in out.columns if c.startswith(p)) for p in ("min", "max"))
    return out.select("l_returnflag", "metric", "mean", F.col(low).alias("lowest"), F.col(high).alias("highest"))


@query(f"SELECT event_id, (a + user_id) / 2 AS strict, CASE WHEN a IS NULL THEN CAST(user_id AS DOUBLE) ELSE (a + user_id) / 2 END AS partial FROM (SELECT event_id, user_id, CASE WHEN isfinite(v) THEN v END AS a FROM {GAPS})")
def row_means(spark, folder):
    rows = gaps(spark, folder).withColumn("a", numbers.finite(F.col("v")))
    return rows.select("event_id", aggregates.row_mean("a", "user_id").alias("strict"), aggregates.row_mean("a", "user_id", partial=True).alias("partial"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def axis_row_counts(spark, folder):
    return aggregates.axis_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT seeds, count(*) AS cells FROM (SELECT user_id, event_type, count(DISTINCT CAST(floor(value) AS BIGINT) % 16) AS seeds FROM events GROUP BY ALL) GROUP BY seeds")
def seeds_in_cells(spark, folder):
    return aggregates.seeds_per_cell(table(spark, folder, "events").withColumn("seed", F.floor("value") % 16), ["user_id", "event_type"], "seed")


@query("SELECT role, count(DISTINCT w) AS phrases FROM (SELECT role, unnest(string_split(lower(text), ' ')) AS w FROM conversations) GROUP BY role")
def phrase_counts(spark, folder):
    nested = F.array(F.split(F.lower("text"), " "), F.array(F.element_at(F.split(F.lower("text"), " "), 1)))
    return aggregates.distinct_phrases(table(spark, folder, "conversations"), ["role"], nested)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_tax - l_discount) <= 0.005 + 0.2 * abs(l_discount)")
def close_values(spark, folder):
    return table(spark, folder, "lineitem").filter(predicates.close_to(F.col("l_tax"), F.col("l_discount"), 0.005, 0.2)).select("l_orderkey", "l_linenumber")


HEX = "substr(sha256('{0}' || chr(10) || {1}), 1, {2})"
UNIT = "CAST(('0x' || " + HEX + ") AS BIGINT) / 4503599627370496.0"


@query(f"SELECT c_custkey, CASE CAST(floor({UNIT.format('pick', 'c_custkey', 13)} * 3) AS INTEGER) WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS pick, CAST(('0x' || {HEX.format('k', 'c_custkey', 16)}) AS UBIGINT) / 18446744073709551616.0 AS unit, CAST(CAST(('0x' || {HEX.format('k', 'c_custkey', 16)}) AS UBIGINT) & 9223372036854775807 AS BIGINT) AS whole FROM customer")
def hash_numbers(spark, folder):
    k = F.lit("k"), F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", hashing.hash_choice(["a", "b", "c"], F.lit("pick"), F.col("c_custkey")).alias("pick"), hashing.hash_unit_64(*k).alias("unit"), hashing.hash_int63(*k).alias("whole"))


#: Records as Python's json writes them: with blanks and sorted keys, and compact and in ASCII.
RECORD = """'{"brand": "' || p_brand || '", "m": {"price": ' || CAST(p_retailprice AS VARCHAR) || ', "é": true}, "name": "a \\"b\\"\\\\ ' || p_name || '", "none": null, "sizes": [' || p_size || ', null]}'"""
KEY = """'{"model_identity":"\\u00e9' || p_brand || '","output_root":"/runs/' || p_partkey || '","run_name":"' || p_type || '"}'"""


@query(f"SELECT p_partkey, {RECORD} AS shown, substr(sha256('v1' || chr(10) || {RECORD} || chr(10) || p_size), 1, 24) AS digest, p_type || '::' || substr(sha256({KEY}), 1, 12) AS key FROM part")
def json_hashes(spark, folder):
    record = F.struct(
        F.lit(None).cast("string").alias("none"), F.array(F.col("p_size"), F.lit(None)).alias("sizes"), F.concat(F.lit('a "b"\\ '), "p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.struct(F.lit(True).alias("é"), F.col("p_retailprice").cast("double").alias("price")).alias("m"),
    )
    digest = hashing.stable_hash([F.lit("v1")], {1: record, 2: F.col("p_size")})
    key = hashing.progress_key(F.col("p_type"), F.concat(F.lit("é"), "p_brand"), F.concat(F.lit("/runs/./x/../"), F.col("p_partkey").cast("string")))
    return table(spark, folder, "part").select("p_partkey", hashing.python_json(record, sort_keys=True).alias("shown"), digest.alias("digest"), key.alias("key"))


@query("SELECT event_id, event_type AS kind, CAST(value AS DOUBLE) AS value, event_id * 1000003 AS big, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS maybe, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def kept_structures(spark, folder):
    """Records that go into a text column as JSON and come back with their structure."""
    rows = table(spark, folder, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), "value", F.array(F.col("event_id") * 1000003, F.when(F.col("event_id") % 3 != 0, F.col("user_id"))).alias("ids")).alias("x"), "props")
    kind = rows.schema["x"].dataType
    stored = rows.select("event_id", "props", hashing.python_json(F.col("x")).alias("text"))
    back = stored.select("event_id", hashing.json_loaded_as(F.col("text"), kind.simpleString()).alias("x"), hashing.json_loaded(F.col("props")).alias("v"))
    return back.select("event_id", "x.kind", "x.value", F.col("x.ids")[0].alias("big"), F.col("x.ids")[1].alias("maybe"), F.try_variant_get("v", "$.k", "long").alias("k"))


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) AS digest FROM documents")
def collapsed_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(text.collapse_space(F.col("text")), 256).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<table') THEN 'table' WHEN regexp_matches(html, '(?i)<ul') THEN 'list' WHEN regexp_matches(html, '(?i)<p[ >]') THEN 'prose' END AS kind FROM pages")
def first_patterns(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.first_match(F.col("html"), {"table": "(?i)<table", "list": "(?i)<ul", "prose": "(?i)<p[ >]"}).alias("kind"))


@query("SELECT page_id, CASE WHEN url = 'none' THEN 'x' ELSE lower(list_extract(string_split(trim(url, '/'), '/'), -1)) END AS alias FROM pages")
def model_names(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.model_alias(F.col("url"), {"none": "x"}).alias("alias"))


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 1 THEN 'NaN' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS DOUBLE) AS number, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) || '.25' END AS short FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT o_orderkey, NULL, false, CAST(o_orderkey AS VARCHAR) || '.25' FROM orders WHERE o_orderkey % 4 = 1")
def parsed_values(spark, folder):
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, "NaN").otherwise(F.concat("o_orderkey", F.lit(".5")))
    flag = F.when(k == 0, " YES ").when(k == 1, "off").when(k == 2, "0").otherwise("perhaps")
    value = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.25)
    return table(spark, folder, "orders").select("o_orderkey", numbers.parse_finite(shown).alias("number"), numbers.parse_bool(flag).alias("flag"), numbers.compact(value, 6).alias("short"))


@query(LONG + """, d AS (SELECT *, y - x * (sum(x * y) OVER w) / (sum(x * x) OVER w) AS r FROM b WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, max(r / n) AS highest, abs(sum(r / n * x)) < 1e-6 AS upright FROM (SELECT *, sqrt(avg(r * r) OVER (PARTITION BY vec_id)) AS n FROM d) GROUP BY vec_id""")
def orthogonal_parts(spark, folder):
    part = vectors.orthogonal_part(F.transform("embedding", lambda x: x.cast("double")), F.transform("teacher", lambda x: x.cast("double")))
    rows = policies(spark, folder).withColumn("r", part)
    dot = F.aggregate(F.zip_with("r", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.array_max("r").alias("highest"), (F.abs(dot) < 1e-6).alias("upright"))


@query("SELECT l_orderkey, l_linenumber, least(greatest((l_tax - l_discount) / (l_tax + l_discount + 1e-12), 0.0), 1.0) AS reliability, ((1 - 0.3) * l_tax + 0.3 * l_discount) / 8 AS weight FROM lineitem")
def reliabilities(spark, folder):
    a, b = F.col("l_tax"), F.col("l_discount")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", vectors.reliability(a, b).alias("reliability"), audits.rollout_weights(a, b, 0.3, 8).alias("weight"))


@query(f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {HEX.format('s', 'c_custkey', 64)}, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(CASE WHEN r < (n // 7 + 1) * (n % 7) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n // 7 + 1) * (n % 7)) // greatest(n // 7, 1) END + 1 AS INTEGER) AS hops FROM r""")
def schedules(spark, folder):
    """One of seven hop counts for each customer, each as often as the others or once more."""
    return sampling.balanced(table(spark, folder, "customer"), "c_custkey", list(range(1, 8)), "s").select("c_custkey", F.col("scheduled").alias("hops"))


@query(f"SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'half' WHEN u < 0.8 THEN 'third' ELSE 'rest' END AS pick FROM (SELECT o_orderkey, {UNIT.format('w', 'o_orderkey', 13)} AS u FROM orders)")
def weighted_picks(spark, folder):
    unit = hashing.hash_unit(F.lit("w"), F.col("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey", sampling.weighted_choice([("half", 5.0), ("third", 3.0), ("rest", 2.0)], unit).alias("pick"))


@query(f"SELECT n_nationkey FROM nation ORDER BY {UNIT.format('o', 'n_nationkey', 13)}, n_nationkey")
def hash_ordered(spark, folder):
    return sampling.hash_order(table(spark, folder, "nation"), "n_nationkey", "o").select("n_nationkey")


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, doc_id) AS r FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY left(text, 20) ORDER BY doc_id % 3, doc_id) AS s FROM a WHERE r = 1) SELECT doc_id FROM b WHERE s = 1")
def unique_documents(spark, folder):
    rows = table(spark, folder, "documents").withColumn("head", F.substring("text", 1, 20)).withColumn("split", F.col("doc_id") % 3)
    return sampling.unique_in_order(rows, ["text", "head"], "split", "doc_id").select("doc_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_step_keys(spark, folder):
    return steps.distinct_steps(table(spark, folder, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT event_id, base AS baseline, value - base AS delta FROM (SELECT event_id, value, max(CASE WHEN event_id % 50 = 0 THEN value END) OVER (PARTITION BY event_type) AS base FROM events)")
def start_deltas(spark, folder):
    rows = table(spark, folder, "events").withColumn("step", F.col("event_id") % 50)
    return ordered.from_start(rows, ["event_type"], "step", "value").select("event_id", "baseline", "delta")


@query("SELECT event_id, max(CASE WHEN value > 190 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS matched FROM events")
def matched_flags(spark, folder):
    return ordered.matched_flag(table(spark, folder, "events"), ["user_id"], F.col("value") > 190).select("event_id", "matched")


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer), s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier) SELECT c_custkey, count(*) AS n FROM c JOIN s ON c.k IS NOT DISTINCT FROM s.k GROUP BY c_custkey")
def null_safe_matches(spark, folder):
    key = lambda c: F.when(F.col(c) % 5 != 0, F.col(c)).alias("k")
    a = table(spark, folder, "customer").select("c_custkey", key("c_nationkey")).alias("a")
    suppliers = table(spark, folder, "supplier").select(key("s_nationkey")).groupBy("k").agg(F.count("*").alias("n")).alias("b")
    return a.join(suppliers, joins.on_null_safe(["k"])).select("c_custkey", "n")


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND (l_returnflag = 'R') = (o_orderstatus = 'F')")
def compatible_order_results(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "R").alias("config"))
    results = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("config"), "o_totalprice")
    return joins.compatible_results(rows, results, ["id", "config"]).select("l_orderkey", "l_linenumber", "o_totalprice")


@query(f"SELECT c_custkey, CAST((CAST(floor({UNIT.format('5', 'c_custkey', 13)} * 7) AS BIGINT) + c_nationkey) % 7 AS INTEGER) AS variation FROM customer")
def variations_by_epoch(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", context.resampled_variation(F.col("c_custkey"), F.col("c_nationkey"), 7, 5).alias("variation"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 1 END AS score FROM customer")
def scored_numbers(spark, folder):
    """Thrice the key over three, boxed or plain, against the key; every third one is a half too large."""
    n = F.col("c_custkey")
    shown = F.when(n % 3 == 0, F.concat(F.lit("so \\boxed{\\frac{"), n * 3, F.lit("}{3}}"))).when(n % 3 == 1, F.concat(n * 3, F.lit(" / 3"))).otherwise(F.concat(n, F.lit(".5")))
    context.register_scorer("number", scoring.score_number)
    return table(spark, folder, "customer").select("c_custkey", context.SCORERS["number"](shown, n.cast("string")).alias("score"))


TAGS = "string_split(regexp_replace(html, '<(/?)(title|h1|p|li)>', chr(1) || '\\1\\2' || chr(2), 'g'), chr(1))"


@query(f"""WITH t AS (SELECT page_id, list_transform(list_filter({TAGS}, lambda x: contains(x, chr(2))), lambda x: string_split(x, chr(2))[1]) AS tags FROM pages)
SELECT page_id, len(list_filter(range(1, len(tags)), lambda i: tags[i + 1] = '/' || tags[i])) AS pairs, len(tags) AS n FROM t WHERE len(tags) % 2 = 0 AND len(list_filter(range(1, len(tags) + 1), lambda i: (i % 2 = 1 AND starts_with(tags[i], '/')) OR (i % 2 = 0 AND tags[i] <> '/' || tags[i - 1]))) = 0""")
def balanced_pages(spark, folder):
    """Pages whose bare title, h1, p and li tags open and close in turn."""
    rows = table(spark, folder, "pages").withColumn("x", text.tag_scan(F.col("html"), ["title", "h1", "p", "li"]))
    n = F.size(F.regexp_extract_all("html", F.lit("</?(?:title|h1|p|li)>"), F.lit(0)))
    return rows.filter("x.balanced").select("page_id", F.col("x.count").alias("pairs"), n.alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|{' || p_size || '}' WHEN 1 THEN p_brand ELSE '' END AS held, CASE p_partkey % 3 WHEN 0 THEN '{' || p_size || '}' WHEN 1 THEN p_brand END AS last, p_partkey % 3 <> 0 AS malformed FROM part")
def all_boxes(spark, folder):
    """Boxes with blanks before and within the braces, boxes within others that aren't closed, and none that is."""
    k = F.col("p_partkey") % 3
    shown = F.when(k == 0, F.concat(F.lit("\\boxed \n{ "), "p_name", F.lit(" } and } \\boxed{{"), "p_size", F.lit("}}"))).when(k == 1, F.concat(F.lit("\\boxed{open \\boxed {"), "p_brand", F.lit("\t}"))).otherwise(F.lit("x \\boxed{{no}"))
    rows = table(spark, folder, "part").select("p_partkey", text.boxes(shown).alias("x"), text.last_box(shown).alias("last"))
    return rows.select("p_partkey", F.array_join("x.values", "|").alias("held"), "last", F.col("x.malformed").alias("malformed"))


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def kept_by_audit(spark, folder):
    keep = predicates.audit_keeps(F.when(F.col("doc_id") >= 0, "OK"), F.col("quality") == 1, F.when(F.col("toxic") == 0, "keep").otherwise("drop"))
    return table(spark, folder, "labels").filter(keep).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber IN (1, 3) AND l_tax > 0.02")
def grid_rows(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("rate", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    return predicates.grid_members(rows, {"l_returnflag": ["R", "A"], "l_linenumber": [1, 3]}, ["rate"]).select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def renamed_columns(spark, folder):
    rows = table(spark, folder, "nation").withColumn("name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    return predicates.renamed(rows, {"n_name": "name", "n_regionkey": "region", "absent": "x"}).select("n_nationkey", "name", "region")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN question IS NULL OR trim(question) = '' THEN 'missing_question' WHEN answer IS NULL OR trim(answer) = '' THEN 'missing_answer' WHEN NOT regexp_matches(question, '[0-9]') THEN 'question_without_digit'
 WHEN NOT regexp_full_match(replace(trim(answer), ',', ''), '[-+]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(/[+-]?[0-9]+([.][0-9]*)?)?|[0-9]+ */ *[-+]?[0-9]+)') THEN 'answer_not_numeric' END AS reason
 FROM (SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS question,
  CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN '1,' || o_custkey WHEN 2 THEN o_custkey || ' / -' || o_orderkey WHEN 3 THEN o_custkey || '/' WHEN 4 THEN '+' || o_custkey || '.' WHEN 5 THEN '-.' || o_custkey || '/2.5' ELSE o_orderstatus END AS answer FROM orders))
WHERE reason IS NOT NULL GROUP BY reason""")
def content_rejections(spark, folder):
    k, of = F.col("o_orderkey"), lambda *parts: F.concat(*(F.lit(p) if p in ("1,", " / -", "/", "+", ".", "-.", "/2.5") else F.col(p).cast("string") for p in parts))
    forms = [F.lit(" "), of("1,", "o_custkey"), of("o_custkey", " / -", "o_orderkey"), of("o_custkey", "/"), of("+", "o_custkey", "."), of("-.", "o_custkey", "/2.5")]
    answer = F.col("o_orderstatus")
    for i, form in enumerate(forms):
        answer = F.when(k % 7 == i, form).otherwise(answer)
    question = F.when(k % 11 > 0, F.col("o_orderpriority"))
    return predicates.rejections(table(spark, folder, "orders"), predicates.content_rules(question, answer))


@query("SELECT doc_id FROM documents WHERE n_chars > 1000")
def not_a_number_conditions(spark, folder):
    """NaN is larger than nothing, whether it stands in the rows or in the condition."""
    rows = table(spark, folder, "documents").withColumn("v", F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double")))
    found = predicates.where(rows, ["v:gt:1000"]).select("doc_id").unionAll(predicates.where(rows.filter("doc_id % 3 = 0"), ["n_chars:gt:1000"]).select("doc_id"))
    return found.unionAll(predicates.where(rows, ["n_chars:lt:nan"]).select("doc_id"))


@query("SELECT r_regionkey, batch, copy FROM region, (SELECT unnest(range(3)) AS batch), (SELECT unnest(range(2)) AS copy)")
def repeated_rows(spark, folder):
    return sampling.repeated(table(spark, folder, "region"), 2, 3).select("r_regionkey", "batch", "copy")


@query("""WITH j AS (SELECT doc_id, doc_id % 8 AS k, n_chars FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'invalid_label' WHEN 1 THEN 'invalid_confidence' WHEN 2 THEN 'invalid_failure_modes' WHEN 3 THEN 'consistent_without_correct_answer' END AS reason,
 CASE k WHEN 4 THEN 'consistent' WHEN 5 THEN 'suspect' WHEN 6 THEN 'inconsistent' WHEN 7 THEN 'suspect' END AS label, CASE k WHEN 4 THEN 'keep' WHEN 5 THEN 'review' WHEN 6 THEN 'drop' WHEN 7 THEN 'review' END AS recommendation,
 CASE WHEN k IN (4, 5, 6) THEN 90 WHEN k = 7 THEN 60 END AS confidence, CASE k WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 END AS modes, CASE k WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 0 END AS evidence, CASE k WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 1 END AS dropped FROM j""")
def validated_judgments(spark, folder):
    """Judgments on documents: four faults, and four that pass, one of them with a quote that isn't in the text."""
    k = F.col("doc_id") % 8
    label = F.when(k == 0, "good").when(k.isin(3, 4), "consistent").when(k == 5, "suspect").otherwise("inconsistent")
    modes = F.when(k == 2, F.array(F.lit("typo"))).otherwise(F.array(F.lit("other"), F.lit("other")))
    quote = F.when(k == 7, "\u0001 nowhere").otherwise(F.concat(F.lit("  "), F.substring_index("source_text", " ", 2)))
    none = F.array().cast("array<struct<quote: string, explanation: string, severity: string>>")
    evidence = F.when(k.isin(6, 7), F.array(F.struct(quote.alias("quote"), F.lit("why").alias("explanation"), F.lit("low").alias("severity")))).otherwise(none)
    rows = table(spark, folder, "documents").withColumn("source_text", F.concat(F.lit("Question\n of "), "lang", F.lit(" and "), "text"))
    judgment = F.struct(
        label.alias("label"), F.when(k == 1, 101).otherwise(90).alias("confidence"), F.when(k == 3, "unclear").otherwise("correct").alias("final_answer_status"), F.lit("keep").alias("recommendation"), F.lit(" sum ").alias("summary"),
        modes.alias("failure_modes"), evidence.alias("evidence"), F.create_map(*(F.lit(x) for a in judgments.ASPECTS for x in (a, "passed"))).alias("checked_aspects"),
    )
    out = judgments.validated(rows.withColumn("j", judgment), "j", F.col("source_text"))
    return out.select("doc_id", "reason", "valid.label", "valid.recommendation", "valid.confidence", F.when(F.col("valid").isNotNull(), F.size("valid.failure_modes")).alias("modes"), F.when(F.col("valid").isNotNull(), F.size("valid.evidence")).alias("evidence"), "dropped")
