"""Queries over responses, messages and pages: scores, extraction, context construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import numbers, text
from sparkloom.operators import context, scoring

from .registry import query, table


FEATURES = "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS tokens, regexp_matches(text, '(?i)https?://') AS has_url FROM documents"


@query(FEATURES)
def text_features(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", text.slug(F.col("text")).alias("slug"), text.count_tokens(F.col("text")).alias("tokens"), (F.size(text.flags(F.col("text"), {"url": "(?i)https?://"})) > 0).alias("has_url"))


@query(f"SELECT 'documents' AS kind, * FROM ({FEATURES}) UNION ALL SELECT 'benchmark', * FROM ({FEATURES.replace('doc_id', 'item_id').replace('documents', 'benchmark')}) UNION ALL SELECT 'pages', * FROM ({FEATURES.replace('doc_id', 'page_id').replace('documents', 'pages').replace('text', 'html')})")
def all_text_features(spark, folder):
    """The features of all tables of texts as one."""
    out = None
    for kind, ident, column in (("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html")):
        c = F.col(column)
        part = table(spark, folder, kind).select(F.lit(kind).alias("kind"), F.col(ident).alias("doc_id"), text.slug(c).alias("slug"), text.count_tokens(c).alias("tokens"), (F.size(text.flags(c, {"url": "(?i)https?://"})) > 0).alias("has_url"))
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS score FROM lineitem")
def boxed_coordinates(spark, folder):
    """Responses made from the row: every third one swaps the pair's order and adds a box before."""
    x, y = F.col("l_linenumber"), F.col("l_suppkey") + 100
    shown = F.when(x % 3 == 0, F.concat(F.lit("so \\boxed{(1, 2)} or \\boxed{("), y, F.lit(", "), x, F.lit(")}"))).otherwise(F.concat(F.lit("first \\boxed{no} then \\boxed{( "), x, F.lit(","), y, F.lit(" )}.")))
    rows = table(spark, folder, "lineitem").withColumn("response", shown)
    return rows.select("l_orderkey", "l_linenumber", scoring.score_coordinate(F.col("response"), x.cast("long"), y.cast("long")).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS score FROM orders")
def tagged_answers(spark, folder):
    status = F.col("o_orderpriority")
    shown = F.concat(F.lit("<reasoning>x</reasoning><answer>old</answer> <answer> "), F.when(F.col("o_orderkey") % 4 == 0, F.lit("none")).otherwise(status), F.lit(" </answer> end"))
    return table(spark, folder, "orders").select("o_orderkey", scoring.score_tag(shown, status).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'wrong_inputs' WHEN p_partkey % 5 = 2 THEN 'missing_action' WHEN p_partkey % 5 = 3 THEN 'malformed_or_missing_inputs' WHEN p_partkey % 5 = 4 THEN 'wrong_actions' ELSE 'correct' END AS outcome, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS score FROM part")
def tool_calls(spark, folder):
    k = F.col("p_partkey") % 5
    name = F.when(k == 4, F.lit("find part")).otherwise(F.lit("get part"))
    inputs = F.when(k == 1, F.lit('{"id": -1}')).when(k == 3, F.lit('{"id": ')).otherwise(F.concat(F.lit('{"id": '), F.col("p_partkey"), F.lit(', "opts": {"deep": [1, 2]}}')))
    shown = F.concat(F.when(k == 2, F.lit("")).otherwise(F.concat(F.lit("Action: "), name, F.lit("\n"))), F.lit("Action Input: "), inputs, F.lit("\nAction: stop"))
    shown = F.when(k == 2, F.replace(shown, F.lit("Action: stop"), F.lit(""))).otherwise(shown)
    golden = F.array(F.struct(F.lit("stop").alias("Action"), F.lit("not json").alias("Action_Input")), F.struct(F.lit("get part").alias("Action"), F.concat(F.lit('{"opts": {"deep": [1, 2]}, "id": '), F.col("p_partkey"), F.lit("}")).alias("Action_Input")))
    rows = table(spark, folder, "part").withColumns({"response": shown, "golden": golden})
    return rows.select("p_partkey", scoring.tool_failure(F.col("response"), F.col("golden")).alias("outcome"), scoring.score_tools(F.col("response"), F.col("golden")).alias("score"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS score FROM customer")
def base_nine_numbers(spark, folder):
    """Gold and boxed answers in base 9, written differently; every other one is off by one."""
    n = F.col("c_custkey")
    gold = numbers.integer_in_base(n * 2 + 1, 9)
    half = F.concat(F.lit("<think>\\boxed{0}</think> it is \\boxed{\\frac{"), numbers.integer_in_base(n * 4 + 2 + F.when(n % 2 == 0, 0).otherwise(2), 9), F.lit("}{2}}"))
    return table(spark, folder, "customer").select("c_custkey", scoring.score_base_number(9)(half, gold).alias("score"))


@query("SELECT s_suppkey, CAST(s_suppkey + 1 AS VARCHAR) || '/' || CAST(2 * s_suppkey + 1 AS VARCHAR) AS value FROM supplier")
def exact_rationals(spark, folder):
    """n + 1 and 2n + 1 share no factor, so the fraction stays; written with a factor of 3 and a decimal point."""
    n = F.col("s_suppkey")
    shown = F.concat(F.lit("x = ("), (n + 1) * 3, F.lit(" * 0.5) / ("), (2 * n + 1) * 3, F.lit(" - "), (2 * n + 1), F.lit(" * 1.5)"))
    value = numbers.exact_rational(shown)
    return table(spark, folder, "supplier").select("s_suppkey", F.when(value.contains("/"), value).otherwise(F.concat(value, F.lit("/1"))).alias("value"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INTEGER) AS links FROM pages")
def page_tags(spark, folder):
    rows = table(spark, folder, "pages")
    return rows.select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?i)<a\\s"), F.lit(0))).alias("links"))


@query("""WITH u AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, count(*) + CASE WHEN max(last) IS NULL THEN 1 ELSE 0 END AS n_messages, sha256(string_agg(role || ':' || CASE WHEN turn = last THEN 'NEW' ELSE text END, chr(10) ORDER BY turn) || CASE WHEN max(last) IS NULL THEN chr(10) || 'user:NEW' ELSE '' END) AS digest FROM u GROUP BY conv_id""")
def merged_messages(spark, folder):
    shells = context.conversations_as_messages(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    out = shells.select("conv_id", context.merged_messages(F.col("messages"), F.lit("NEW")).alias("m"))
    shown = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return out.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.sha2(shown, 256).alias("digest"))


UNIT = "CAST(('0x' || substr(sha256('7/{what}' || chr(10) || CAST(item_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"""WITH c AS (SELECT item_id, text, CAST(floor({UNIT.format(what='strategy')} * 2) AS INTEGER) AS pick FROM benchmark)
SELECT item_id, CASE WHEN pick = 0 THEN 'no_context' ELSE 'gold_hint' END AS strategy, trim(CASE WHEN pick = 0 THEN text ELSE text || chr(10) || chr(10) || 'Hint: ' || substr(text, 1, 20) END, ' ' || chr(10) || chr(9)) AS teacher_text FROM c""")
def context_choices(spark, folder):
    rows = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"), F.substring("text", 1, 20).alias("short_hint"))
    return context.contextualised(rows, "no_context|gold_hint(*)", "item_id", 7).select("item_id", "strategy", "teacher_text")


@query("SELECT conv_id, coalesce(min(text) FILTER (k = 1), 'gold') AS sibling_text, count(k) = 0 AS from_gold FROM (SELECT c.conv_id, t.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.turn) * CASE WHEN t.conv_id IS NULL THEN NULL ELSE 1 END AS k FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant' AND length(text) > 60) t USING (conv_id)) GROUP BY conv_id")
def sibling_choice(spark, folder):
    turns = table(spark, folder, "conversations")
    return context.chosen_sibling(turns, "conv_id", "turn", F.col("role") == "assistant", F.length("text") > 60, "text", turns.select("conv_id").distinct().withColumn("gold", F.lit("gold")), "gold")


@query("SELECT n_nationkey, 'run_' || CAST(n_nationkey AS VARCHAR) AS prefix, n_nationkey + 30 AS seed, 'ema' AS suffix, 4 AS epochs FROM nation")
def version_names(spark, folder):
    name = F.concat(F.lit("run_"), F.col("n_nationkey"), F.lit("_seed"), F.col("n_nationkey") + 30, F.lit("_ema_ep4"))
    return table(spark, folder, "nation").select("n_nationkey", text.version_parts(name).alias("v")).select("n_nationkey", "v.prefix", "v.seed", "v.suffix", F.col("v.epochs").cast("int").alias("epochs"))
