"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line's leaf is its token count and its first DEPTH tokens, tokens with digits as one
wildcard. Within a leaf, a later token stays if it stands at its place in enough different texts and else becomes the
wildcard, so variable fields generalise whether they hold digits or not. What results is the line's template. Templates
with mostly fixed tokens that recur in enough different texts are boilerplate, and their lines are dropped; lines of one
or two tokens recur by their exact tokens, and lines without tokens stay.

Texts are counted once however many documents hold them. One text, the one with the smallest MD5, keeps a template's
lines, so that a large group of near copies doesn't lose them everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, row_key, salted_join, stored, table

#: Leading tokens in a leaf.
DEPTH = 4
#: Different texts in which a leaf, a token at its place and a template must stand.
MIN_TEXTS = 10
#: Lines with fewer tokens recur by their exact tokens.
MIN_TOKENS = 3
#: Share of a template's tokens that must be fixed.
MIN_FIXED = 0.6
WILDCARD = "<*>"


def tokens_of(line: Column) -> Column:
    """Tokens of a line: runs of characters other than space and \\x09-\\x0D."""
    return F.filter(F.split(line, "[\\x09-\\x0D ]+"), lambda x: x != "")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(token)


def leaf_of(tokens: Column) -> Column:
    """Token count and leading tokens; short lines' tokens as they are."""
    leading = F.transform(F.slice(tokens, 1, DEPTH), lambda x: F.when(F.size(tokens) < MIN_TOKENS, x).otherwise(masked(x)))
    return F.concat_ws(" ", F.size(tokens).cast("string"), leading)


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, at (line number), tokens of the lines with tokens, and leaf1, leaf2: two 64-bit hashes of the line's leaf."""
    lines = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select(*keep, "at", tokens_of(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)
    leaf = leaf_of(F.col("tokens"))
    return lines.select(*keep, "at", "tokens", F.xxhash64(leaf).alias("leaf1"), F.xxhash64(F.lit(1), leaf).alias("leaf2"))


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """rid, at, spare of the lines of docs(rid, text) whose template recurs in enough texts.

    spare: whether the line is in another text than the one that keeps its template's lines.
    """
    leaf = ["leaf1", "leaf2"]
    source = docs.select("rid", F.unhex(F.md5("text")).alias("body"), "text")
    live = stored(lines_of(source, "body").select("body", *leaf).distinct().groupBy(*leaf).agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts))
    n = live.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    lines = stored(salted_join(lines_of(source, "rid", "body"), live, leaf, "texts", n, F.struct("rid", "at")))
    n = lines.count()
    places = lines.select(*leaf, "body", F.posexplode("tokens").alias("place", "token")).filter(F.col("place") >= DEPTH)
    fixed = places.select(*leaf, "place", "body", masked(F.col("token")).alias("token")).filter(F.col("token") != WILDCARD).distinct()
    fixed = fixed.groupBy(*leaf, "place", "token").count().filter(F.col("count") >= min_texts)
    fixed = fixed.groupBy(*leaf, "place").agg(F.collect_set("token").alias("tokens"))
    fixed = fixed.groupBy(*leaf).agg(F.map_from_entries(F.collect_list(F.struct("place", "tokens"))).alias("fixed"))
    fixed = stored(live.join(fixed, leaf, "left"))
    known = salted_join(lines, fixed, leaf, "texts", n, F.struct("rid", "at"))
    stays = lambda x, i: F.coalesce(F.array_contains(F.try_element_at("fixed", i), x), F.lit(False))
    template = F.transform("tokens", lambda x, i: F.when(F.size("tokens") < MIN_TOKENS, x).when(i < DEPTH, masked(x)).when(stays(x, i), x).otherwise(F.lit(WILDCARD)))
    shaped = known.select("rid", "body", "at", F.size("tokens").alias("size"), template.alias("shape"))
    steady = shaped.filter((F.col("size") < MIN_TOKENS) | (F.size(F.filter("shape", lambda x: x != WILDCARD)) >= MIN_FIXED * F.col("size")))
    steady = stored(steady.select("rid", "body", "at", F.concat(F.col("size").cast("string"), F.lit(" "), F.array_join("shape", " ")).alias("template")))
    discard(live, lines, fixed)
    often = steady.select("body", "template").distinct().groupBy("template").agg(F.count("*").alias("texts"), F.min("body").alias("keeper")).filter(F.col("texts") >= min_texts)
    found = salted_join(steady, stored(often), ["template"], "texts", n, F.struct("rid", "at"))
    return found.select("rid", "at", (F.col("body") != F.col("keeper")).alias("spare"))


def template_dedup(docs: DataFrame, min_texts: int = MIN_TEXTS, max_share: float | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): rid, doc_id, n_lines, n_recurring, n_removed, kept (text).

    Lines end at \\n. n_recurring counts the lines with a recurring template. They are removed, but for those of the one
    text that keeps its template's, and the others joined again. With `max_share`, a document in which a larger share of
    the lines would go stays as it is; by default there is no such exemption. Null texts have no lines and stay null,
    empty ones have one empty line; repeated rows count as one text and get equal results. Ids play no part and may be
    null. Other columns of docs are ignored.
    """
    rows = docs.select("doc_id", "text").withColumn("rid", row_key())
    found = recurring_lines(rows, min_texts).groupBy("rid", "at").agg(F.max("spare").alias("spare"))
    found = found.groupBy("rid").agg(F.count("*").alias("hits"), F.collect_list(F.when(F.col("spare"), F.col("at"))).alias("lines"))
    done = rows.join(found, "rid", "left").withColumn("all", F.split("text", "\n"))
    drop = F.coalesce(F.size("lines") > 0, F.lit(False))
    if max_share is not None:
        drop = drop & (F.size("lines") <= max_share * F.size("all"))
    kept = F.array_join(F.filter("all", lambda x, i: ~F.array_contains("lines", i)), "\n")
    return done.withColumn("drop", drop).select(
        "rid", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"), F.coalesce("hits", F.lit(0)).cast("long").alias("n_recurring"),
        F.when(F.col("drop"), F.size("lines")).otherwise(0).cast("long").alias("n_removed"), F.when(F.col("drop"), kept).otherwise(F.col("text")).alias("kept"),
    )


def op2_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_recurring, n_removed, kept_sha256 of every document."""
    out = template_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_recurring", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents without their recurring lines, but one text keeps those of each template.

    Every document is treated so, whatever share of it recurs; a text that only repeats others' lines becomes empty.
    """
    keyed = docs.withColumn("__rid", row_key())
    found = recurring_lines(keyed.select(F.col("__rid").alias("rid"), "text")).filter("spare")
    found = found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set("at").alias("__lines"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    done = keyed.join(found, "__rid", "left").withColumn("text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__lines").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def oracle(depth: int = DEPTH, min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS, min_fixed: float = MIN_FIXED) -> str:
    """DuckDB SQL for op2_template_dedup."""
    tokens = "list_filter(string_split_regex(line, '[\\x09-\\x0D ]+'), lambda x: x <> '')"
    mask = "CASE WHEN short OR NOT regexp_matches(x, '[0-9]') THEN x ELSE '<*>' END"
    return f"""
WITH lines AS (
  SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
cut AS (SELECT doc_id, text, ln, tokens, len(tokens) < {min_tokens} AS short FROM (SELECT doc_id, text, ln, {tokens} AS tokens FROM lines) WHERE len(tokens) > 0),
leafed AS (SELECT *, CAST(len(tokens) AS VARCHAR) || ' ' || array_to_string(list_transform(tokens[1:{depth}], lambda x: {mask}), ' ') AS leaf FROM cut),
live AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT text) >= {min_texts}),
alive AS (SELECT l.* FROM leafed l JOIN live USING (leaf)),
places AS (SELECT doc_id, text, ln, leaf, short, len(tokens) AS size, unnest(range(1, len(tokens) + 1)) AS place, unnest(list_transform(tokens, lambda x: {mask})) AS token FROM alive),
fixed AS (SELECT leaf, place, token FROM places WHERE place > {depth} AND token <> '<*>' GROUP BY ALL HAVING count(DISTINCT text) >= {min_texts}),
shaped AS (
  SELECT doc_id, text, ln, size, short, CAST(size AS VARCHAR) || ' ' || string_agg(t, ' ' ORDER BY place) AS template, count(*) FILTER (t <> '<*>') AS n_fixed
  FROM (SELECT p.*, CASE WHEN p.place <= {depth} OR f.token IS NOT NULL THEN p.token ELSE '<*>' END AS t
        FROM places p LEFT JOIN fixed f ON f.leaf = p.leaf AND f.place = p.place AND f.token = p.token)
  GROUP BY doc_id, text, ln, size, short),
steady AS (SELECT * FROM shaped WHERE short OR n_fixed >= {min_fixed} * size),
often AS (SELECT template, min(md5(text)) AS keeper FROM steady GROUP BY template HAVING count(DISTINCT text) >= {min_texts}),
hits AS (SELECT doc_id, ln, md5(text) <> keeper AS spare FROM steady JOIN often USING (template)),
sums AS (SELECT doc_id, list(ln) FILTER (spare) AS ats, count(*) AS n, count(*) FILTER (spare) AS gone FROM hits GROUP BY doc_id),
joined AS (SELECT d.doc_id, d.text, coalesce(s.n, 0) AS n, coalesce(s.gone, 0) AS gone, s.ats, string_split(d.text, chr(10)) AS parts FROM documents d LEFT JOIN sums s USING (doc_id))
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_recurring, CAST(gone AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gone > 0 THEN coalesce((SELECT string_agg(parts[i], chr(10) ORDER BY i) FROM (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE NOT list_contains(ats, i)), '') ELSE text END, '')) AS kept_sha256
FROM joined"""
