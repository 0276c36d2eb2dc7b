"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule bounds one measure of a text: lengths, symbols, stop words and lines, mostly as ratios. The table becomes one
struct of booleans, so a scan without any shuffle judges all rules, and a row never leaves the JVM.

Repeated windows are found in two steps: a text whose windows all differ in their 64-bit hashes repeats none. Only the
other texts sort their windows, by their words and not by hashes, so the count is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words in a window.
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Frequent words of English, French, German and Spanish, as they stand in running text.
STOP_WORDS = (
    "the of and to in is that for was on with as by at from this "
    "le la les de des du et un une est dans pour que qui par sur "
    "der die das und den von zu mit ist ein eine im nicht auf dem sich "
    "el los las del y en se con por una no su es lo al"
).split()


@dataclass(frozen=True)
class Rule:
    """Texts pass whose `measure` lies within [at_least, at_most]; texts of fewer than `from_words` words pass anyway."""

    name: str
    measure: str
    at_least: float | None = None
    at_most: float | None = None
    from_words: int = 0

    def passed(self) -> Column:
        """A measure that isn't defined, as a ratio of a text without words, passes."""
        ok = F.lit(True)
        for bound, test in ((self.at_least, F.col(self.measure) >= self.at_least), (self.at_most, F.col(self.measure) <= self.at_most)):
            ok = ok & test if bound is not None else ok
        return F.coalesce(ok, F.lit(True)) | (F.col("n_words") < self.from_words)


#: The rules that every text must meet.
BASE = (
    Rule("words", "n_words", at_least=10),
    Rule("repeats", "repeat_percent", at_most=20),
)
#: The other rules; a caller may give a table of their own.
RULES = (
    Rule("word_length", "mean_word_chars", at_least=2, at_most=16),
    Rule("symbols", "symbols_per_word", at_most=0.1),
    Rule("letters", "letter_word_ratio", at_least=0.7, from_words=20),
    Rule("capitals", "capital_ratio", at_most=0.5, from_words=20),
    Rule("stop_words", "stop_word_ratio", at_least=0.03, from_words=80),
    Rule("same_lines", "dup_line_ratio", at_most=0.5, from_words=30),
    Rule("bullets", "bullet_line_ratio", at_most=0.9, from_words=30),
    Rule("ellipses", "ellipsis_line_ratio", at_most=0.3, from_words=30),
)


def with_repeat_words(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts(__words, __n: their number) with n_repeat_words, the words within windows that stand in the text twice or more."""
    starts = F.sequence(F.lit(0), F.col("__n") - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(window)]))
    some = F.coalesce((F.col("__n") >= window) & (F.size(F.array_distinct(hashes)) < F.col("__n") - (window - 1)), F.lit(False))
    placed = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice("__words", i + 1, window)).alias("w"), i.alias("i")))
    same = lambda x, i: F.coalesce(x["w"] == F.get("__sorted", i)["w"], F.lit(False))
    repeated = F.transform(F.filter("__sorted", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])
    step = F.transform("__places", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("__places", k + 1) - p, F.lit(window))))
    out = texts.withColumn("__some", some).withColumn("__sorted", F.when(F.col("__some"), F.sort_array(placed)))
    out = out.withColumn("__places", F.when(F.col("__some"), F.sort_array(repeated)))
    return out.withColumn("n_repeat_words", F.when(F.col("__some"), F.aggregate(step, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and what rules can bound in docs(doc_id, text): counts as longs, ratios as doubles, null where they'd divide by zero.

    Words are runs of characters other than space and \\x09-\\x0D; lines end at \\n and count if they have a word.
    """
    count = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    those = lambda of, test: F.size(F.filter(of, test))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumns({"__words": F.array_remove(F.split("text", "[\\x09-\\x0D ]+"), ""), "__lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x09-\\x0D ]"))})
    out = out.withColumn("__n", F.size("__words"))
    out = out.select(
        "doc_id", "__words", "__n", F.col("__n").cast("long").alias("n_words"), F.size("__lines").cast("long").alias("n_lines"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), count("\\p{Lu}").alias("__capitals"),
        those("__words", lambda x: x.rlike("\\p{L}")).alias("__letters"), those("__words", lambda x: x.isin(STOP_WORDS)).alias("__stops"),
        those("__lines", lambda x: x.rlike("^[\\x09-\\x0D ]*[-*\u2022]")).alias("__bullets"), those("__lines", lambda x: x.rlike("(\\.\\.\\.|\u2026)[\\x09-\\x0D ]*$")).alias("__dots"),
    )
    out = with_repeat_words(out)
    per = lambda x, of: F.try_divide(F.col(x).cast("double"), F.col(of).cast("double"))
    counts = ["n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        "doc_id", *counts, F.try_divide(100.0 * F.col("n_repeat_words"), F.col("n_words").cast("double")).alias("repeat_percent"),
        per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "n_words").alias("symbols_per_word"), per("__letters", "n_words").alias("letter_word_ratio"),
        per("__capitals", "word_chars").alias("capital_ratio"), per("__stops", "n_words").alias("stop_word_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("__bullets", "n_lines").alias("bullet_line_ratio"), per("__dots", "n_lines").alias("ellipsis_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measures() fails, in the table's order, comma-joined."""
    return F.concat_ws(",", *[F.when(~r.passed(), F.lit(r.name)) for r in rules])


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """One row per row of docs(doc_id, text): the measures, base_failed, failed (names of all failed rules) and kept.

    kept: no rule of either table fails. Null and empty texts have no words, so the base rules reject them. Repeated rows
    get equal results; ids play no part and may be null; other columns are ignored; no documents give no rows. A text is
    judged whole, however long; its words are held once, and five times where windows repeat.
    """
    judged = measures(docs).withColumns({"__base": compiled(base), "__more": compiled(rules)})
    failed = F.concat_ws(",", F.when(F.col("__base") != "", F.col("__base")), F.when(F.col("__more") != "", F.col("__more")))
    judged = judged.withColumns({"base_failed": F.col("__base") != "", "failed": failed})
    return judged.withColumn("kept", F.col("failed") == "").drop("__base", "__more")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the contract's counts, base_failed, kept and the names of the failed rules of every document."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def oracle(rules: tuple[Rule, ...] = RULES, window: int = WINDOW) -> str:
    """DuckDB SQL for op13_quality_rules."""
    space = "[\\x09-\\x0D ]"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    share = lambda x, of: f"CASE WHEN {of} > 0 THEN CAST({x} AS DOUBLE) / {of} END"
    bounds = lambda r: " AND ".join([f"{r.measure} >= {r.at_least}"] * (r.at_least is not None) + [f"{r.measure} <= {r.at_most}"] * (r.at_most is not None))
    broken = ", ".join(f"CASE WHEN n_words >= {r.from_words} AND NOT ({bounds(r)}) THEN '{r.name}' END" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT k, doc_id, text, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D ]')) AS li FROM d),
p AS (SELECT k, unnest(range(1, len(w) - {window - 2})) AS i, w FROM c WHERE len(w) >= {window}),
v AS (SELECT k, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM p),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM v) WHERE n > 1),
g AS (SELECT k, sum(least({window}, coalesce(nxt - i, {window}))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM r) GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(li) AS n_lines, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(li) - len(list_distinct(li)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(g.n, 0) AS BIGINT) AS n_repeat_words, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS capitals,
             len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS letters, len(list_filter(w, lambda x: x IN ({stops}))) AS stops,
             len(list_filter(li, lambda x: regexp_matches(x, '^{space}*[-*\u2022]'))) AS bullets, len(list_filter(li, lambda x: regexp_matches(x, '([.][.][.]|\u2026){space}*$'))) AS dots
      FROM c LEFT JOIN g USING (k)),
q AS (SELECT *, {share('word_chars', 'n_words')} AS mean_word_chars, {share('n_symbols', 'n_words')} AS symbols_per_word, {share('letters', 'n_words')} AS letter_word_ratio,
             {share('capitals', 'word_chars')} AS capital_ratio, {share('stops', 'n_words')} AS stop_word_ratio, {share('n_dup_lines', 'n_lines')} AS dup_line_ratio,
             {share('bullets', 'n_lines')} AS bullet_line_ratio, {share('dots', 'n_lines')} AS ellipsis_line_ratio FROM m),
f AS (SELECT *, concat_ws(',', CASE WHEN n_words < 10 THEN 'words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeats' END) AS base, concat_ws(',', {broken}) AS more FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base <> '' AS base_failed, base = '' AND more = '' AS kept, concat_ws(',', nullif(base, ''), nullif(more, '')) AS failed FROM f"""
