"""Queries over arithmetic and linear questions, made from the business tables' whole numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import notation
from sparkloom.operators import places, puzzles, scoring

from .registry import query, table


@query("""WITH n AS (SELECT c_custkey, c_custkey % 60 + 1 AS a, c_nationkey + 2 AS b FROM customer), t AS (SELECT *, to_base(a, 9) AS x, to_base(b, 9) AS y, to_base(a + b, 9) AS z FROM n)
SELECT c_custkey, 'What is ' || x || ' + ' || y || '?' AS question, z AS answer, CASE WHEN a < 9 AND b < 9 THEN 'unchanged_problem' WHEN c_custkey % 10 = 7 THEN 'solution_not_verified' WHEN CAST(x AS BIGINT) + CAST(y AS BIGINT) = CAST(z AS BIGINT) THEN 'decimal_consistent' END AS reason FROM t""")
def transformed_records(spark, folder):
    """Sums in base 9: those without a carry read the same in decimal."""
    a, b = F.col("c_custkey") % 60 + 1, F.col("c_nationkey") + 2
    total = a + b + F.when(F.col("c_custkey") % 10 == 7, 1).otherwise(0)  # wrong for every tenth
    record = puzzles.transformed_record(notation.Notation(9), F.concat(F.lit("What is "), a, F.lit(" + "), b, F.lit("?")), (a + b).cast("string"), F.concat(F.lit("It is \\boxed{"), total, F.lit("}.")))
    return places.spread(table(spark, folder, "customer")).select("c_custkey", record.alias("x")).select("c_custkey", "x.question", "x.answer", "x.reason")


@query("SELECT p_partkey, CASE WHEN k % g = 0 AND k // g = 1 THEN CAST(n // g AS VARCHAR) ELSE CAST(n // g AS VARCHAR) || '/' || CAST(k // g AS VARCHAR) END AS x FROM (SELECT p_partkey, p_size % 7 + 2 AS k, p_partkey - p_size AS n, gcd(p_size % 7 + 2, abs(p_partkey - p_size)) AS g FROM part)")
def linear_answers(spark, folder):
    k, n = F.col("p_size") % 7 + 2, F.col("p_partkey")
    question = F.concat(F.lit("Solve "), k, F.lit("*x + "), F.col("p_size"), F.lit(" = "), n, F.lit(" for x."))
    return places.spread(table(spark, folder, "part")).select("p_partkey", puzzles.decimal_answer(question).alias("x"))


@query("SELECT s_suppkey, CASE WHEN (s_suppkey * 3 + s_nationkey) % 2 = 0 THEN CAST((s_suppkey * 3 + s_nationkey) // 2 AS VARCHAR) ELSE CAST(s_suppkey * 3 + s_nationkey AS VARCHAR) || '/2' END AS x, CASE WHEN (s_suppkey * 3 - s_nationkey) % 2 = 0 THEN CAST((s_suppkey * 3 - s_nationkey) // 2 AS VARCHAR) ELSE CAST(s_suppkey * 3 - s_nationkey AS VARCHAR) || '/2' END AS y FROM supplier")
def paired_answers(spark, folder):
    """Two equations in two letters."""
    shown = lambda name: F.concat(F.lit("Solve x + y = "), F.col("s_suppkey") * 3, F.lit(", x - y = "), F.col("s_nationkey"), F.lit(f" for {name}."))
    return places.spread(table(spark, folder, "supplier")).select("s_suppkey", puzzles.decimal_answer(shown("x")).alias("x"), puzzles.decimal_answer(shown("y")).alias("y"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END AS score FROM customer")
def equivalent_answers(spark, folder):
    """Products written out, lists in another order, fractions; every fourth is off by one."""
    n, k = F.col("c_custkey"), F.col("c_custkey") % 4
    a = F.when(k == 1, F.concat(n, F.lit("; 7"))).when(k == 2, F.concat(F.lit("\\frac{"), n * 2, F.lit("}{4}"))).otherwise(F.concat(n, F.lit("(x + 1)(x - 2)")))
    b = F.when(k == 1, F.concat(F.lit("7; "), n)).when(k == 2, F.concat(n, F.lit("/2"))).otherwise(F.concat(n, F.lit("x^2 - "), n, F.lit("x - "), n * 2 + (k == 3).cast("int")))
    return places.spread(table(spark, folder, "customer")).select("c_custkey", puzzles.equivalent(a, b).alias("score"))


def found_by_sql(name: str) -> str:
    """The condition of a style flag; a name that must not follow is read with what it follows, as RE2 doesn't look ahead."""
    pattern = puzzles.STYLE_FLAGS[name].replace("'", "''")
    if not pattern.endswith("(?!\\s+from)"):
        return f"regexp_matches(text, '(?i){pattern}')"
    return f"list_contains(regexp_extract_all(text, '(?i){pattern.removesuffix('(?!' + chr(92) + 's+from)')}({chr(92)}s+from)?', 1), '')"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {found_by_sql(f)} THEN '{f}' END" for f in puzzles.STYLE_FLAGS) + "], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def style_faults(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(puzzles.style_flags(F.col("text")), ",").alias("flags"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'division_by_one' WHEN l_linenumber = 2 AND l_partkey = 0 THEN 'zero_times_expression' WHEN l_linenumber = 3 THEN 'addition_of_zero' END AS pattern FROM lineitem")
def degenerate_questions(spark, folder):
    k, p = F.col("l_linenumber"), F.col("l_partkey")
    shown = F.when(k == 1, F.concat(p, F.lit(" divided by 1"))).when(k == 2, F.concat(p, F.lit(" * 3"))).when(k == 3, F.concat(p, F.lit(" + 0"))).otherwise(F.concat(p, F.lit(" / 12")))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", puzzles.degenerate(shown).alias("pattern"))


#: Items with a price: a whole number of base 9, or a fraction, as no hundredth ends in it.
PRICE = "CAST(round(p_retailprice * 100) AS BIGINT)"
NINE = f"CASE WHEN {PRICE} % 100 = 0 THEN to_base({PRICE} // 100, 9) ELSE '{{a}}' || to_base({PRICE} // gcd({PRICE}, 100), 9) || '{{m}}' || to_base(100 // gcd({PRICE}, 100), 9) || '{{z}}' END"


@query(f"""SELECT p_partkey, 'Item' || to_base(p_partkey, 9) || ' costs ' || {NINE.format(a='(', m='/', z=')')} || ', Step ' || p_size || ': ' || to_base(p_size * 1000 + 123, 9) AS plain,
 'Item' || to_base(p_partkey, 9) || ' costs ' || {NINE.format(a=chr(92) + 'frac{', m='}{', z='}')} || ', Step ' || p_size || ': ' || to_base(p_size * 1000 + 123, 9) AS latex,
 'Item' || p_partkey || ' costs ' || CASE WHEN {PRICE} % 100 = 0 THEN CAST({PRICE} // 100 AS VARCHAR) ELSE '(' || {PRICE} // gcd({PRICE}, 100) || '/' || 100 // gcd({PRICE}, 100) || ')' END || ', Step ' || p_size || ': ' || p_size * 1000 + 123 AS back FROM part""")
def rewritten_prices(spark, folder):
    """Numbers beside letters, decimals, grouped digits and an outline's label, into base 9 and back."""
    rows = places.spread(table(spark, folder, "part"))
    shown = F.concat(F.lit("Item"), "p_partkey", F.lit(" costs "), F.format_string("%.2f", F.col("p_retailprice").cast("double")), F.lit(", Step "), "p_size", F.lit(": "), "p_size", F.lit(",123"))
    nine = notation.Notation(9)
    done = rows.select("p_partkey", notation.rewritten(nine)(shown)["text"].alias("plain"), notation.rewritten(nine, latex=True)(shown)["text"].alias("latex"))
    return done.select("*", F.replace(F.replace(notation.rewritten(nine, back=True)(F.col("plain"))["text"], F.lit("(("), F.lit("(")), F.lit("))"), F.lit(")")).alias("back"))


POLICY = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'scientific_notation' WHEN o_orderkey % 5 = 2 THEN 'too_many_places:' || o_custkey || '.125' WHEN o_orderkey % 5 = 3 AND o_orderkey % 2 = 0 THEN 'too_many_places:.0625' END AS reason FROM orders"


def source_rows(spark, folder):
    """Questions in scientific notation, with too many places, and answers with such."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    question = F.when(k == 1, F.concat(F.lit("What is "), c, F.lit(".5e3 + 1?"))).when(k == 2, F.concat(F.lit("What is "), c, F.lit(".125 + 1?"))).otherwise(F.concat(F.lit("Step 1.2345: what is x1e5 and "), c, F.lit(".25?")))
    return places.spread(table(spark, folder, "orders")).select("o_orderkey", question.alias("q"), F.when((k == 3) & (F.col("o_orderkey") % 2 == 0), ".0625").otherwise("12").alias("a"))


@query(POLICY)
def number_policies(spark, folder):
    return source_rows(spark, folder).select("o_orderkey", notation.numeric_policy(notation.Notation(9))(F.col("q"), F.col("a")).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM ({POLICY}) WHERE reason IS NOT NULL GROUP BY reason")
def policy_rejections(spark, folder):
    return notation.policy_rejections(source_rows(spark, folder), "q", "a", notation.Notation(9))


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'hit_token_limit' WHEN 2 THEN 'failed_verification' WHEN 3 THEN 'malformed_box' WHEN 4 THEN 'box_count:2' WHEN 5 THEN 'box_differs'
 WHEN 6 THEN 'nonfinite_decimal:0.2' WHEN 7 THEN 'too_many_places:' || o_custkey || '.000' END AS reason FROM orders""")
def candidate_reasons(spark, folder):
    """Generated solutions, each with another fault; whole decimals pass where the question has none."""
    k, c = F.col("o_orderkey") % 9, F.col("o_custkey").cast("string")
    box = lambda x: F.concat(F.lit("so \\boxed{"), x, F.lit("}"))
    response = (
        F.when(k == 0, " ").when(k == 3, F.concat(box(c), F.lit(" \\boxed{"))).when(k == 4, F.concat(box(c), box(c))).when(k == 5, box(F.concat(c, F.lit("1")))).when(k == 6, F.concat(F.lit("0.2 "), box(c)))
        .when(k == 7, F.concat(c, F.lit(".000 "), box(c))).otherwise(F.concat(c, F.lit(".000 "), box(F.concat(F.lit("\\frac{"), c, F.lit("}{1}")))))
    )
    question = F.when(k == 7, F.concat(F.lit("What is 0.5 + "), c, F.lit("?"))).otherwise(F.concat(F.lit("What is 0 + "), c, F.lit("?")))
    return places.spread(table(spark, folder, "orders")).select("o_orderkey", notation.candidate_policy(notation.Notation(9))(question, c, response, k != 2, k == 1).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN k = 5 THEN 0 ELSE 1 END AS same, CASE WHEN p_partkey % 5 = 1 THEN 'unclosed_think_block' WHEN p_partkey % 5 = 2 THEN 'empty_visible_response' WHEN k = 5 THEN 'failed' WHEN p_partkey % 5 = 3 THEN 'full_response' ELSE 'last_boxed' END AS method
FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)""")
def answer_forms(spark, folder):
    """Roots, intervals, sets, signs, trigonometry in two forms each; the last kind differs in a bracket."""
    n, k = F.col("p_size") + 2, F.col("p_partkey") % 6
    of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    pairs = [
        (of("\\sqrt{", n * n * 2, "}"), of(n, "\\sqrt{2}")), (of("(", n, ", \\infty)"), of("\\left(\\frac{", n * 2, "}{2}, \\infty\\right)")), (of("\\{", n, ", 1/2\\}"), of("0.5; ", n)), (of("\\pm ", n), of("-", n, ", ", n)),
        (of(n, "(\\sin(x)*sin(x) + cos(x)*cos(x))"), n.cast("string")), (of("[", n, ", ", n + 1, ")"), of("[", n, ", ", n + 1, "]")),
    ]
    a, b = (F.array(*(p[i] for p in pairs)) for i in (0, 1))
    rows = places.spread(table(spark, folder, "part")).select("p_partkey", F.get(a, k.cast("int")).alias("a"), F.get(b, k.cast("int")).alias("b"))
    part = F.col("p_partkey") % 5
    response = F.when(part == 1, F.concat(F.lit("<think>"), "a")).when(part == 2, "<think>x</think> ").when(part == 3, F.col("a")).otherwise(F.concat(F.lit("<think>\\boxed{0}</think>so \\boxed{"), "a", F.lit("}")))
    return rows.select("p_partkey", puzzles.equivalent("a", "b").alias("same"), scoring.score_details(response, F.col("b"))["method"].alias("method"))
