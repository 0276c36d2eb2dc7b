"""Row filters as text conditions, global search, projection, paging, samples and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.hashing import hash_unit
from sparkloom.functions.text import stripped

COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
OPS = ("eq", "neq", "contains", "not_contains", "regex", *COMPARE)


def stringified(rows: DataFrame, name: str) -> Column:
    """A column as search sees it: text as it is, True and False, other values as JSON."""
    kind = rows.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.initcap(F.col(f"`{name}`").cast("string"))
    return F.col(f"`{name}`").cast("string")


def parse_condition(text: str) -> tuple[str, str, str]:
    """(column, op, value) of column:op:value; value may hold colons."""
    parts = text.split(":", 2)
    if len(parts) != 3 or parts[1] not in OPS:
        raise ValueError(f"{text!r} isn't column:op:value with an op of {', '.join(OPS)}")
    return parts[0], parts[1], parts[2]


def condition(rows: DataFrame, text: str) -> Column:
    """The condition as a column, never null: a missing column, a null and what doesn't compare don't match.

    eq and neq compare as text, contains, not_contains and regex ignore case, the others compare as numbers. Plain text
    and number columns keep a form that Parquet scans can use.
    """
    name, op, value = parse_condition(text)
    if name not in rows.columns:
        return F.lit(False)
    column, kind = F.col(f"`{name}`"), rows.schema[name].dataType
    if op in COMPARE:
        left = column if isinstance(kind, T.NumericType) else column.cast("string").try_cast("double")
        try:
            number = float(value)
        except ValueError:
            return F.lit(False)
        if number != number:
            return F.lit(False)  # NaN compares with nothing
        if not isinstance(kind, T.IntegralType | T.DecimalType):
            left = F.nanvl(left.cast("double"), F.lit(None).cast("double"))
        found = getattr(left, COMPARE[op])(int(number) if number.is_integer() and isinstance(kind, T.IntegralType) else number)
    else:
        shown = stringified(rows, name)
        low, want = F.lower(shown), F.lit(value.lower())
        found = {
            "eq": lambda: shown == value,
            "neq": lambda: ~shown.eqNullSafe(F.lit(value)),
            "contains": lambda: low.contains(want),
            "not_contains": lambda: ~low.contains(want),
            "regex": lambda: shown.rlike(f"(?i){value}"),
        }[op]()
    return found if op == "eq" else F.coalesce(found, F.lit(False))


def where(rows: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Rows that meet all conditions."""
    for text in conditions:
        rows = rows.filter(condition(rows, text))
    return rows


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, whatever the case."""
    want = F.lit(text.lower())
    return rows.filter(F.exists(F.array(*(F.lower(stringified(rows, c)) for c in rows.columns)), lambda x: F.coalesce(x.contains(want), F.lit(False))))


def search_regex(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows with a match of the pattern in any column, whatever the case."""
    return rows.filter(F.exists(F.array(*(stringified(rows, c) for c in rows.columns)), lambda x: F.coalesce(x.rlike(f"(?i){pattern}"), F.lit(False))))


def project(rows: DataFrame, columns: Sequence[str], marker: str = "<missing>") -> DataFrame:
    """The columns asked for; those that aren't there hold the marker."""
    return rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(marker).alias(c) for c in columns))


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A stretch of the rows in their order."""
    return rows.orderBy(order).offset(offset).limit(limit)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the hash of seed and key: the same rows however the data are laid out."""
    return rows.orderBy(hash_unit(F.lit(str(seed)), F.col(key)), key).limit(n)


def preview(c: Column, size: int = 1200) -> Column:
    """Long texts cut, with a marker."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("\n... [truncated]"))).otherwise(c)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails, or null; a rule that gives null fails."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        reason = F.when(F.coalesce(ok, F.lit(False)), reason).otherwise(F.lit(name))
    return reason


def rejections(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n) of the rows rejected, by their first failing rule."""
    return rows.select(first_reason(rules).alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


#: Fixed value: answers that are a whole or decimal number, or a fraction of such.
NUMERIC_ANSWER = r"^\s*[-+]?((\d+(\.\d*)?|\.\d+)(/[+-]?\d+(\.\d*)?)?|\d+\s*/\s*[-+]?\d+)\s*\z"


def numeric_answer(answer: Column) -> Column:
    """Whether an answer is a simple number; commas and outer blanks don't count."""
    return F.replace(stripped(answer), F.lit(",")).rlike("(?U)" + NUMERIC_ANSWER)


def content_rules(question: Column, answer: Column) -> list[tuple[str, Column]]:
    """Rules for first_reason(): both texts are there, the question has a digit, and the answer is a simple number."""
    return [
        ("missing_question", stripped(question) != ""),
        ("missing_answer", stripped(answer) != ""),
        ("question_without_digit", question.rlike("(?U)\\d")),
        ("answer_not_numeric", numeric_answer(answer)),
    ]


def grid_members(rows: DataFrame, axes: dict[str, Sequence], required: Sequence[str] = ()) -> DataFrame:
    """Rows whose every axis has one of the grid's values, and whose required columns aren't null."""
    for name, values in axes.items():
        rows = rows.filter(F.col(name).isin(*values))
    for name in required:
        rows = rows.filter(F.col(name).isNotNull())
    return rows


def audit_keeps(status: Column, consistent: Column, recommendation: Column) -> Column:
    """Whether an audit ended well, found the label consistent and recommends to keep the row; never null."""
    return F.coalesce((F.lower(status) == "ok") & consistent & (F.lower(recommendation) == "keep"), F.lit(False))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with columns renamed; where the new name is there already, its values win and the old ones fill nulls."""
    for old, new in names.items():
        if old in rows.columns:
            rows = rows.withColumn(new, F.coalesce(new, old)).drop(old) if new in rows.columns else rows.withColumnRenamed(old, new)
    return rows


def alias_conflicts(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(alias, n) of the rows whose alias differs from its column, nulls compared as values."""
    parts = F.array(*(F.when(~F.col(a).eqNullSafe(F.col(c)), F.lit(a)) for a, c in aliases.items()))
    return rows.select(F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("alias")).groupBy("alias").agg(F.count("*").alias("n"))


def close_to(a: Column, b: Column, absolute: float = 1e-12, relative: float = 0.0) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)
