"""Texts whose numbers change from one base to another, exactly, or the reason why they can't.

A number is any run of digits, grouped or not, with or without a point, letters beside it or none; labels of an outline, as
in `Step 2:`, stay. A decimal becomes digits with a point where that is exact, and else a fraction in lowest terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import fraction_of, in_base, rational
from .text import boxes

# What counts as a number, as one in scientific notation, and what stands around an outline's label.
NUMBER = re.compile(r"(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)")
SCIENTIFIC = re.compile(r"(?<![A-Za-z0-9_])[-+]?(?:\d+(?:\.\d*)?|\.\d+)[eE][-+]?\d+(?![A-Za-z0-9_])")
BEFORE_LABEL = re.compile(r"(?:step|section|part|case)\s*$", re.IGNORECASE)
AFTER_LABEL = re.compile(r"\s*[:.)]")
#: Characters before and after a number in which these are looked for.
REACH = 24, 4


class Refused(ValueError):
    """A text that can't be rewritten exactly; its message is the reason."""


@dataclass(frozen=True)
class Notation:
    """A base from 2 to 10, and what it takes from decimal texts: places of decimals, and digits behind a point in the base."""

    base: int = 9
    most_places: int = 2
    most_digits: int = 12
    refuse_scientific: bool = True

    def __post_init__(self):
        if not 2 <= self.base <= 10 or self.most_places < 0 or self.most_digits < 1:
            raise ValueError("base must be 2 to 10, places 0 and digits 1 at least")

    def numbers(self, text: str) -> Iterator[re.Match]:
        for found in NUMBER.finditer(text):
            start, end = found.span()
            if not (AFTER_LABEL.match(text[end : end + REACH[1]]) and BEFORE_LABEL.search(text[max(0, start - REACH[0]) : start])):
                yield found

    def decimals(self, text: str) -> list[str]:
        return [m[0] for m in self.numbers(text) if "." in m[0]]

    def check(self, text: str) -> None:
        if self.refuse_scientific and SCIENTIFIC.search(text):
            raise Refused("scientific_notation")

    def check_places(self, token: str) -> None:
        places = len(token.partition(".")[2])
        if places > self.most_places:
            raise Refused(f"too_many_places:{token}")

    def check_decimals(self, text: str) -> None:
        """Refuses scientific notation and decimals with too many places."""
        self.check(text)
        for token in self.decimals(text):
            self.check_places(token)

    def is_finite(self, token: str) -> bool:
        """Whether a decimal ends exactly in the base."""
        return "/" not in in_base(fraction_of(token, 10), self.base, self.most_digits)

    def replaced(self, text: str, write) -> str:
        out, at = [], 0
        for m in self.numbers(text):
            out += [text[at : m.start()], write(m[0])]
            at = m.end()
        return "".join([*out, text[at:]])

    def to_base(self, text: str, latex: bool = False, brackets: bool = True, limited: bool = True) -> str:
        """A decimal text in the base. latex: fractions as \\frac; brackets: around plain ones; limited: decimals' places are."""
        self.check(text)

        def write(token: str) -> str:
            if limited and "." in token:
                self.check_places(token)
            shown = in_base(fraction_of(token, 10), self.base, self.most_digits)
            if "/" not in shown:
                return shown
            above, below = shown.strip("()").split("/")
            return f"\\frac{{{above}}}{{{below}}}" if latex else shown if brackets else shown.strip("()")

        return self.replaced(text, write)

    def to_decimal(self, text: str) -> str:
        """A text in the base in decimal; what isn't whole as a fraction in brackets."""
        self.check(text)

        def write(token: str) -> str:
            try:
                value = fraction_of(token, self.base)
            except ValueError:
                raise Refused(f"not_in_base:{token}") from None
            return str(value) if value.denominator == 1 else f"({value})"

        return self.replaced(text, write)


def told(function, *values) -> tuple[str | None, str | None]:
    """(result, None), or (None, reason)."""
    try:
        return function(*values), None
    except Refused as error:
        return None, str(error)


REWRITTEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])


def rewritten(notation: Notation, back: bool = False, **form: bool):
    """A column function: struct(text, reason) of a text in the base, or from it with `back`; one of the two is null, both are for null."""

    @F.pandas_udf(REWRITTEN)
    def rewrite(texts: pd.Series) -> pd.DataFrame:
        run = notation.to_decimal if back else lambda t: notation.to_base(t, **form)
        return pd.DataFrame([(None, None) if t is None else told(run, t) for t in texts], columns=["text", "reason"])

    return rewrite


def has_decimals(notation: Notation):
    """A column function: whether a text has a decimal that isn't an outline's label."""

    @F.pandas_udf(T.BooleanType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(notation.decimals(t or "")))

    return found


def rebase_text(source: int, target: int):
    """A column function that rewrites every number of a text exactly between decimal and another base; null where that can't be done."""
    if 10 not in (source, target):
        raise ValueError("one of the bases must be 10")
    change = rewritten(Notation(target if source == 10 else source, most_places=10**6), back=source != 10)
    return lambda c: change(c)["text"]


def numeric_policy(notation: Notation):
    """A column function of (question, answer): why a decimal source row can't be used in the base, or null where it can.

    Scientific notation and decimals with too many places, first of the question, then of the answer, are what refuses. Null is empty.
    """

    @F.pandas_udf(T.StringType())
    def reason(questions: pd.Series, answers: pd.Series) -> pd.Series:
        def one(question: str, answer: str) -> None:
            notation.check_decimals(question)
            notation.check_decimals(answer)
            notation.to_base(question)
            notation.to_base(answer, brackets=False)

        return pd.Series([told(one, q or "", a or "")[1] for q, a in zip(questions, answers, strict=True)], dtype=object)

    return reason


def policy_rejections(rows: DataFrame, question: str, answer: str, notation: Notation) -> DataFrame:
    """(reason, n) of the rows that numeric_policy() refuses."""
    return rows.select(numeric_policy(notation)(F.col(question), F.col(answer)).alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def candidate_policy(notation: Notation):
    """A column function of (question, answer, response, correct, cut): why a generated solution can't be used, or null where it can.

    In this order: empty_response, hit_token_limit (cut), failed_verification, malformed_box, box_count:<n>, box_differs (not exactly
    the answer), then numbers. Where the question has decimals, those of the response keep to the same number of places; elsewhere they
    must end exactly in the base (nonfinite_decimal:<token>). Last, the response must be rewritable.
    """

    @F.pandas_udf(T.StringType())
    def numbers_of(questions: pd.Series, responses: pd.Series) -> pd.Series:
        def one(question: str, response: str) -> None:
            limited = bool(notation.decimals(question))
            if limited:
                notation.check_decimals(response)
            for token in [] if limited else notation.decimals(response):
                if not notation.is_finite(token):
                    raise Refused(f"nonfinite_decimal:{token}")
            notation.to_base(response, latex=True, brackets=False, limited=limited)

        return pd.Series([told(one, q or "", r or "")[1] for q, r in zip(questions, responses, strict=True)], dtype=object)

    def reason(question: Column, answer: Column, response: Column, correct: Column, cut: Column) -> Column:
        found = boxes(response)
        held = found["values"]
        return (
            F.when(F.coalesce(F.trim(response), F.lit("")) == "", "empty_response").when(F.coalesce(cut, F.lit(False)), "hit_token_limit").when(~F.coalesce(correct, F.lit(False)), "failed_verification")
            .when(found["malformed"], "malformed_box").when(F.size(held) != 1, F.concat(F.lit("box_count:"), F.size(held).cast("string")))
            .when(same_rational(answer, F.try_element_at(held, F.lit(1))) == 0, "box_differs").otherwise(numbers_of(question, response))
        )

    return reason


@F.pandas_udf(T.IntegerType())
def same_rational(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 if both are exact expressions of one value."""
    def one(x: str | None, y: str | None) -> int:
        p, q = (rational(t) if t is not None else None for t in (x, y))
        return int(p is not None and p == q)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

