"""Scores of responses against references, per task."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.equivalence import same_answer
from sparkloom.functions.notation import rebase_text
from sparkloom.functions.numbers import fraction_of, in_base, rational
from sparkloom.functions.text import action_lines, answer_tag, last_box, visible

MARKER = "Action Input:"


def merged_objects(text: str) -> dict:
    """All JSON objects after a marker, merged; blocks that don't parse are left out."""
    out, at, decoder = {}, 0, json.JSONDecoder()
    while (at := text.find(MARKER, at)) >= 0:
        at += len(MARKER)
        rest = text[at:].lstrip()
        if rest.startswith("{"):
            try:
                out.update(decoder.raw_decode(rest)[0])
            except ValueError:
                pass
    return out


@F.pandas_udf(T.StringType())
def action_inputs(texts: pd.Series) -> pd.Series:
    """The merged inputs of a response as canonical JSON: Spark can't parse JSON inside other text."""
    return texts.map(lambda t: json.dumps(merged_objects(t), sort_keys=True), na_action="ignore")


@F.pandas_udf(T.StringType())
def reference_inputs(inputs: pd.Series) -> pd.Series:
    """The merged inputs of a reference's array of JSON texts as canonical JSON."""
    def one(items):
        out = {}
        for x in items:
            try:
                found = json.loads(x)
                out.update(found if isinstance(found, dict) else {})
            except (TypeError, ValueError):
                pass
        return json.dumps(out, sort_keys=True)

    return inputs.map(one, na_action="ignore")


def score_tools(response: Column, reference: Column) -> Column:
    """1 if the actions are the reference's, in any order, and so are the merged inputs.

    reference: array of struct Action, Action_Input (JSON text).
    """
    same = F.array_sort(action_lines(response)) == F.array_sort(F.transform(reference, lambda x: x["Action"]))
    inputs = action_inputs(response) == reference_inputs(F.transform(reference, lambda x: x["Action_Input"]))
    return (F.coalesce(same & inputs, F.lit(False))).cast("int")


def tool_failure(response: Column, reference: Column) -> Column:
    """correct, missing_action, malformed_or_missing_inputs, wrong_actions, wrong_inputs or other, by the scorer's rules."""
    wanted = F.array_sort(F.transform(reference, lambda x: x["Action"]))
    actions, inputs = F.array_sort(action_lines(response)), action_inputs(response)
    gold = reference_inputs(F.transform(reference, lambda x: x["Action_Input"]))
    return (
        F.when((actions == wanted) & (inputs == gold), "correct").when(F.size(actions) == 0, "missing_action")
        .when((inputs == "{}") & (gold != "{}"), "malformed_or_missing_inputs").when(actions != wanted, "wrong_actions").when(inputs != gold, "wrong_inputs").otherwise("other")
    )


def score_tag(response: Column, answer: Column) -> Column:
    """1 if the last answer tag's text is the answer exactly."""
    return F.coalesce(answer_tag(response) == answer, F.lit(False)).cast("int")


def coordinate(c: Column) -> Column:
    """struct(x, y) of a text that is (x, y) with whole numbers and nothing else, or null."""
    text = F.replace(F.trim(c), F.lit("−"), F.lit("-"))
    pattern = "^\\(\\s*([+-]?\\d+)\\s*,\\s*([+-]?\\d+)\\s*\\)$"
    x, y = (F.regexp_extract(text, pattern, i).try_cast("long") for i in (1, 2))
    return F.when(text.rlike(pattern), F.struct(x.alias("x"), y.alias("y")))


def score_coordinate(response: Column, x: Column, y: Column) -> Column:
    """1 if the last box holds the pair (x, y)."""
    found = coordinate(last_box(response))
    return F.coalesce((found["x"] == x) & (found["y"] == y), F.lit(False)).cast("int")


def score_base_number(base: int):
    """A function of (response, gold): 1 if the visible last box equals gold exactly, both read in the base.

    Texts that aren't numeric expressions are equal if they are the same after rewriting.
    """
    rewrite = rebase_text(base, 10)

    @F.pandas_udf(T.IntegerType())
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return 0
            p, q = rational(x), rational(y)
            return int(p == q if p is not None and q is not None else x.strip() == y.strip())

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return lambda response, gold: equal(rewrite(last_box(visible(response))), rewrite(gold))


@F.pandas_udf(T.StringType())
def matched(shown: pd.Series, box: pd.Series, gold: pd.Series) -> pd.Series:
    """How a visible response and its last box meet the gold answer: full_response or last_boxed, exactly or as equivalence reads them; null if not at all."""
    def same(x: str | None, y: str) -> bool:
        if x is None or not x.strip():
            return False
        p, q = rational(x), rational(y)
        return p == q if p is not None and q is not None else same_answer(x, y)

    def one(text: str | None, held: str | None, y: str | None) -> str | None:
        if y is None or not y.strip():
            return None
        return "last_boxed" if same(held, y) else "full_response" if held is None and same(text, y) else None

    return pd.Series([one(*x) for x in zip(shown, box, gold, strict=True)], dtype=object)


def score_details(response: Column, gold: Column) -> Column:
    """struct(score, method, extracted, error) of a response to a question with a number, an expression or a list of such as its answer.

    method: last_boxed, or full_response where there is no box, for a right one; else gold_missing, unclosed_think_block, empty_visible_response
    or failed, with what is wrong as the error.
    """
    shown = visible(response)
    box = last_box(shown)
    how = matched(shown, box, gold)
    empty = F.coalesce(F.trim(gold), F.lit("")) == ""
    method = F.when(empty, "gold_missing").when(response.isNotNull() & shown.isNull(), "unclosed_think_block").when(F.coalesce(shown, F.lit("")) == "", "empty_visible_response").otherwise(F.coalesce(how, F.lit("failed")))
    error = (
        F.when(empty, "there is no gold answer").when(method == "unclosed_think_block", "a think block isn't closed").when(method == "empty_visible_response", "nothing is left to see")
        .when(how.isNull() & box.isNull(), "there is no box").when(how.isNull(), "the box holds another answer")
    )
    return F.struct(how.isNotNull().cast("int").alias("score"), method.alias("method"), F.coalesce(box, F.when(how.isNotNull(), shown)).alias("extracted"), error.alias("error"))


def score_number(response: Column, gold: Column) -> Column:
    """1 if the visible last box, or else the whole visible text, is gold's answer."""
    return score_details(response, gold)["score"]


def record(response: Column, extracted: Column, score: Column, method: str) -> Column:
    """What is kept of one scored response."""
    return F.struct(score.alias("score"), F.lit(method).alias("method"), extracted.alias("extracted"), F.when(extracted.isNull(), "nothing extracted").alias("error"))


__all__ = ["action_inputs", "coordinate", "fraction_of", "in_base", "record", "reference_inputs", "score_base_number", "score_coordinate", "score_details", "score_number", "score_tag", "score_tools", "tool_failure"]
