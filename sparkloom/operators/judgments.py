"""Judgments of an audit: checked against a closed form, made consistent, or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the fields of a judgment may hold.
LABELS = {"consistent": "keep", "suspect": "review", "inconsistent": "drop"}
FINAL_STATUSES = ("correct", "incorrect", "unclear")
CHECK_STATUSES = ("passed", "failed", "unclear", "not_applicable")
SEVERITIES = ("low", "medium", "high")
ASPECTS = ("arithmetic", "algebra", "base_semantics", "positional_reasoning", "final_answer")
FAILURE_MODES = (
    "invalid_arithmetic", "invalid_algebra", "invalid_base_digit_or_literal", "incorrect_base_conversion", "mixed_base_reasoning", "decimal_or_approximation_issue", "positional_algorithm_mismatch",
    "carry_or_borrow_mismatch", "divisibility_or_digit_argument_mismatch", "question_response_mismatch", "final_answer_mismatch", "malformed_or_incomplete_reasoning", "ambiguous_notation",
    "unsupported_or_unverifiable_claim", "other",
)
#: Failure modes and pieces of evidence in a judgment at most, and the confidence of one whose evidence fell out.
MODES, EVIDENCE, DOUBT = 5, 3, 60
DROPPED = "None of the evidence quoted for an inconsistency was found in the audited text; to be reviewed. "


# Marks of formatting that a quote may lack, and signs that may be written in another way.
MARKS = ("**", "__", "`", "\\left", "\\right", "\\(", "\\)", "\\[", "\\]", "$")
SIGNS = {"−": "-", "–": "-", "—": "-", "⇒": "->", "→": "->", "⟶": "->", "\\times": "*", "\\cdot": "*", "×": "*", "·": "*", "\\div": "/", "÷": "/"}
EDGES = " .,:;!?\"'"


def squeezed(c: Column) -> Column:
    """A text for looking up quotes: without list marks and formatting, signs in one form, single blanks, no punctuation at its ends."""
    c = F.regexp_replace(c, r"(?m)^\s*[-+*]\s+", "")
    for mark in MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    for sign, plain in SIGNS.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.trim(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(EDGES))


def faults(j: Column) -> list[tuple[str, Column]]:
    """What refuses a judgment, in this order: a name and when it holds; null counts as wrong."""
    modes, evidence, checks = j["failure_modes"], j["evidence"], j["checked_aspects"]
    known = F.array(*map(F.lit, FAILURE_MODES))
    bad = lambda e: F.coalesce(~e["severity"].isin(*SEVERITIES) | (F.trim(e["quote"]) == "") | (F.trim(e["explanation"]) == ""), F.lit(True))
    consistent = j["label"] == "consistent"
    return [
        ("invalid_label", ~j["label"].isin(*LABELS)), ("invalid_confidence", ~j["confidence"].between(0, 100)), ("invalid_final_answer_status", ~j["final_answer_status"].isin(*FINAL_STATUSES)),
        ("invalid_recommendation", ~j["recommendation"].isin(*LABELS.values())), ("empty_summary", F.trim(j["summary"]) == ""), ("invalid_failure_modes", F.exists(modes, lambda m: F.coalesce(~F.array_contains(known, m), F.lit(True)))),
        ("too_much_evidence", F.size(evidence) > EVIDENCE), ("invalid_evidence", ~consistent & F.exists(evidence, bad)),
        ("invalid_aspects", (F.array_sort(F.map_keys(checks)) != F.array(*map(F.lit, sorted(ASPECTS)))) | F.exists(F.map_values(checks), lambda s: F.coalesce(~s.isin(*CHECK_STATUSES), F.lit(True)))),
        ("consistent_without_correct_answer", consistent & (j["final_answer_status"] != "correct")), ("consistent_with_failed_aspect", consistent & F.array_contains(F.map_values(checks), "failed")),
        ("inconsistent_without_failure_mode", (j["label"] == "inconsistent") & (F.size(modes) == 0)),
    ]


def validated(rows: DataFrame, judgment: str, source: Column) -> DataFrame:
    """rows with valid (the judgment made consistent, or null), reason (why it was refused, or null) and dropped (quotes not found).

    The label fixes the recommendation. Failure modes count once, five at most. A quote must stand in the audited source text, but for
    its white space and typography, else it is dropped. Consistent judgments have neither modes nor evidence. An inconsistent one whose
    quotes are all dropped becomes suspect, with a confidence of 60 at most and failed aspects unclear, and its summary says so.
    """
    j = F.col(judgment)
    reason = F.when(j.isNull(), "missing")
    for name, wrong in faults(j):
        reason = reason.when(F.coalesce(wrong, F.lit(True)), name)
    told = rows.withColumns({"reason": reason, "_source": squeezed(source)})
    meant = F.when(j["label"] == "consistent", F.slice(j["evidence"], 1, 0)).otherwise(j["evidence"])
    found = F.filter(meant, lambda e: (squeezed(e["quote"]) != "") & F.contains(F.col("_source"), squeezed(e["quote"])))
    told = told.withColumn("_kept", F.transform(found, lambda e: F.struct(F.trim(e["quote"]).alias("quote"), F.trim(e["explanation"]).alias("explanation"), e["severity"].alias("severity"))))
    told = told.withColumn("dropped", F.when(F.col("reason").isNull(), F.size(meant) - F.size("_kept")))
    doubt = (j["label"] == "inconsistent") & (F.size("_kept") == 0)
    label = F.when(doubt, "suspect").otherwise(j["label"])
    modes = F.slice(F.array_distinct(j["failure_modes"]), 1, MODES)
    summary = F.concat(F.when(doubt & (F.col("dropped") > 0), F.lit(DROPPED)).otherwise(F.lit("")), F.trim(j["summary"]))
    valid = F.struct(
        label.alias("label"), F.when(doubt, F.least(j["confidence"], F.lit(DOUBT))).otherwise(j["confidence"]).alias("confidence"), j["final_answer_status"].alias("final_answer_status"),
        F.coalesce(*(F.when(label == name, F.lit(advice)) for name, advice in LABELS.items())).alias("recommendation"), summary.alias("summary"),
        F.when(label == "consistent", F.slice(modes, 1, 0)).otherwise(modes).alias("failure_modes"), F.col("_kept").alias("evidence"),
        F.transform_values(j["checked_aspects"], lambda _, v: F.when(doubt & (v == "failed"), "unclear").otherwise(v)).alias("checked_aspects"),
    )
    return told.withColumn("valid", F.when(F.col("reason").isNull(), valid)).drop("_source", "_kept")
