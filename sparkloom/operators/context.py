"""Context construction: strategies as column functions, chosen per row, and merged into message shells."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import hash_unit
from sparkloom.functions.text import render

#: What templates may name; each is a column.
VARIABLES = ("question", "compact_answer", "full_reference", "short_hint", "source_context", "student_response", "feedback_text", "sibling_text")


@dataclass(frozen=True)
class Strategy:
    """Templates of a strategy, its first-stage ones, and what a row must hold for it."""

    name: str
    templates: tuple[str, ...]
    stage1: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, templates: Sequence[str], stage1: Sequence[str] = (), needs: Sequence[str] = ()) -> None:
    """Adds a strategy; templates name VARIABLES as $name."""
    STRATEGIES[name] = Strategy(name, tuple(templates), tuple(stage1), tuple(needs))


def _defaults() -> None:
    ask = "$question"
    example = "$question\n\nHere is an example of a correct {}:\n{}\n\nNow answer in your own words."
    guide = "$question\n\nUse this {} as guidance, without quoting it:\n{}"
    register_strategy("dataset_default", [ask])
    register_strategy("no_context", [ask])
    reasons = ("Reason step by step before you answer.", "Think about what is asked, work it out in small steps, and answer last.", "Before you answer, write down each step and check it against the question.")
    register_strategy("static_reasoning", [f"$question\n\n{r}" for r in reasons])
    for name, text in (
        ("gold_answer_as_example", example.format("answer", "$compact_answer")), ("gold_answer_as_example_v2", "Example answer: $compact_answer\n\n$question"),
        ("gold_answer_as_guidance", guide.format("answer", "$compact_answer")),
    ):
        register_strategy(name, [text], needs=["compact_answer"])
    for name, text in (
        ("gold_response_inv", "Reference:\n$full_reference\n\n$question"), ("gold_response_as_example", example.format("response", "$full_reference")),
        ("gold_response_as_guidance", guide.format("response", "$full_reference")), ("gold_response_as_example_bracket", example.format("response", "[[ $full_reference ]]")),
        ("gold_response_as_guidance_bracket", guide.format("response", "[[ $full_reference ]]")),
    ):
        register_strategy(name, [text], needs=["full_reference"])
    for name, text in (("gold_hint", "$question\n\nHint: $short_hint"), ("gold_hint_v2", "Hint: $short_hint\n\n$question"), ("gold_hint_v3", "$question\n\nA short hint may help: $short_hint")):
        register_strategy(name, [text], needs=["short_hint"])
    for name, rewrite in (
        ("gold_response_rewrite_as_example", "Rewrite this response in other words:\n$full_reference"),
        ("gold_response_rewrite_as_example_v2", "Question:\n$question\n\nRewrite this response to it in other words, step for step:\n$full_reference"),
        ("gold_response_rewrite_as_example_v3", "Rewrite this response as its author would in a style like that of the attempt below, with the same answer.\n$full_reference\n\nAttempt:\n$student_response"),
    ):
        register_strategy(name, [example.format("response", "$feedback_text")], [rewrite], ["feedback_text"])
    for name, ask_why in (
        ("rationalization", "Explain why the answer to this is $compact_answer:\n$question"), ("rationalization_v2", "$question\n\nA correct response is:\n$full_reference\n\nExplain the reasoning that leads to it."),
    ):
        register_strategy(name, ["$question\n\nA rationale:\n$feedback_text"], [ask_why], ["feedback_text"])
    for name, shown, ask_for in (
        ("tooluse_failure_mode", ["$question\n\nWhat went wrong with the calls of an earlier attempt:\n$feedback_text"], ["Which calls or inputs of this attempt are wrong or missing?\n$student_response"]),
        ("self_feedback", ["$question\n\nFeedback on an earlier attempt:\n$feedback_text", "Mind this feedback on an earlier attempt:\n$feedback_text\n\n$question"], ["Give feedback on this attempt:\n$student_response", "$question\n\nWhat is right and what is wrong in this attempt?\n$student_response"]),
        ("self_feedback_structured", ["$question\n\nFeedback on an earlier attempt, by what was right, what was wrong, and what to do:\n$feedback_text"], ["List what is right, what is wrong, and what to do next time, for this attempt:\n$student_response"]),
        ("self_feedback_concrete", ["$question\n\nThe first mistake of an earlier attempt:\n$feedback_text"], ["Quote the first wrong step of this attempt and say what it should be:\n$student_response"]),
    ):
        register_strategy(name, shown, ask_for, ["feedback_text"])
    register_strategy("sibling_response_as_example", [example.format("response", "$sibling_text")], needs=["sibling_text"])
    register_strategy("sdpo_sibling_feedback", [example.format("response", "$sibling_text") + "\n\nFeedback:\n$feedback_text"], needs=["sibling_text"])


_defaults()

_CHOICE = re.compile(r"^\s*([a-z_0-9]+)\s*(?:\(\s*(\d+|\*)\s*(?:,\s*(\d+|\*)\s*)?\))?\s*$")


def parse_choices(spec: str) -> list[tuple[str, str | None, str | None]]:
    """(strategy, prompt variation, first-stage variation) of name, name(k), name(k,m), with * for any, in a|b pools."""
    out = []
    for part in spec.split("|"):
        m = _CHOICE.match(part)
        if not m:
            raise ValueError(f"{part!r} isn't strategy, strategy(k) or strategy(k,m)")
        if m[1] not in STRATEGIES:
            raise ValueError(f"unknown strategy {m[1]!r}")
        out.append((m[1], m[2], m[3]))
    return out


def _variation(choice: str | None, n: int, unit: Column) -> Column:
    """Variations count from 1; null where a strategy has none."""
    if choice == "*":
        return (unit * n).cast("int") + 1 if n else F.lit(None).cast("int")
    if not n and choice is None:
        return F.lit(None).cast("int")
    k = int(choice or 1)
    if not 1 <= k <= n:
        raise ValueError(f"there is no variation {k} of {n}")
    return F.lit(k)


def contextualised(rows: DataFrame, spec: str, ident: str, seed: int) -> DataFrame:
    """rows with strategy, variation, stage1_variation and teacher_text, all by hashes of seed and id.

    Columns of VARIABLES that rows lack count as empty. A row that lacks what its strategy needs gets a null text.
    """
    choices = parse_choices(spec)
    columns = {v: (F.col(v) if v in rows.columns else F.lit("")) for v in VARIABLES}
    unit = lambda what: hash_unit(F.lit(f"{seed}/{what}"), F.col(ident))
    pick = (unit("strategy") * len(choices)).cast("int")
    strategy, variation, first, text = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, k, m) in enumerate(choices):
        s, own = STRATEGIES[name], pick == i
        v, w = _variation(k, len(s.templates), unit("prompt")), _variation(m, len(s.stage1), unit("stage1"))
        shown = F.coalesce(*(F.when(v == j, render(t, columns)) for j, t in enumerate(s.templates, 1)))
        for need in s.needs:
            shown = F.when(F.coalesce(columns[need], F.lit("")) != "", shown)
        strategy, variation, first, text = F.when(own, F.lit(name)).otherwise(strategy), F.when(own, v).otherwise(variation), F.when(own, w).otherwise(first), F.when(own, shown).otherwise(text)
    return rows.withColumns({"strategy": strategy, "variation": variation, "stage1_variation": first, "teacher_text": text})


def resampled_variation(ident: Column, epoch: Column, n: int, seed: int) -> Column:
    """The variation of an epoch: a cycle through all n that begins at a hashed place."""
    start = (hash_unit(F.lit(str(seed)), ident) * n).cast("int")
    return F.pmod(start + epoch, F.lit(n)).cast("int")


def merged_messages(base: Column, text: Column) -> Column:
    """The shell's messages with the last user message replaced by the text; appended where the shell has none.

    Without a shell the text alone is the user's message.
    """
    user = lambda t: F.struct(F.lit("user").alias("role"), t.alias("content"))
    back = F.array_position(F.reverse(F.transform(base, lambda m: m["role"])), "user")
    last = F.size(base) - back
    replaced = F.transform(base, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, text).otherwise(m["content"]).alias("content")))
    shell = F.when(back > 0, replaced).otherwise(F.concat(F.transform(base, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.array(user(text))))
    return F.when(base.isNull() | (F.size(base) == 0), F.array(user(text))).otherwise(shell)


def strategy_text(messages: Column) -> Column:
    """What a strategy's messages ask: the last user message's text, else all texts with blank lines between, trimmed."""
    asked = F.filter(messages, lambda m: m["role"] == "user")
    every = F.trim(F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n"), F.lit(" \n\t\r"))
    return F.when(F.size(asked) > 0, F.coalesce(F.element_at(asked, -1)["content"], F.lit(""))).otherwise(every)


def in_shell(base: Column, messages: Column) -> Column:
    """A strategy's messages in the shell of a dataset's: merged_messages() with their text; without a shell they stay as they are."""
    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when(base.isNull() | (F.size(base) == 0), plain).otherwise(merged_messages(base, strategy_text(messages)))


def conversations_as_messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, messages) in the order of turns."""
    grouped = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return grouped.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def chosen_sibling(candidates: DataFrame, key: str, order: str, correct: Column, usable: Column, text: str, fallback: DataFrame, gold: str) -> DataFrame:
    """(key, sibling_text, from_gold): the first correct and usable candidate in order, else the gold text."""
    w = Window.partitionBy(key).orderBy(order)
    first = candidates.filter(correct & usable).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, F.col(text).alias("_t"))
    joined = fallback.join(first, key, "left")
    return joined.select(key, F.coalesce("_t", gold).alias("sibling_text"), F.col("_t").isNull().alias("from_gold"))


#: Scorers by name, for callers that choose one at run time.
SCORERS: dict[str, Callable[..., Column]] = {}


def register_scorer(name: str, function: Callable[..., Column]) -> None:
    SCORERS[name] = function


def validated_judgment(j: Column, source: Column, labels: Mapping[str, str]) -> Column:
    """A judgment made consistent: labels (label to recommendation) fix the recommendation; at most 5 distinct failure
    modes and 3 evidence items whose quote is in the source; an inconsistent one without evidence becomes suspect with
    a confidence of 60 at most; null for an unknown label."""
    evidence = F.slice(F.filter(j["evidence"], lambda e: source.contains(e)), 1, 3)
    bare = (j["label"] == "inconsistent") & (F.size(evidence) == 0)
    label = F.when(bare, "suspect").otherwise(j["label"])
    recommend = F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in labels.items()))
    return F.when(
        j["label"].isin(*labels),
        F.struct(label.alias("label"), F.when(bare, F.least(j["confidence"], F.lit(60))).otherwise(j["confidence"]).alias("confidence"), recommend.alias("recommendation"), F.slice(F.array_distinct(j["failure_modes"]), 1, 5).alias("failure_modes"), evidence.alias("evidence")),
    )
