"""Column functions on text: normalising, tags, boxes, templates, names."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse_space(c: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, three and more line ends to two; trimmed."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    return F.trim(F.regexp_replace(c, "\\n{3,}", "\n\n"), F.lit(" \n\t"))


def stripped(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slug(c: Column) -> Column:
    """Lower case, other than letters and digits to one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def visible(c: Column) -> Column:
    """The text without think blocks; null if a block is opened and none is closed."""
    opened, closed = c.rlike("(?i)<think\\b[^>]*>"), c.rlike("(?i)</think\\s*>")
    rest = F.trim(F.regexp_replace(c, "(?is)<think\\b[^>]*>.*?</think\\s*>", ""), F.lit(" \n\t\r"))
    return F.when(opened & ~closed, F.lit(None)).otherwise(rest)


@F.pandas_udf(T.StructType([T.StructField("values", T.ArrayType(T.StringType())), T.StructField("malformed", T.BooleanType())]))
def boxes(texts: pd.Series) -> pd.DataFrame:
    """struct(values, malformed): what each balanced \\boxed{...} holds, trimmed, in the order of their starts, and whether a box isn't closed.

    Blanks may stand before the brace, and boxes within boxes. A stack pairs the braces in one pass over a text. Null gives null.
    """
    import re

    mark = re.compile(r"\\boxed\s*(\{)|[{}]")

    def one(t):
        if t is None:
            return None, None
        opened, found = [], []
        for m in mark.finditer(t):
            if m[0] == "}":
                if opened and (k := opened.pop())[1] is not None:
                    found[k[1]] = t[k[0] : m.start()].strip()
            else:
                opened.append((m.end(), len(found) if m[1] else None))
                if m[1]:
                    found.append(None)
        values = [x for x in found if x is not None]
        return values, len(values) < len(found)

    return pd.DataFrame([one(t) for t in texts], columns=["values", "malformed"])


def last_box(c: Column) -> Column:
    """What the last \\boxed{...} with balanced braces holds, trimmed, or null."""
    return F.try_element_at(boxes(c)["values"], F.lit(-1))


def tag_scan(c: Column, names: list[str]) -> Column:
    """struct(count, balanced): complete elements of the tags in a flat text, and whether every tag that opens closes before another opens."""
    tags = F.regexp_extract_all(c, F.lit(f"<(/?(?:{'|'.join(names)}))>"), F.lit(1))
    pairs = F.aggregate(tags, F.struct(F.lit("").alias("open"), F.lit(0).alias("n"), F.lit(True).alias("ok")), lambda s, t: F.struct(
        F.when(s["open"] == "", F.when(t.startswith("/"), F.lit("")).otherwise(t)).otherwise(F.lit("")).alias("open"),
        (s["n"] + ((s["open"] != "") & (t == F.concat(F.lit("/"), s["open"]))).cast("int")).alias("n"),
        (s["ok"] & F.when(s["open"] == "", ~t.startswith("/")).otherwise(t == F.concat(F.lit("/"), s["open"]))).alias("ok"),
    ))
    return F.struct(pairs["n"].alias("count"), (pairs["ok"] & (pairs["open"] == "")).alias("balanced"))


def answer_tag(c: Column) -> Column:
    """The text between the last <answer> and the next </answer>, trimmed; the whole text without a tag."""
    after = F.element_at(F.split(c, "<answer>"), -1)
    return F.trim(F.element_at(F.split(after, "</answer>"), 1), F.lit(" \n\t\r"))


def tagged(c: Column, tag: str) -> Column:
    """The last complete element of a tag; without one, what follows an unclosed tag; else null."""
    whole = F.regexp_extract_all(c, F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    partial = F.regexp_extract_all(c, F.lit(f"(?is)<{tag}>((?:(?!<{tag}>).)*)$"), F.lit(1))
    return F.trim(F.coalesce(F.try_element_at(whole, F.lit(-1)), F.try_element_at(partial, F.lit(-1))), F.lit(" \n\t\r"))


def tags_balanced(c: Column, allowed: list[str]) -> Column:
    """Whether the tags opened and closed are the same and all of them allowed."""
    opened = F.array_distinct(F.regexp_extract_all(c, F.lit("<([a-z_]+)>"), F.lit(1)))
    closed = F.array_distinct(F.regexp_extract_all(c, F.lit("</([a-z_]+)>"), F.lit(1)))
    same = (F.size(F.array_except(opened, closed)) == 0) & (F.size(F.array_except(closed, opened)) == 0)
    return same & (F.size(F.array_except(opened, F.array(*map(F.lit, allowed)))) == 0)


def action_lines(c: Column) -> Column:
    """The names after `Action:`, each to the end of its line, trimmed."""
    return F.transform(F.regexp_extract_all(c, F.lit("Action:\\s*([^\\r\\n]+)"), F.lit(1)), lambda x: F.trim(x))


def flags(c: Column, patterns: Mapping[str, str]) -> Column:
    """The names of the patterns found, in their order."""
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())


def first_match(c: Column, patterns: Mapping[str, str]) -> Column:
    """The name of the first pattern found, or null."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items()), F.lit(None).cast("string"))


def count_tokens(c: Column) -> Column:
    """Runs of other than white space; 0 for null and blank texts."""
    return F.coalesce(F.size(F.filter(F.split(c, "\\s+"), lambda x: x != "")), F.lit(0))


def render(template: str, variables: Mapping[str, Column]) -> Column:
    """The template with $name replaced, longest names first, then trimmed; an unknown $name is an error at once."""
    import re

    missing = sorted(set(re.findall(r"\$([a-z_]+)", template)) - set(variables))
    if missing:
        raise KeyError(f"no variable for {missing}")
    parts = re.split(r"\$([a-z_]+)", template)
    return F.trim(F.concat(*(F.coalesce(variables[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts))), F.lit(" \n\t"))


def version_parts(c: Column) -> Column:
    """prefix, seed, suffix, epochs of a version name such as v3_seed31_ema_ep4."""
    seed = F.regexp_extract(c, "seed_?(\\d+)", 1)
    epochs = F.regexp_extract(c, "_ep(\\d+)$", 1)
    return F.struct(
        F.regexp_extract(c, "^(.*?)_?seed_?\\d+", 1).alias("prefix"),
        F.when(seed != "", seed.cast("long")).alias("seed"),
        F.regexp_replace(F.regexp_extract(c, "seed_?\\d+_?(.*)$", 1), "_?ep\\d+$", "").alias("suffix"),
        F.when(epochs != "", epochs.cast("long")).alias("epochs"),
    )


def tail_path(c: Column, parts: int = 2) -> Column:
    """The last parts of a path, with / between; repeated and outer slashes don't count."""
    found = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.array_join(F.slice(found, F.greatest(F.size(found) - parts + 1, F.lit(1)), parts), "/")


#: A run of a shell word's characters: escaped, in double quotes, in single quotes, or plain.
PIECE = r"""(?:\\[\s\S]|"(?:[^"\\]++|\\[\s\S])*+"|'[^']*+'|[^ \t\r\n"'\\]++)"""


def shell_words(c: Column) -> Column:
    """The words of a command as a POSIX shell splits it; where a quote or an escape isn't closed, its parts between blanks.

    Line ends, escaped ones too, separate words. Quotes may stand within a word; in double quotes a backslash escapes only itself and the quote.
    """
    line = F.replace(F.replace(c, F.lit("\\\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    plain = lambda p: (
        F.when(p.startswith('"'), F.regexp_replace(F.substr(p, F.lit(2), F.length(p) - 2), r'\\(["\\])', "$1"))
        .when(p.startswith("'"), F.substr(p, F.lit(2), F.length(p) - 2)).when(p.startswith("\\"), F.substr(p, F.lit(2))).otherwise(p)
    )
    words = F.transform(F.regexp_extract_all(line, F.lit(f"{PIECE}++"), F.lit(0)), lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(PIECE), F.lit(0)), plain), ""))
    closed = line.rlike(f"^(?:{PIECE}|[ \t\r\n]++)*+$")
    return F.when(closed, words).when(~closed, F.filter(F.split(line, "(?U)\\s+"), lambda x: x != ""))


def option_value(c: Column, name: str) -> Column:
    """The value of --name in a command, the next word or what follows =; the first one counts."""
    flag = f"--{name}"
    # The words are bound once, so that they aren't split anew for each of them.
    found = F.transform(F.array(shell_words(c)), lambda words: F.filter(F.transform(words, lambda w, i: F.when(w == flag, F.get(words, i + 1)).when(w.startswith(flag + "="), F.substr(w, F.lit(len(flag) + 2)))), lambda x: x.isNotNull()))
    return F.get(F.get(found, F.lit(0)), F.lit(0))


def plain_path(c: Column) -> Column:
    """A path without empty, . and .. parts; .. at the top of an absolute path is dropped."""
    absolute = c.startswith("/")
    step = lambda done, p: (
        F.when((p == "") | (p == "."), done).when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .when((p == "..") & absolute, done).otherwise(F.concat(done, F.array(p)))
    )
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/"))


def model_alias(c: Column, aliases: Mapping[str, str]) -> Column:
    """A known short name, else the last part of the path in lower case."""
    known = F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in aliases.items()), F.lit(None).cast("string"))
    return F.coalesce(known, F.lower(F.element_at(F.split(F.trim(c, F.lit("/")), "/"), -1)))


@F.pandas_udf(T.StringType())
def plain_typography(texts: pd.Series) -> pd.Series:
    """NFKC, control characters removed, typographic quotes and dashes as in ASCII: Spark has no NFKC."""
    import unicodedata

    # Typographic characters and their ASCII forms.
    plain = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " "})

    def one(t):
        t = unicodedata.normalize("NFKC", t.translate(plain))
        return "".join(c for c in t if c in "\n\t" or unicodedata.category(c)[0] != "C")

    return texts.map(one, na_action="ignore")
