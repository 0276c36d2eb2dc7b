"""Joins of runs, cells and records: matched pairs, contrasts, lookups with priorities, leakage, containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the smaller side up to which a containment join broadcasts it; it must be a checked, small set.
BROADCAST_ROWS = 100_000
#: Letters at most by which passages without an inner word are looked up.
GRAM = 6


def on_null_safe(keys: Sequence[str], left: str = "a", right: str = "b") -> Column:
    """Equality on all keys, nulls equal to nulls."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def matched_pairs(rows: DataFrame, axis: Column, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, and of each metric the mean where axis is true (_a) and where it is false (_b), for keys with both.

    One aggregation in place of two and a join; null keys form groups of their own.
    """
    side = rows.withColumn("_a", axis)
    aggs = [F.avg(F.when(F.col("_a") == is_a, F.col(m))).alias(f"{m}_{s}") for m in metrics for s, is_a in (("a", True), ("b", False))]
    counts = [F.count_if(F.col("_a")).alias("_na"), F.count_if(~F.col("_a")).alias("_nb")]
    return side.groupBy(*keys).agg(*aggs, *counts).filter("_na > 0 and _nb > 0").drop("_na", "_nb")


def against_level(rows: DataFrame, level: str, reference, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, level, and each metric's mean at the level (_a) and at the reference level (_b), by one self-join of means."""
    cells = rows.groupBy(*keys, level).agg(*(F.avg(m).alias(m) for m in metrics))
    base = cells.filter(F.col(level) == reference).select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(m).alias(f"{m}_b") for m in metrics))
    other = cells.filter(F.col(level) != reference)
    joined = other.join(base, [other[k].eqNullSafe(base[f"_{k}"]) for k in keys])
    return joined.select(*keys, level, *(F.col(m).alias(f"{m}_a") for m in metrics), *(f"{m}_b" for m in metrics))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join; a key that stands twice on a side stops the job."""
    def checked(side, name):
        counts = side.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*(c for c in side.columns if c not in keys))).alias("_row"))
        ok = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"a key stands twice on the {name}")))
        return counts.select(*keys, ok.alias("_row")).select(*keys, "_row.*")

    return checked(left, "left").join(checked(right, "right"), list(keys))


def contrast(rows: DataFrame, method: str, a: str, b: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys and, of each metric, a's value less b's, for keys with both."""
    pairs = matched_pairs(rows.filter(F.col(method).isin(a, b)), F.col(method) == a, keys, metrics)
    return pairs.select(*keys, *((F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"d_{m}") for m in metrics))


def routes(rows: DataFrame, route: str, names: Sequence[str], keys: Sequence[str], metric: str) -> DataFrame:
    """Long rows (keys, route, value) of the keys that all routes have."""
    wide = rows.filter(F.col(route).isin(*names)).groupBy(*keys).agg(*(F.avg(F.when(F.col(route) == n, F.col(metric))).alias(f"r{i}") for i, n in enumerate(names)))
    whole = wide.dropna(subset=[f"r{i}" for i in range(len(names))])
    stacked = F.array(*(F.struct(F.lit(n).alias("route"), F.col(f"r{i}").alias("value")) for i, n in enumerate(names)))
    return whole.select(*keys, F.explode(stacked).alias("x")).select(*keys, "x.*")


def lever_comparison(chosen: DataFrame, frozen: DataFrame, keys: Sequence[str], direction: str, alpha: str, gain: str, forgetting: str) -> DataFrame:
    """What two levers bring in turn, for the keys that all three have: from reverse and frozen to reverse at its chosen alpha, and on to forward at its own.

    chosen(keys, direction, alpha, gain, forgetting): reverse and forward at the alphas chosen for each. frozen(keys, gain, forgetting): reverse at alpha 0.
    """
    r, f = (chosen.filter(F.col(direction) == name).select(*keys, *(F.col(c).alias(f"_{name}_{c}") for c in (alpha, gain, forgetting))) for name in ("reverse", "forward"))
    z = frozen.select(*keys, *(F.col(c).alias(f"_frozen_{c}") for c in (gain, forgetting)))
    less = lambda a, b, c: F.col(f"_{a}_{c}") - F.col(f"_{b}_{c}")
    return r.join(f, list(keys)).join(z, list(keys)).select(
        *keys, less("reverse", "frozen", gain).alias("acquisition_gain"), less("reverse", "frozen", forgetting).alias("forgetting_cost"),
        less("forward", "reverse", gain).alias("forward_acquisition_gain"), less("forward", "reverse", forgetting).alias("forward_forgetting_cost"),
        F.col(f"_reverse_{alpha}").alias("reverse_alpha"), F.col(f"_forward_{alpha}").alias("forward_alpha"),
    )


def prioritised_lookup(rows: DataFrame, sources: Sequence[tuple[DataFrame, str]], value: str) -> DataFrame:
    """rows with value from the first source that knows the row: (table, key column), keys that stand twice don't count."""
    out, found = rows, []
    for i, (table, key) in enumerate(sources):
        single = table.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(f"_v{i}")).filter("_n = 1").drop("_n")
        out = out.join(single, key, "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_v{i}" for i in range(len(sources))))


def leakage(splits: DataFrame, split: str, fields: Sequence[str], examples: int = 10) -> DataFrame:
    """(field, split_a, split_b, n, examples): values of a field that stand in two splits, with the first examples."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    values = splits.select(F.col(split).alias("split"), F.explode(cells).alias("x")).select("split", "x.*").filter("value is not null").distinct()
    pairs = values.alias("a").join(values.alias("b"), (F.col("a.field") == F.col("b.field")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.split") < F.col("b.split")))
    found = pairs.select("a.field", F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"), "a.value")
    return top_examples(found, ["field", "split_a", "split_b"], "value", examples)


def top_examples(rows: DataFrame, keys: Sequence[str], value: str, examples: int) -> DataFrame:
    """keys, n and the first few values in order, without gathering all of a group's values."""
    from pyspark.sql import Window

    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(64)))  # so that a hot group isn't ranked in one task
    near = salted.withColumn("_near", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(value))).filter(F.col("_near") <= examples)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_rank") <= examples)
    return counts.join(ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("examples")), list(keys))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of the keys that one side lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, name: x.join(y, key, "left_anti").select(F.lit(name).alias("side"), key)
    return only(a, b, "left").unionAll(only(b, a, "right"))


def override(rows: DataFrame, second: DataFrame, key: str, columns: Sequence[str], ok: str) -> DataFrame:
    """rows whose columns are the second result's where that one is ok."""
    other = second.filter(F.col(ok)).select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_ok"))
    joined = rows.join(other, key, "left")
    return joined.withColumns({c: F.when(F.col("_ok"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_ok", *(f"_{c}" for c in columns))


def compatible_results(rows: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with their results where id, configuration and input agree; results for other inputs don't count."""
    return rows.join(results, list(keys))


def contained_passages(texts: DataFrame, text: str, passages: DataFrame, passage: str) -> DataFrame:
    """Pairs where a text contains a passage, by an equi-join on words in place of a nested loop.

    A word with blanks on both sides in a passage has them in the text, too: the longest such word is the passage's key.
    A text meets the passages keyed by any of its words, through a broadcast list while there are up to BROADCAST_ROWS
    passages and a shuffled join beyond. Passages without an inner word are keyed by their first letters, GRAM at most, and
    a text meets them by its own stretches of as many letters.
    """
    words = F.split(passage, " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    keyed = passages.filter(F.col(passage) != "").withColumn("_key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    few = passages.count() <= BROADCAST_ROWS
    named = F.md5(text)

    def met(keys: Column, own: DataFrame) -> DataFrame:
        """Pairs (_text, _key) of texts, by name, and keys of passages that they hold; only names and keys move."""
        known = own.select("_key").distinct()
        return texts.select(named.alias("_text"), F.explode(F.array_distinct(keys)).alias("_key")).join(F.broadcast(known) if few else known, "_key").distinct()

    own = keyed.filter("_key is not null")
    pairs = [(met(F.split(text, " "), own), own)]
    short = keyed.filter("_key is null").withColumn("_key", F.substring(passage, 1, GRAM))
    for n in [r[0] for r in short.select(F.length("_key")).distinct().collect()]:  # GRAM at most
        own = short.filter(F.length("_key") == n)
        pairs.append((met(grams_of(F.col(text), n), own), own))
    hits = None
    for found, own in pairs:
        near = texts.withColumn("_text", named).join(found, "_text").join(F.broadcast(own) if few else own, "_key")
        near = near.filter(F.col(text).contains(F.col(passage))).drop("_key", "_text")
        hits = near if hits is None else hits.unionByName(near)
    return hits


def grams_of(c: Column, n: int) -> Column:
    """All stretches of n letters of a text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
