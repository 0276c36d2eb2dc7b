"""Dataset audits: profiles, issue lists, split statistics, attempts, lineage, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_profile(rows: DataFrame, keep: Sequence[str], required: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """rows with the columns to keep, and why each other one goes; a required column that isn't there is an error."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    kept = [c for c in keep if c in rows.columns]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    reasons = {c: "nested" if isinstance(kinds[c], (T.ArrayType, T.StructType, T.MapType)) else "not listed" for c in rows.columns if c not in kept}
    return rows.select(*kept), reasons


def other_world(rows: DataFrame, prefix: str = "original_") -> DataFrame:
    """rows whose fields have the values of their prefixed counterparts, where there are any."""
    return rows.withColumns({c.removeprefix(prefix): F.col(c) for c in rows.columns if c.startswith(prefix) and c.removeprefix(prefix) in rows.columns})


def flattened_config(rows: DataFrame, config: str, prefix: str = "cfg_") -> DataFrame:
    """A column for each field of a struct: scalars as they are, lists joined by ->; deeper fields are left out."""
    out = {}
    for f in rows.schema[config].dataType.fields:
        if isinstance(f.dataType, T.ArrayType):
            out[prefix + f.name] = F.array_join(F.transform(F.col(config)[f.name], lambda x: x.cast("string")), "->")
        elif not isinstance(f.dataType, (T.StructType, T.MapType)):
            out[prefix + f.name] = F.col(config)[f.name]
    return rows.withColumns(out)


def metric_columns(rows: DataFrame, cell: Sequence[str], prefixes: Sequence[str] = ()) -> list[str]:
    """Numeric columns that vary within any cell, and those with a known prefix: one aggregate of two rows of flags."""
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in cell]
    if not numeric:
        return []
    spread = rows.groupBy(*cell).agg(*((F.max(c) > F.min(c)).alias(c) for c in numeric))
    varies = spread.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in numeric)).first()
    return [c for c in numeric if varies[c] or any(c.startswith(p) for p in prefixes)]


def issues(rules: Mapping[str, Column]) -> Column:
    """The names of all rules that a record breaks; a rule that gives null is broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def audit_summary(rows: DataFrame, found: Column, warn_only: Sequence[str] = ()) -> DataFrame:
    """issue, n, example (the least id as _id), severity, of the issues found."""
    long = rows.select(F.col("_id"), F.explode(found).alias("issue"))
    out = long.groupBy("issue").agg(F.count("*").alias("n"), F.min("_id").alias("example"))
    return out.withColumn("severity", F.when(F.col("issue").isin(*warn_only), "warning").otherwise("error") if warn_only else F.lit("error"))


def custom_id(split: Column, index: Column, *hashes: Column) -> Column:
    """split prefix, padded index and two parts of hashes."""
    return F.concat_ws("-", F.substring(split, 1, 2), F.format_string("%06d", index.cast("long")), *(F.substring(h, 1, 8) for h in hashes))


def attempt_totals(rows: DataFrame, keys: Sequence[str], status: str, tokens: Sequence[str]) -> DataFrame:
    """requests, ok, errors and the sum of each token count over all attempts."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(F.col(status) == "ok").alias("ok"), F.count_if(F.coalesce(F.col(status) != "ok", F.lit(True))).alias("errors"), *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tokens)
    )


def eligibility(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(triple, n): how often each combination of statuses stands, with / between."""
    return rows.groupBy(F.concat_ws("/", *(F.coalesce(F.col(p).cast("string"), F.lit("none")) for p in parts)).alias("triple")).agg(F.count("*").alias("n"))


def split_statistics(rows: DataFrame, split: str, category: str, value: str) -> DataFrame:
    """split, category, n, share of the split, mean of a value."""
    counts = rows.groupBy(split, category).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def lineage(old: DataFrame, new: DataFrame, key: str, split: str, index: str) -> DataFrame:
    """key, where a row was and where it is now; null where it wasn't or isn't."""
    side = lambda rows, name: rows.select(key, F.col(split).alias(f"{name}_{split}"), F.col(index).alias(f"{name}_{index}"))
    return side(old, "old").join(side(new, "new"), key, "full")


def disagreeing_duplicates(rows: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """keys, n, versions of the rows that stand more than once with different contents."""
    cols = [c for c in rows.columns if c not in keys and c not in ignore]
    digest = F.sha2(F.to_json(F.struct(*cols)), 256)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("versions")).filter("versions > 1")


def repeated_identities(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n) of the identities that stand more than once."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    long = rows.select(F.explode(cells).alias("x")).select("x.*").filter("value is not null")
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).filter("n > 1")


def calibrated(rows: DataFrame, keys: Sequence[str], value: str, total: str, seed: str) -> DataFrame:
    """The mean over seeds with n and deviation; stable: whether the total was the same for all of them."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count_distinct(seed).alias("n_seeds"), (F.count_distinct(total) == 1).alias("stable"))


def gains(rows: DataFrame, keys: Sequence[str], name: str, value: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """keys and, for each named pair of experiments, the first one's value less the second's."""
    at = lambda x: F.avg(F.when(F.col(name) == x, F.col(value)))
    return rows.groupBy(*keys).agg(*((at(a) - at(b)).alias(label) for label, (a, b) in pairs.items()))


def wins(rows: DataFrame, difference: str, low: str, high: str) -> DataFrame:
    """rows with forward_wins, and certain: whether the interval leaves 0 out."""
    return rows.withColumn("forward_wins", F.col(difference) > 0).withColumn("certain", (F.col(low) > 0) | (F.col(high) < 0))


def path_success(tree: DataFrame, depth: int) -> DataFrame:
    """(supported, greedy): probability mass that stays on supported children down a tree(state, depth, child, p, supported),
    and the product along the likeliest child."""
    def down(edges):
        mass = tree.sparkSession.createDataFrame([(0, 1.0)], "state long, mass double")
        for d in range(depth):
            level = edges.filter(F.col("depth") == d)
            mass = mass.join(level, "state").groupBy(F.col("child").alias("state")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
        return mass.agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("m"))

    first = F.row_number().over(Window.partitionBy("state").orderBy(F.col("p").desc(), "child"))
    supported = down(tree.filter("supported")).withColumnRenamed("m", "supported")
    return supported.crossJoin(down(tree.withColumn("_r", first).filter("_r = 1 and supported")).withColumnRenamed("m", "greedy"))  # one row each


def rollout_weights(student: Column, teacher: Column, share: float, horizon: int) -> Column:
    """The occupancy weight of a rollout mixture, over the horizon."""
    return ((1 - share) * student + share * teacher) / horizon


def recovered_cells(runs: DataFrame, history: DataFrame | None, cells: DataFrame, cell: str, seed: str, seeds: Sequence[int], source: str) -> DataFrame:
    """(cell, place) of the cells that several sources give in full: whole, and without a contradiction.

    cells(cell, place, needs_history) are those that count. A cell is whole if its runs have just the expected seeds, others aside.
    Rows of one cell and seed may stand in several sources if they are the same in all columns but `source`; one pair that
    differs leaves the whole cell out. Cells that need a history must have rows of it for every expected seed.
    """
    wanted = [int(s) for s in seeds]
    number = F.col(seed).try_cast("double")
    content = F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\\N")).alias(c) for c in sorted(runs.columns) if c not in (source, seed)))), 256)
    own = runs.filter(number.isin(wanted)).select(cell, number.cast("long").alias("_seed"), content.alias("_content"))
    rows = own.groupBy(cell, "_seed").agg((F.min("_content") != F.max("_content")).alias("_differs"))
    whole = rows.groupBy(cell).agg(F.count("*").alias("_n"), F.max("_differs").alias("_unsafe")).filter((F.col("_n") == len(set(wanted))) & ~F.col("_unsafe")).select(cell)
    known = cells.join(whole, cell, "left_semi")
    if history is None:
        return known.filter(~F.coalesce("needs_history", F.lit(False))).select(cell, "place")
    told = history.filter(number.isin(wanted)).select(cell, number.alias("_seed")).distinct().groupBy(cell).agg(F.count("*").alias("_told"))
    known = known.join(told, cell, "left")
    return known.filter(~F.coalesce("needs_history", F.lit(False)) | (F.col("_told") == len(set(wanted)))).select(cell, "place")


def recovered_rows(rows: DataFrame, complete: DataFrame, keys: Sequence[str], cell: str, seed: str, seeds: Sequence[int], source: str) -> DataFrame:
    """The rows of complete cells with the expected seeds, one a key: that of the first source. With the cell's place, without the source."""
    number = F.col(seed).try_cast("double")
    own = rows.filter(number.isin([int(s) for s in seeds])).join(complete, cell)
    rest = [c for c in own.columns if c not in keys and c != source]
    first = F.min_by(F.struct(*rest), F.col(source)).alias("_row")
    return own.groupBy(*keys).agg(first).select(*keys, "_row.*")
