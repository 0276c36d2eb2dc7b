"""Run metrics: resolved settings, series with fallbacks, per-run rows, external results, folded graphs and trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.functions.numbers import variant_number
from sparkloom.functions.text import option_value, plain_path

from . import ordered
from .places import written


def resolved(sources: Sequence[Column]) -> Column:
    """struct(value, conflict): the first source that isn't null, and whether the sources disagree."""
    known = F.array_distinct(F.filter(F.array(*(s.cast("string") for s in sources)), lambda x: x.isNotNull()))
    return F.struct(F.coalesce(*sources).alias("value"), (F.size(known) > 1).alias("conflict"))


def rate_conflict(recorded: Column, named: Column, tolerance: float = 1e-12) -> Column:
    """struct(value, conflict) of a rate recorded and one in a name: the recorded one wins."""
    differ = F.abs(recorded - named) > tolerance * F.greatest(F.abs(recorded), F.abs(named))
    return F.struct(F.coalesce(recorded, named).alias("value"), F.coalesce(differ, F.lit(False)).alias("conflict"))


def single_phase(rows: DataFrame, phases: Column, fallback: Column) -> DataFrame:
    """Runs with exactly one phase, which the configuration gives or else the fallback."""
    n = F.coalesce(F.size(phases), F.lit(-1))
    return rows.withColumn("phase", F.when(n == 1, F.element_at(phases, 1)).otherwise(F.when(n <= 0, fallback))).filter("phase is not null")


def longest_prefix(rows: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """method: the longest known prefix of a name, the name itself without one; rest: what follows it.

    Prefixes are joined by their equal first letters of each length that occurs, not by a nested loop.
    """
    sizes = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]  # as many as names have letters
    keys = F.array(*(F.substring(name, 1, n) for n in sorted(sizes, reverse=True))) if sizes else F.array().cast("array<string>")
    known = prefixes.select(F.col(prefix).alias("_p")).distinct()
    hits = rows.select(name).distinct().withColumn("_p", F.explode(F.array_distinct(keys))).join(known, "_p")
    found = hits.groupBy(name).agg(F.max(F.struct(F.length("_p"), "_p"))["_p"].alias("_p"))
    joined = rows.join(found, name, "left").withColumn("method", F.coalesce("_p", name))
    return joined.withColumn("rest", F.regexp_replace(F.expr(f"substring(`{name}`, length(method) + 1)"), "^_", "")).drop("_p")


def canonical(c: Column, renamed: Mapping[str, str], known: Sequence[str]) -> Column:
    """The current name of a legacy one, a known name as it is, else null."""
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in renamed.items()), F.when(c.isin(*known), c))


def method_factors(c: Column) -> Column:
    """struct(direction, role, reference, rate) told from a method's name."""
    rate = F.regexp_extract(c, "ema_?([0-9.]+)", 1)
    return F.struct(
        F.when(c.startswith("fwd"), "forward").when(c.startswith("rev"), "reverse").when(c.startswith("jsd"), "jsd").alias("direction"),
        F.when(c.contains("teacher"), "teacher").when(c.contains("student"), "student").alias("role"),
        F.when(c.contains("frozen"), "frozen").when(c.contains("ema"), "ema").when(c.contains("sync"), "sync").alias("reference"),
        F.when(c.contains("frozen"), 0.0).otherwise(rate.try_cast("double")).alias("rate"),
    )


def merged_metrics(nested: Column, top: Column) -> Column:
    """Two metric maps as one: nested values win; the teacher's less the student's entropy is added where both are there."""
    both = F.map_concat(F.map_filter(top, lambda k, _: ~F.map_contains_key(nested, k)), nested)
    gap = F.try_element_at(both, F.lit("teacher_entropy")) - F.try_element_at(both, F.lit("student_entropy"))
    return F.when(gap.isNotNull(), F.map_concat(F.map_filter(both, lambda k, _: k != "entropy_gap"), F.create_map(F.lit("entropy_gap"), gap))).otherwise(both)


def genuine_steps(rows: DataFrame, step: str, metrics: str, markers: Sequence[str]) -> DataFrame:
    """Records with a positive step and any of the marker metrics."""
    return rows.filter((F.col(step) > 0) & F.arrays_overlap(F.map_keys(metrics), F.array(*map(F.lit, markers))))


def fallback_points(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All points of the first source that has any for a key; the sources share their columns."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    return rows.withColumn("_best", F.min("_rank").over(Window.partitionBy(*keys))).filter("_rank = _best").drop("_rank", "_best")


def accuracy_points(curve: DataFrame, combined: DataFrame, checkpoints: DataFrame, registry: DataFrame, run: str) -> DataFrame:
    """run, step, accuracy, is_baseline, persisted: each run's accuracy by step, from the first source that has any.

    curve, combined and checkpoints have (run, step, accuracy), registry (run, accuracy). The persisted curve counts, its step 0 being the baseline; a
    run whose curve has no step beyond 0 takes the combined series as well, whose values win. Runs without either take what their
    checkpoints' results say, and the registered accuracy as step 0 if they have none. Null accuracies and steps don't count.
    """
    known = lambda rows: rows.filter("step is not null and accuracy is not null").select(run, F.col("step").cast("long").alias("step"), "accuracy")
    c, m, f = known(curve), known(combined), known(checkpoints)
    beyond = c.filter("step > 0").select(run).distinct()
    m = m.join(beyond, run, "left_anti")
    kept = c.withColumn("_rank", F.lit(1)).unionAll(m.withColumn("_rank", F.lit(0)))
    kept = kept.groupBy(run, "step").agg(F.min_by("accuracy", "_rank").alias("accuracy")).withColumn("persisted", F.lit(True))
    whole = kept.select(run).distinct()
    base = registry.filter("accuracy is not null").select(run, F.lit(0).cast("long").alias("step"), "accuracy")
    other = f.withColumn("_rank", F.lit(0)).unionAll(base.withColumn("_rank", F.lit(1))).join(whole, run, "left_anti")
    other = other.groupBy(run, "step").agg(F.min_by("accuracy", "_rank").alias("accuracy")).withColumn("persisted", F.lit(False))
    return kept.unionAll(other).select(run, "step", "accuracy", (F.col("step") == 0).alias("is_baseline"), "persisted")


def rebuilt_results(rows: DataFrame, final: str, delta: str, stderr: str) -> DataFrame:
    """rows with baseline, the final value less the delta, and stderr_percent, 100 times the raw standard error."""
    return rows.withColumns({"baseline": rebuilt_baseline(F.col(final), F.col(delta)), "stderr_percent": F.col(stderr) * 100})


def merged_series(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All steps of both series; where both have a column, the right one's value wins unless it is null."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.select(*keys, *(F.col(c).alias(f"_a_{c}") if c in shared else F.col(c) for c in left.columns if c not in keys))
    b = right.select(*keys, *(F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in right.columns if c not in keys))
    joined = a.join(b, list(keys), "full")
    return joined.select(*keys, *(F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in shared), *(c for c in [*left.columns, *right.columns] if c not in shared and c not in keys))


def latest_summary(rows: DataFrame, keys: Sequence[str], step: str, time: str) -> DataFrame:
    return ordered.keep_first(rows, keys, F.col(step).desc(), F.col(time).desc())


def seed_rows(rows: DataFrame, run: str, step: str, dataset: str, accuracy: str, datasets: Sequence[str], last: int = 3) -> DataFrame:
    """One row a run: each dataset's final accuracy (mean of its last points), delta and relative delta from step 0."""
    w = Window.partitionBy(run, dataset).orderBy(F.col(step).desc())
    ranked = rows.filter(F.col(accuracy).isNotNull()).withColumn("_r", F.row_number().over(w))
    per = ranked.groupBy(run, dataset).agg(F.avg(F.when(F.col("_r") <= last, F.col(accuracy))).alias("final"), F.max(F.when(F.col(step) == 0, F.col(accuracy))).alias("base"))
    per = per.withColumn("delta", F.col("final") - F.col("base")).withColumn("relative", F.try_divide("delta", F.abs("base")))
    return per.groupBy(run).agg(*(F.max(F.when(F.col(dataset) == d, F.col(c))).alias(f"{d}_{c}") for d in datasets for c in ("final", "delta", "relative")))


def learning_curve(points: DataFrame, phases: DataFrame, run: str, phase: str, order: str, length: str, step: str) -> DataFrame:
    """points with global_step: the phase's offset plus the step."""
    at = ordered.offsets(phases, [run], [order], length).select(run, phase, "offset")
    return points.join(at, [run, phase]).withColumn("global_step", F.col("offset") + F.col(step))


def combined_curve(checkpoints: DataFrame, phases: DataFrame, baselines: DataFrame, run: str, phase: str, order: str, dataset: str) -> DataFrame:
    """run, dataset, global_step, phase, accuracy of a run's checkpoints over all its phases, with each dataset's baseline at 0.

    checkpoints(run, phase, step, dataset, accuracy), phases(run, phase, order), baselines(run, dataset, accuracy). A phase begins where the
    phases before it, of those with checkpoints, have their last step. A checkpoint without an accuracy stays, as null; a baseline
    without one doesn't; runs without checkpoints have no curve. phase is null for a baseline.
    """
    last = checkpoints.groupBy(run, phase).agg(F.max("step").alias("_steps")).join(phases, [run, phase])
    at = ordered.offsets(last, [run], [order], "_steps").select(run, phase, "offset")
    points = checkpoints.join(at, [run, phase]).select(run, dataset, (F.col("offset") + F.col("step")).cast("long").alias("global_step"), phase, "accuracy")
    start = baselines.filter("accuracy is not null").join(at.select(run).distinct(), run, "left_semi")
    return points.unionByName(start.select(run, dataset, F.lit(0).cast("long").alias("global_step"), F.lit(None).cast(checkpoints.schema[phase].dataType).alias(phase), "accuracy"))


def external_metric(metrics: Column, name: str) -> Column:
    """A metric by its exact name, then with ,none, then with ,create_test, then the first by prefix."""
    exact = [F.try_element_at(metrics, F.lit(n)) for n in (name, f"{name},none", f"{name},create_test")]
    prefixed = F.map_values(F.map_filter(metrics, lambda k, _: k.startswith(name + ",")))
    return F.coalesce(*exact, F.try_element_at(prefixed, F.lit(1)))


def external_summary(rows: DataFrame, model: str, task: str, value: str, baselines: DataFrame, baseline: str) -> DataFrame:
    """percent to 4 places, delta to the registered baseline (null where there is none) and the mean of the tasks there are."""
    joined = rows.join(baselines, [model, task], "left").withColumn("percent", F.round(100 * F.col(value), 4))
    joined = joined.withColumn("delta", F.round(F.col("percent") - F.col(baseline), 4))
    return joined.withColumn("average", F.avg("percent").over(Window.partitionBy(model)))


def flattened_results(rows: DataFrame, keys: Sequence[str], task: str, metrics: str, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """A column <task>_<metric> for each pair wanted, from a map column."""
    long = rows.select(*keys, task, F.explode(metrics).alias("metric", "value"))
    return long.groupBy(*keys).agg(*(F.max(F.when((F.col(task) == t) & (F.col("metric") == m), F.col("value"))).alias(f"{t}_{m}") for t, m in wanted))


def rebuilt_baseline(final: Column, delta: Column) -> Column:
    return final - delta


def remapped(c: Column, prefixes: Sequence[tuple[str, str]]) -> Column:
    """A path with the first matching prefix replaced."""
    return F.coalesce(*(F.when(c.startswith(old), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1), F.length(c)))) for old, new in prefixes), c)


def flat_json(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, path, value): the numeric leaves of JSON objects, however deep, with dotted paths.

    Numbers, and text that is one, count if they are finite; true and false, lists and what is in them don't. What is no object has
    no rows. A round opens the objects of one level and writes their numbers and inner objects; rounds go on until no object is left.
    """
    level = rows.select(*keys, F.lit(None).cast("string").alias("path"), F.col(text).alias("_json"))
    found = []
    while not found or not level.isEmpty():
        opened = level.withColumn("_v", F.try_parse_json("_json")).filter("try_variant_get(_v, '$', 'map<string,variant>') is not null").drop("_json")
        each = opened.lateralJoin(opened.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        number = variant_number(F.col("value"))
        inner = F.when(F.schema_of_variant("value").startswith("OBJECT"), F.to_json("value"))
        each = each.select(*keys, F.concat_ws(".", "path", "key").alias("path"), inner.alias("_json"), number.alias("value"))
        each = written(each.filter("_json is not null or value is not null"))
        found.append(each.filter("value is not null").select(*keys, "path", "value"))
        level = each.filter("_json is not null").drop("value")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def percent_value(percent: Column, value: Column) -> Column:
    """A result in percent: as it is recorded, else 100 times the raw value."""
    return F.coalesce(percent, value * 100.0)


def task_features(registered: Column, baseline: Column, final: Column, delta: Column, stderr: Column, stderr_percent: Column) -> Column:
    """struct(final, delta, stderr) of a task of an external evaluation, in percent but for the raw standard error.

    The baseline is the registered one, else the summary's; the final value is measured, else baseline plus the summary's delta;
    the delta is final less baseline, else the summary's; the standard error is the raw one, else a hundredth of the one in percent.
    """
    base = F.coalesce(registered, baseline)
    last = F.coalesce(final, base + delta)
    return F.struct(last.alias("final"), F.coalesce(last - base, delta).alias("delta"), F.coalesce(stderr, stderr_percent / 100.0).alias("stderr"))


def external_features(tasks: DataFrame, average: DataFrame, run: str) -> DataFrame:
    """(run, final, delta, components): what a run's external evaluation comes to over the tasks that its average is made of.

    tasks(run, final, delta, registered): each of these tasks' features and registered baseline. average(run, registered, baseline,
    final, delta): what was registered and summarised for the average itself; runs may lack it. The final value is the
    summary's, else the tasks' mean; the baseline the registered one, else the summary's, else the mean of the tasks' registered ones; the
    delta is final less baseline, else the summary's, else the mean of the tasks' deltas. components: tasks with a final value or a delta.
    """
    means = tasks.groupBy(run).agg(
        F.avg("final").alias("_final"), F.avg("delta").alias("_delta"), F.avg("registered").alias("_registered"), F.count_if(F.col("final").isNotNull() | F.col("delta").isNotNull()).alias("components"),
    )
    both = means.join(average.select(run, "registered", "baseline", "final", "delta"), run, "full")
    last, base = F.coalesce("final", "_final"), F.coalesce("registered", "baseline", "_registered")
    return both.select(run, last.alias("final"), F.coalesce(last - base, F.col("delta"), F.col("_delta")).alias("delta"), F.coalesce("components", F.lit(0)).cast("long").alias("components"))


def length_summary(summary: Column) -> Column:
    """struct(main_mean, main_median, main_unit, char_mean, whitespace_mean, token_mean, responses) of a JSON summary of response lengths.

    The main field is the one that the summary names for its main mean, else its length field; its median is read from
    there. The number of responses is that with text, or of records where there is none. What isn't a number is null.
    """
    # Parsed once, however many fields are read.
    return F.get(F.transform(F.array(F.try_parse_json(summary)), length_fields), F.lit(0))


def length_fields(v: Column) -> Column:
    """length_summary() of a VARIANT."""
    at = lambda path: variant_number(F.try_variant_get(v, path, "variant"))
    named = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    unit = F.coalesce(named("$.length_field_used_for_main_mean"), named("$.length_field"), F.lit(""))
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    median = variant_number(F.try_variant_get(F.try_element_at(fields, unit), "$.median", "variant"))
    responses = at("$.num_responses_with_text")
    return F.when(v.isNotNull(), F.struct(
        at("$.main_mean_length").alias("main_mean"), F.when(unit != "", median).alias("main_median"), unit.alias("main_unit"), at("$.char_length.mean").alias("char_mean"),
        at("$.whitespace_token_length.mean").alias("whitespace_mean"), at("$.hf_token_length.mean").alias("token_mean"), F.coalesce(F.when(responses != 0, responses), at("$.num_records")).alias("responses"),
    ))


def primary_files(files: DataFrame, keys: Sequence[str], path: str, marker: str = "original") -> DataFrame:
    """One file a key: one without the marker in its name if there is one, the first by name among equals."""
    return ordered.keep_first(files, keys, F.col(path).contains(marker), path)


def datasets_in_order(phases: DataFrame, found: DataFrame, run: str, order: str, dataset: str) -> DataFrame:
    """run, dataset, place: the datasets of the phases in their order, then those only found, by name; each once."""
    listed = phases.select(run, dataset, F.col(order).cast("long").alias("_at")).unionByName(found.select(run, dataset, F.lit(None).cast("long").alias("_at")))
    once = listed.groupBy(run, dataset).agg(F.min("_at").alias("_at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.col("_at").asc_nulls_last(), dataset))).drop("_at")


def checkpoint_series(rows: DataFrame, keys: Sequence[str], points: str) -> DataFrame:
    """keys, place, step, value of an array of struct(step, value): by step, those without one last, as they stood."""
    long = rows.select(*keys, F.posexplode(points).alias("_at", "x")).select(*keys, "_at", "x.step", "x.value")
    return long.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("step").asc_nulls_last(), "_at"))).drop("_at")


def tensor_rows(rows: DataFrame, keys: Sequence[str], tensor: str) -> DataFrame:
    """keys, seed, step, value of a nested array with a series for each seed."""
    seeds = rows.select(*keys, F.posexplode(tensor).alias("seed", "_series"))
    return seeds.select(*keys, "seed", F.posexplode("_series").alias("step", "value"))


def noise_type(feature: Column, behavior: Column) -> Column:
    """feature, behavior or zero: which of the two noises a run has, feature noise first."""
    on = lambda c: (c > 0) & ~F.isnan(c)
    return F.when(on(feature), "feature").when(on(behavior), "behavior").otherwise("zero")


def noise_optima(rows: DataFrame, feature: str, behavior: str, keys: Sequence[str], alpha: str, gain: str) -> DataFrame:
    """noise_type, noise_scale, keys, alpha, gain: for each kind and size of noise the alpha with the highest mean gain, the least one among equals."""
    kind = noise_type(F.col(feature), F.col(behavior)).alias("noise_type")
    cells = rows.groupBy(kind, F.greatest(feature, behavior).alias("noise_scale"), *keys, alpha).agg(F.avg(gain).alias(gain))
    best = F.max_by(F.struct(alpha, gain), F.struct(gain, -F.col(alpha)))
    return cells.groupBy("noise_type", "noise_scale", *keys).agg(best.alias("_best")).select("noise_type", "noise_scale", *keys, "_best.*")


def unique_experiments(rows: DataFrame, name: str, ignored: Sequence[str]) -> DataFrame:
    """One row for each different set of settings, the first by name; name and the ignored columns aren't settings."""
    settings = [c for c in rows.columns if c not in (name, *ignored)]
    cells = F.struct(name, *(c for c in rows.columns if c not in settings and c != name))
    return rows.groupBy(*settings).agg(F.min(cells).alias("_first")).select(*settings, "_first.*").select(*rows.columns)


def phase_needs(phases: DataFrame, run: str, phase: str, rank: str, folder: str, command: str) -> DataFrame:
    """(run, phase, needed) from the commands that trained the phases of a run.

    A phase needs the first other one, by rank and name, whose folder holds the model that its command names by --model_name,
    or whose name stands in the model's path before a checkpoint. Phases whose command names no such model aren't listed.
    """
    mine = phases.select(run, F.col(phase).alias("_phase"), option_value(F.col(command), "model_name").alias("_model")).filter("_model <> ''")
    mine = mine.withColumn("_at", plain_path(F.col("_model")))
    others = phases.select(run, F.col(phase).alias("needed"), F.col(rank).alias("_rank"), plain_path(F.col(folder)).alias("_folder"))
    within = (F.col("_at") == F.col("_folder")) | F.col("_at").startswith(F.concat("_folder", F.lit("/"))) | F.contains("_model", F.concat(F.lit("/"), "needed", F.lit("/checkpoint-")))
    found = mine.join(others, run).filter((F.col("_phase") != F.col("needed")) & within)
    return found.groupBy(run, F.col("_phase").alias(phase)).agg(F.min_by("needed", F.struct("_rank", "needed")).alias("needed"))


def phase_places(phases: DataFrame, needs: DataFrame, run: str, phase: str, needed: str, rank: str) -> DataFrame:
    """run, phase, place: phases in the order of a queue, which each joins once all that it needs has left.

    phases(run, phase, rank), needs(run, phase, needed). Phases that need nothing stand in the queue by rank and name, then, behind
    them, those that the first of them sets free, by rank and name, then those that the second does, and so on. Needs of phases that the run doesn't
    have, and of itself, don't count. What a circle holds up follows at the end, by rank and name. All runs are placed
    together, a level of phases in a round: behind every phase of a level stand those whose last need is in it.
    """
    own = written(phases.select(run, phase, rank).distinct())
    known = needs.select(run, phase, F.col(needed).alias("_need")).filter(F.col(phase) != F.col("_need")).distinct()
    known = written(known.join(own.select(run, F.col(phase).alias("_need")), [run, "_need"], "left_semi"))
    by = Window.partitionBy(run).orderBy("_last", rank, phase)
    placed, left = None, own.withColumn("_last", F.lit(-1).cast("long"))
    free = left.join(known, [run, phase], "left_anti")
    while True:
        ahead = placed.groupBy(run).agg((F.max("place") + 1).alias("_ahead")) if placed is not None else own.select(run).distinct().withColumn("_ahead", F.lit(0).cast("long"))
        level = free.withColumn("place", F.row_number().over(by).cast("long") - 1).join(ahead, run).withColumn("place", F.col("place") + F.col("_ahead")).select(run, phase, "place")
        level = written(level)
        if level.isEmpty():
            break
        placed = level if placed is None else written(placed.unionAll(level))
        at = placed.select(run, F.col(phase).alias("_need"), F.col("place").alias("_place"))
        met = known.join(at, [run, "_need"], "left").groupBy(run, phase).agg(F.max("_place").alias("_last"), F.count_if(F.col("_place").isNull()).alias("_open"))
        free = own.join(met.filter("_open = 0").drop("_open"), [run, phase]).join(placed.select(run, phase), [run, phase], "left_anti")
    if placed is None:
        ahead, rest = own.select(run).distinct().withColumn("_ahead", F.lit(0).cast("long")), own
    else:
        ahead, rest = placed.groupBy(run).agg((F.max("place") + 1).alias("_ahead")), own.join(placed, [run, phase], "left_anti")
    behind = Window.partitionBy(run).orderBy(rank, phase)
    circles = rest.withColumn("place", F.row_number().over(behind) - 1).join(ahead, run, "left").select(run, phase, (F.col("place") + F.coalesce("_ahead", F.lit(0))).alias("place"))
    out = circles if placed is None else placed.unionAll(circles)
    return out.withColumn("place", F.col("place").cast("int"))


def command_order(phases: DataFrame, run: str, phase: str, rank: str, folder: str, command: str) -> DataFrame:
    """run, phases: the order of a run's phases that their commands tell; runs where no phase needs another have none."""
    needs = written(phase_needs(phases, run, phase, rank, folder, command))
    told = phases.join(needs.select(run).distinct(), run, "left_semi")
    places = phase_places(told, needs, run, phase, "needed", rank)
    return places.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", phase))), lambda x: x[phase]).alias("phases"))


def phase_order(forced: Column, configured: Column, commands: Column, suffix: Column, explicit: Column, existing: Column, default: Sequence[str]) -> Column:
    """struct(order, source): the first order of phases that isn't empty, in this rank of sources, and where it is from."""
    sources = {"forced": forced, "config": configured, "commands": commands, "suffix": suffix, "explicit": explicit, "existing": existing}
    out = F.struct(F.array(*map(F.lit, default)).alias("order"), F.lit("default").alias("source"))
    for name, order in reversed(sources.items()):
        out = F.when(F.size(order) > 0, F.struct(order.alias("order"), F.lit(name).alias("source"))).otherwise(out)
    return out


def suffix_phases(name: Column, known: Mapping[str, Sequence[str]]) -> Column:
    """The phases that a run's name tells by its longest known ending; an empty list if it tells none."""
    out = F.array().cast("array<string>")
    for end in sorted(known, key=len):
        out = F.when(name.endswith(end), F.array(*map(F.lit, known[end]))).otherwise(out)
    return out


def sampled_occupancy(tree: DataFrame, depth: int, walks: int, seed: str) -> DataFrame:
    """(state, depth, share) of `walks` walks down a prefix tree(state, depth, child, p) from state 0.

    A walk's step is chosen by the hash of seed, walk and depth, so that the same walks come out on any layout.
    """
    from sparkloom.functions.hashing import hash_unit

    w = Window.partitionBy("state", "depth").orderBy("child")
    edges = tree.withColumn("_to", F.sum("p").over(w)).withColumn("_last", F.lead("child").over(w).isNull()).withColumn("_from", F.col("_to") - F.col("p"))
    at = tree.sparkSession.range(walks).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("state"))
    out = None
    for d in range(depth + 1):
        level = at.groupBy("state").agg((F.count("*") / walks).alias("share")).select("state", F.lit(d).alias("depth"), "share")
        out = level if out is None else out.unionByName(level)
        if d < depth:
            unit = at.withColumn("_u", hash_unit(F.lit(seed), F.col("walk"), F.lit(d)))
            step = unit.join(edges.filter(F.col("depth") == d).drop("depth"), "state")
            at = step.filter((F.col("_u") >= F.col("_from")) & ((F.col("_u") < F.col("_to")) | F.col("_last"))).select("walk", F.col("child").alias("state"))
    return out


def free_paths(ids: DataFrame, ident: str, steps: int, seed: str, retries: int = 100) -> DataFrame:
    """ident, attempt, path: walks of unit steps that never meet themselves, the first of up to `retries` draws.

    Directions come from hashes of seed, id, attempt and step. An id all of whose draws meet themselves has no row.
    Attempts are drawn ten at a time, and only for the ids that still need one.
    """
    from sparkloom.functions.hashing import hash_unit

    def draw(of: DataFrame, first: int, last: int) -> DataFrame:
        tries = of.select(ident, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("attempt"))
        turn = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.floor(hash_unit(F.lit(seed), F.col(ident), F.col("attempt"), k) * 4).cast("int"))
        along = lambda k: F.transform("turn", lambda d: F.when(d == k, 1).when(d == k + 2, -1).otherwise(0))
        x, y = along(0), along(1)
        start = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
        path = F.aggregate(F.arrays_zip(F.col("dx"), F.col("dy")), start, lambda p, d: F.concat(p, F.array(F.struct((F.element_at(p, -1)["x"] + d["dx"]).alias("x"), (F.element_at(p, -1)["y"] + d["dy"]).alias("y")))))
        walks = tries.withColumn("turn", turn).withColumns({"dx": x, "dy": y}).select(ident, "attempt", path.alias("path"))
        free = walks.filter(F.size(F.array_distinct("path")) == steps + 1)
        return free.groupBy(ident).agg(F.min(F.struct("attempt", "path")).alias("_x")).select(ident, "_x.*")

    found = draw(ids, 0, min(9, retries - 1))
    for first in range(10, retries, 10):
        rest = ids.join(found, ident, "left_anti")
        if rest.isEmpty():
            break
        found = found.unionByName(draw(rest, first, min(first + 9, retries - 1)))
    return found


def folded_edges(edges: Column) -> Column:
    """struct(x, y, ok): the end of a chain of edges (parent, child, dx, dy, distance); ok while each begins where the last ended."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("at"))
    step = lambda a, e: F.struct((a["x"] + e["dx"] * e["distance"]).alias("x"), (a["y"] + e["dy"] * e["distance"]).alias("y"), (a["ok"] & (a["at"].isNull() | (a["at"] == e["parent"]))).alias("ok"), e["child"].alias("at"))
    return F.aggregate(edges, start, step, lambda a: F.struct(a["x"], a["y"], a["ok"]))


def quarter_turn(x: Column, y: Column) -> Column:
    """A direction turned by 90 degrees clockwise."""
    return F.struct(y.alias("x"), (-x).alias("y"))


def occupancy(tree: DataFrame, depth: int) -> DataFrame:
    """(state, depth, mass): probability pushed down a prefix tree(state, depth, child, p) from state 0, a join a level."""
    mass = tree.sparkSession.createDataFrame([(0, 0, 1.0)], "state long, depth int, mass double")
    out = mass
    for d in range(depth):
        edges = tree.filter(F.col("depth") == d).select("state", "child", "p")
        mass = mass.join(edges, "state").groupBy(F.col("child").alias("state")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass")).select("state", F.lit(d + 1).alias("depth"), "mass")
        out = out.unionByName(mass)
    return out


def weighted_state_mean(rows: DataFrame, keys: Sequence[str], mass: str, value: str) -> DataFrame:
    """The mean of a value weighted by mass; null without mass."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(mass) * F.col(value)), F.sum(mass)).alias("mean"))


def state_geometry(p: Column, q: Column, target: Column) -> Column:
    """struct of what tells a state's student p, teacher q and target apart.

    Divergences, total variation, entropies, the student's support of the others' likeliest child, the sizes of the two logit gradients,
    their cosine and log ratio (null unless the product of the sizes is over 1e-20), and whether these are there.
    """
    size = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    support = lambda of: F.element_at(p, F.array_position(of, F.array_max(of)).cast("int"))

    def told(g):
        f, r = g["f"], g["r"]
        big = size(f) * size(r) > 1e-20
        return F.struct(
            vectors.kl(q, p).alias("forward_kl"), vectors.kl(p, q).alias("reverse_kl"), vectors.jsd(p, q).alias("jsd"), vectors.total_variation(p, q).alias("tv"),
            vectors.entropy(p).alias("student_entropy"), vectors.entropy(q).alias("teacher_entropy"), vectors.entropy(target).alias("target_entropy"), support(q).alias("teacher_support"), support(target).alias("target_support"),
            size(f).alias("forward_norm"), size(r).alias("reverse_norm"), F.when(big, dot(f, r) / (size(f) * size(r))).alias("cosine"), F.when(big, F.log(size(f) / size(r))).alias("log_ratio"), big.cast("double").alias("comparable"),
        )

    # The gradients are worked out once for all that is made of them.
    return vectors.let(F.struct(vectors.forward_gradient(p, q).alias("f"), vectors.reverse_gradient(p, q).alias("r")), told)


def occupancy_means(states: DataFrame, mass: DataFrame, values: Sequence[str], horizon: int, conditional: Sequence[str] = (), held_out: Sequence[str] = (), trained: str = "trained") -> DataFrame:
    """One row: means of state values over an occupancy(state, depth, mass), joined by state and depth and summed in one pass.

    values: the sum of mass times value over the horizon. conditional: over the mass of the states where the value is there.
    held_out: over the mass of the states that aren't trained on, as <value>_held_out, null where they have none.
    """
    both = states.join(mass, ["state", "depth"])
    m, held = F.col("mass"), ~F.col(trained) if held_out else F.lit(False)
    out = [(F.sum(m * F.col(v)) / horizon).alias(v) for v in values]
    out += [F.try_divide(F.sum(m * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), m))).alias(v) for v in conditional]
    out += [F.try_divide(F.sum(F.when(held, m * F.col(v))), F.sum(F.when(held, m))).alias(f"{v}_held_out") for v in held_out]
    return both.agg(*out)


def masked_sequence_mean(rows: DataFrame, sequence: str, value: str, mask: str, skip: int = 0, position: str | None = None) -> DataFrame:
    """The batch mean of sequences' masked token means; the first `skip` positions don't count."""
    use = F.col(mask) * (F.when(F.col(position) >= skip, 1.0).otherwise(0.0) if position else F.lit(1.0))
    per = rows.groupBy(sequence).agg((F.sum(F.col(value) * use) / F.greatest(F.sum(use), F.lit(1.0))).alias("m"))
    return per.agg(F.avg("m").alias("mean"))


def length_stats(rows: DataFrame, length: str, limit: int, ended: Column) -> DataFrame:
    """Mean, least and largest length, the share cut at the limit, and the mean of those that ended (0 without any)."""
    return rows.agg(F.avg(length).alias("mean"), F.min(length).alias("least"), F.max(length).alias("largest"), F.avg((F.col(length) >= limit).cast("double")).alias("clipped"), F.coalesce(F.avg(F.when(ended, F.col(length))), F.lit(0.0)).alias("ended_mean"))
