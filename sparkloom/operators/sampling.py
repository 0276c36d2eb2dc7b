"""Hash-ranked samples, quotas, splits and schedules: the same rows on every run and layout of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import hash_id, hash_unit

from .places import discard, exact_quantiles, numbered, written


def hash_rank(keys: Sequence[str], seed: str, ident: str) -> Column:
    """The place of a row within its group in the order of the hash of seed and id, from 1."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(hash_id(F.lit(seed), F.col(ident), digits=64), ident))


def with_rank(rows: DataFrame, keys: Sequence[str], seed: str, ident: str) -> DataFrame:
    """rows with _rank, the same as hash_rank(), where a group may hold a large share of all rows.

    A group is cut into ranges of hashes; rows are ranked within a range, and ranges count on from those before them.
    """
    dealt = rows.withColumn("_hash", hash_id(F.lit(seed), F.col(ident), digits=64)).withColumn("_range", F.substring("_hash", 1, 4))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_hash", ident)))
    a, b = own.alias("a"), ahead.alias("b")
    same = F.col("a._range") == F.col("b._range")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("a._own") + F.col("b._ahead")).alias("_rank"))


def hash_order(rows: DataFrame, ident: str, seed: str) -> DataFrame:
    """rows in the order of their hash."""
    return rows.orderBy(hash_unit(F.lit(seed), F.col(ident)), ident)


def quota(rows: DataFrame, bucket: str, ident: str, total: int, buckets: int, seed: str) -> DataFrame:
    """total // buckets rows of every bucket, one more of the first ones by name; short buckets aren't topped up.

    A first pass keeps what could be needed per bucket and salt, so a hot bucket isn't ranked whole in one task.
    """
    share, extra = divmod(total, buckets)
    place = rows.select(bucket).distinct().withColumn("_place", F.dense_rank().over(Window.orderBy(bucket)))  # one row a bucket
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(64)))
    near = salted.withColumn("_near", hash_rank([bucket, "_salt"], seed, ident)).filter(F.col("_near") <= share + 1)
    ranked = near.withColumn("_rank", hash_rank([bucket], seed, ident)).join(F.broadcast(place) if buckets <= 10_000 else place, bucket)
    return ranked.filter(F.col("_rank") <= share + (F.col("_place") <= extra).cast("int")).select(*rows.columns)


def nested(rows: DataFrame, bucket: str, ident: str, sizes: Sequence[int], seed: str, strict: bool = False) -> DataFrame:
    """rows with `level`: the smallest of the sizes per bucket that holds the row, so smaller samples lie within larger ones.

    strict: a bucket with fewer rows than the largest size is an error; else it gives what it has.
    """
    if strict:
        short = [r[0] for r in rows.groupBy(bucket).count().filter(F.col("count") < max(sizes)).orderBy(bucket).limit(5).collect()]
        if short:
            raise ValueError(f"too few rows in {short}")
    level = F.lit(None).cast("int")
    for size in sorted(sizes, reverse=True):
        level = F.when(F.col("_rank") <= size, size).otherwise(level)
    return with_rank(rows, [bucket], seed, ident).withColumn("level", level).drop("_rank").filter("level is not null")


def train_eval(rows: DataFrame, bucket: str, ident: str, share: float, seed: str) -> DataFrame:
    """split: in each bucket max(1, round half even of n * share), n - 1 at most, go to eval; single rows to train."""
    n = F.col("_n")
    take = F.when(n == 1, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))))
    counts = rows.groupBy(bucket).agg(F.count("*").alias("_n")).select(F.col(bucket).alias("_bucket"), take.alias("_take"))
    ranked = with_rank(rows, [bucket], seed, ident).join(counts, F.col(bucket).eqNullSafe(F.col("_bucket")))
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_take"), "eval").otherwise("train")).drop("_rank", "_bucket", "_take")


def three_way(rows: DataFrame, ident: str, n_train: int, n_eval: int, seed: str) -> DataFrame:
    """split: by hash order n_train rows to train, the next n_eval to eval, the rest to test."""
    rank = F.col("_rank")
    split = F.when(rank <= n_train, "train").when(rank <= n_train + n_eval, "eval").otherwise("test")
    return with_rank(rows, [], seed, ident).withColumn("split", split).drop("_rank")


def balanced(rows: DataFrame, ident: str, values: Sequence[int], seed: str) -> DataFrame:
    """rows with scheduled: one of the values for each, in hash order; each value as often as the others, the first ones once more if need be."""
    n, k = rows.count(), len(values)
    each, more = divmod(n, k)
    rank = F.col("_rank") - 1
    first = F.expr(f"(_rank - 1) div {each + 1}")
    place = F.when(rank < (each + 1) * more, first).otherwise(F.expr(f"{more} + (_rank - 1 - {(each + 1) * more}) div {max(each, 1)}"))
    return with_rank(rows, [], seed, ident).withColumn("scheduled", F.get(F.array(*map(F.lit, values)), place.cast("int"))).drop("_rank")


def weighted_choice(options: Sequence[tuple[str, float]], unit: Column) -> Column:
    """The option in whose share of the weights a number in [0, 1) falls."""
    total, at, out = sum(w for _, w in options), 0.0, F.lit(options[-1][0])
    edges = []
    for name, weight in options[:-1]:
        at += weight / total
        edges.append((name, at))
    for name, edge in reversed(edges):
        out = F.when(unit < edge, F.lit(name)).otherwise(out)
    return out


def repeated(rows: DataFrame, each: int, batches: int) -> DataFrame:
    """Every row `each` times in each of `batches` passes, with batch and copy."""
    return rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))


def high_quantile(rows: DataFrame, value: str, share: float) -> DataFrame:
    """masked: whether a row is among the top `share` of all values, by the exact quantile."""
    edge = exact_quantiles(rows, [], value, [1 - share]).first()  # one number
    return rows.withColumn("masked", F.col(value) >= F.lit(edge[0] if edge else None).cast("double"))


def unique_in_order(rows: DataFrame, keys: Sequence[str], split_rank: str, ident: str) -> DataFrame:
    """Rows none of whose keys stood before, by the order of splits and ids; one key after the other."""
    for k in keys:
        w = Window.partitionBy(k).orderBy(split_rank, ident)
        rows = rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return rows


def batches(rows: DataFrame, key: str, order: str, size: str, most_rows: int, most_size: int, block: int | None = None) -> DataFrame:
    """rows with batch: greedy runs of rows within a key, in order, up to a number of rows and a sum of sizes.

    A row larger than the limit, or without a size, stops the job; rows without a key are a key of their own; of rows that
    tie in the order either may come first. Where a batch begins depends on all before it, but it begins within `most_rows`
    rows of any place. So a key is cut into blocks of rows (`block`, most_rows at least). Each block tells, for every row
    that its first batch may begin with, how many batches follow and where the first one of the next block begins. Two
    neighbouring blocks are then joined to one, again and again, until a key is one, and on the way back every block
    learns its first batch. No task holds more than a block, and the joined maps halve from round to round.
    """
    block = max(most_rows, block or max(100_000, 8 * most_rows))
    fits = F.when(F.col(size).cast("long") <= most_size, F.col(size).cast("long")).otherwise(F.raise_error(F.lit("a row is larger than a batch")).cast("long"))
    # From here on a key is a text that is never null.
    named = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "_bytes": fits})
    placed = written(numbered(named, ["_key"], [order], "_bytes").withColumn("_block", F.floor(F.col("_at") / block)))
    # A block also sees the rows of the next one that its last batch may reach.
    reached = F.when((F.col("_at") % block < most_rows) & (F.col("_block") > 0), F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))
    seen = placed.select("_key", "_at", "_before", "_bytes", F.explode(reached).alias("_block"))
    ways = written(seen.groupBy("_key", "_block").applyInPandas(ways_through(block, most_rows, most_size), "_key string, _block long, _entry long, _exit long, _n long"))
    rounds = [ways]
    while not rounds[-1].filter("_block > 0").isEmpty():
        rounds.append(written(pairs_of_blocks(rounds[-1])))
    first = rounds.pop().filter("_entry = 0").select("_key", "_block", "_entry", F.lit(0).cast("long").alias("_batch"))
    for halves in reversed(rounds):
        first = written(halved(first, halves))
        discard(halves)
    firsts = first.select("_key", "_block", "_entry", "_batch")
    known = seen.join(firsts, ["_key", "_block"]).groupBy("_key", "_block").applyInPandas(batches_of_block(block, most_rows, most_size), "_key string, _at long, batch long")
    return placed.join(known, ["_key", "_at"]).select(*rows.columns, "batch")


def next_starts(before, sizes, most_rows: int, most_size: int):
    """For each row, the place of the row that a batch beginning with it leaves to the next one."""
    import numpy as np

    ends = before + sizes
    return np.minimum(np.searchsorted(ends, before + most_size, "right"), np.arange(len(before)) + most_rows)


def ways_through(block: int, most_rows: int, most_size: int):
    """Of a block: for each row its first batch may begin with, the batches that begin in it and where the next one begins in the following block."""

    def run(data):
        import numpy as np
        import pandas as pd

        data = data.sort_values("_at")
        own = int((data["_at"] // block == data["_block"]).sum())
        jump = np.r_[next_starts(data["_before"].to_numpy(), data["_bytes"].to_numpy(), most_rows, most_size), len(data)]
        n = np.ones(len(jump), np.int64)
        jump[own:], n[own:] = np.arange(own, len(jump)), 0
        while (jump[:own] < own).any():  # twice as far each time
            n, jump = n + n[jump], jump[jump]
        entry = np.arange(min(most_rows, own + 1))
        return pd.DataFrame({"_key": data["_key"].iloc[0], "_block": data["_block"].iloc[0], "_entry": entry, "_exit": jump[entry] - own, "_n": n[entry]})

    return run


def pairs_of_blocks(ways: DataFrame) -> DataFrame:
    """The ways through each two neighbouring blocks; a last one without a neighbour stays as it is."""
    a = ways.filter("_block % 2 = 0").alias("a")
    b = ways.filter("_block % 2 = 1").alias("b")
    both = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a._block") + 1 == F.col("b._block")) & (F.col("a._exit") == F.col("b._entry")), "left")
    return both.select("a._key", F.expr("a._block div 2").alias("_block"), "a._entry", F.coalesce("b._exit", "a._exit").alias("_exit"), (F.col("a._n") + F.coalesce("b._n", F.lit(0))).alias("_n"))


def halved(first: DataFrame, ways: DataFrame) -> DataFrame:
    """From the first batch of each pair of blocks to that of each block, by the ways through the single blocks."""
    left = first.select("_key", (F.col("_block") * 2).alias("_block"), "_entry", "_batch")
    a, b = left.alias("a"), ways.alias("b")
    through = a.join(b, ["_key", "_block", "_entry"]).select("_key", (F.col("_block") + 1).alias("_block"), F.col("_exit").alias("_entry"), (F.col("_batch") + F.col("_n")).alias("_batch"))
    there = ways.filter("_block % 2 = 1 and _entry = 0").select("_key", "_block")
    return left.unionAll(through.join(there, ["_key", "_block"], "left_semi"))


def batches_of_block(block: int, most_rows: int, most_size: int):
    """The batch of each row of a block whose first one, and its number, are known."""

    def run(data):
        import numpy as np
        import pandas as pd

        data = data.sort_values("_at")
        own = int((data["_at"] // block == data["_block"]).sum())
        ahead, starts, i = next_starts(data["_before"].to_numpy(), data["_bytes"].to_numpy(), most_rows, most_size), np.zeros(own, np.int64), int(data["_entry"].iloc[0])
        while i < own:
            starts[i] = 1
            i = int(ahead[i])
        return pd.DataFrame({"_key": data["_key"].iloc[0], "_at": data["_at"].iloc[:own], "batch": int(data["_batch"].iloc[0]) - 1 + np.cumsum(starts)})

    return run


def batch_parts(batched: DataFrame, key: str, size: str, prefix: str) -> DataFrame:
    """What is to be written for each batch: key, part, input_file, output_file, errors_file, request_count, size_bytes and the status `prepared`."""
    name = lambda what: F.format_string(f"{prefix}_{what}_%03d.jsonl", F.col("batch"))
    parts = batched.groupBy(key, "batch").agg(F.count("*").alias("request_count"), F.sum(F.col(size).cast("long")).alias("size_bytes"))
    return parts.select(key, F.col("batch").alias("part"), name("input").alias("input_file"), name("output").alias("output_file"), name("errors").alias("errors_file"), "request_count", "size_bytes", F.lit("prepared").alias("status"))
