"""Seeded choices as Python's random module draws them: by the Mersenne Twister of each row's own seed.

A seed is a whole number below 2 ** 64, as text in hex; seed_of() makes one of what names a row. Draws run on Arrow batches
inside tasks, so a row's choice depends on its seed alone, wherever and whenever it is drawn.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seed_of(*parts: Column | str | int, joint: str = "::") -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined: a row's seed. None is written as Python does."""
    shown = [F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat_ws(joint, *shown).cast("binary"), 256), 1, 16)


def drawn(kind: T.DataType, draw):
    """A column function of (seed, values...): draw(rng, values...) with a generator of its own for each row; null for a null seed."""

    @F.pandas_udf(kind)
    def run(seeds: pd.Series, *values: pd.Series) -> pd.Series:
        rows = zip(seeds, *values, strict=True)
        return pd.Series([None if s is None else draw(random.Random(int(s, 16)), *v) for s, *v in rows], dtype=object)

    return run


def chosen_index(n: int):
    """A column function of the seed: one of 0 to n - 1."""
    return drawn(T.IntegerType(), lambda rng: rng.randrange(n))


def chosen(options: Sequence[str]):
    """A column function of the seed: one of the options."""
    options = list(options)
    return drawn(T.StringType(), lambda rng: rng.choice(options))


def chosen_by_weight(weights: Mapping[int, float]):
    """A column function of the seed: one of the numbers, by their weights, in ascending order."""
    values = sorted(weights)
    shares = [float(weights[v]) for v in values]
    if min(shares, default=0) < 0 or sum(shares) <= 0:
        raise ValueError("weights must not be negative, nor all be 0")
    return drawn(T.LongType(), lambda rng: rng.choices(values, weights=shares)[0])


def shuffled(items: Sequence[int]):
    """A column function of the seed: the numbers in a drawn order."""
    def draw(rng: random.Random) -> list[int]:
        order = list(items)
        rng.shuffle(order)
        return order

    return drawn(T.ArrayType(T.LongType()), draw)


def epoch_variation(valid: Sequence[int], base: Column, epoch: Column, *parts: Column | str | int, policy: str = "shuffled_cycle") -> Column:
    """The variation that an epoch uses: the base one in epoch 0, then by the policy; parts name the row.

    shuffled_cycle: on from the base one through a shuffled order, around and around, so that each comes once in a cycle. random: drawn anew for each
    epoch. A base that isn't valid gives null beyond epoch 0.
    """
    if policy == "shuffled_cycle":
        order = shuffled(valid)(seed_of("context_epoch_variation", *parts, policy))
        start = F.array_position(order, base.cast("long"))
        found = F.when(start > 0, F.element_at(order, (F.pmod(start - 1 + epoch, F.size(order)) + 1).cast("int")))
    elif policy == "random":
        places = F.array(*(F.lit(int(v)).cast("long") for v in valid))
        found = F.when(F.array_contains(places, base.cast("long")), F.get(places, chosen_index(len(valid))(seed_of("context_epoch_variation", *parts, policy, epoch))))
    else:
        raise ValueError(f"{policy!r} is no policy of epochs")
    return F.when(epoch <= 0, base.cast("long")).otherwise(found)


#: The eight directions and the steps that they stand for.
DIRECTIONS = {"N": (0, 1), "NE": (1, 1), "E": (1, 0), "SE": (1, -1), "S": (0, -1), "SW": (-1, -1), "W": (-1, 0), "NW": (-1, 1)}


def backbone(names: Sequence[str], weights: Mapping[int, float], reverse: float = 0.5, tries: int = 100):
    """A column function of (seed, hops, x, y): the edges of a path over names that are drawn without replacement.

    The path begins at (x, y). Each edge has one of DIRECTIONS, a distance by its weight, the place of its child, and
    whether its statement is told from the child's side (with probability `reverse`). A place that is taken is drawn again; after
    `tries` draws, or with fewer names than places, the job stops with an error. Null hops give null.
    """
    names, lengths, kinds = list(names), sorted(weights), list(DIRECTIONS)
    shares = [float(weights[d]) for d in lengths]
    fields = [("parent", T.StringType()), ("child", T.StringType()), ("direction", T.StringType()), ("distance", T.LongType()), ("reversed", T.BooleanType()), ("x", T.LongType()), ("y", T.LongType())]

    def draw(rng: random.Random, hops, x, y):
        if hops is None or hops != hops:
            return None
        hops, at = int(hops), (int(x), int(y))
        if hops >= len(names):
            raise ValueError(f"{len(names)} names don't reach for {hops} hops")
        stops, taken, out = rng.sample(names, hops + 1), {at}, []
        for parent, child in zip(stops, stops[1:], strict=False):
            for _ in range(tries):
                direction, distance = rng.choice(kinds), rng.choices(lengths, weights=shares)[0]
                step = DIRECTIONS[direction]
                there = at[0] + step[0] * distance, at[1] + step[1] * distance
                if there not in taken:
                    break
            else:
                raise ValueError(f"no free place in {tries} draws")
            taken.add(there)
            at = there
            out.append({"parent": parent, "child": child, "direction": direction, "distance": distance, "reversed": rng.random() < reverse, "x": at[0], "y": at[1]})
        return out

    return drawn(T.ArrayType(T.StructType([T.StructField(n, k) for n, k in fields])), draw)
