"""Content-chosen anchors: what both substring dedups share around their suffix arrays and automata.

Every window of `window` consecutive symbols (bytes or words) has one anchor: the leftmost place in it where the hash
of a `gram`-symbol gram is smallest. The choice depends on the window's content alone, so two equal windows have the
same anchor gram at the same offset, and a repeated window can only be found among the occurrences of one anchor key.
The windows of a text that share an anchor are consecutive; they and the symbols they cover are the anchor's context.

Occurrences with equal (key, 128-bit hash of the context) form a class. A class is represented by its first occurrence
and, if it has others, its last one; whether a window of them starts elsewhere is for the suffix array or automaton of
the key to say, which gets their whole contents, so nothing is removed on equal hashes alone. Keys with more classes
than one task should hold are cut into single windows, which are grouped by their 128-bit hashes; the first and the last
window of a group go to a suffix array or automaton in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, salted_join, stored

#: row1, row2: a row's id and a hash of its text. span: the context's first window and how many follow it.
ANCHOR_SCHEMA = "row1 long, row2 long, key long, ctx1 long, ctx2 long, span long"
CLASS = ["key", "ctx1", "ctx2"]
#: Windows of a hot key's context that stand or fall together at first.
BLOCK = 6
#: Bits of a span for the number of following windows.
BITS = 16
#: Bytes of a text whose symbols are held at once.
CHUNK = 1 << 20
SECOND = np.uint64(0xA5A5A5A5A5A5A5A5)
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    out = []
    for base in (_ODD, _ODD_INVERSE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Ranges:
    """Hashes of arbitrary ranges of one chunk of symbol hashes in constant time each."""

    def __init__(self, symbols: np.ndarray, power: tuple[np.ndarray, np.ndarray]):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * power[0][:n], out=self.sums[1:])
        self.inverse = power[1]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the smallest of values[i:i+width]."""
    best, at, span = values, np.arange(len(values), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        right = best[step : step + n] < best[:n]
        at = np.where(right, at[step : step + n], at[:n])
        best = np.where(right, best[step : step + n], best[:n])
        span += step
    return at


def anchors_of(symbols: np.ndarray, window: int, gram: int, power) -> tuple[np.ndarray, ...]:
    """(key, ctx1, ctx2, lo, hi) of every anchor of one chunk: windows lo..hi choose it. Empty for under `window` symbols."""
    if len(symbols) < window:
        return (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),) * 2
    ranges = Ranges(symbols, power)
    start = np.arange(len(symbols) - gram + 1)
    grams = ranges.of(start, start + gram)
    at = leftmost_minimum(grams, window - gram + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    where = at[first]
    shape = mix(((where - first) * 65537 + (last - first)).astype(np.uint64))
    ctx = [mix(r.of(first, last + window) ^ shape) for r in (ranges, Ranges(mix(symbols ^ SECOND), power))]
    return grams[where], *ctx, first, last


def anchor_table(docs: DataFrame, window: int, gram: int, symbols_of) -> DataFrame:
    """ANCHOR_SCHEMA rows of docs(row1, row2, text).

    symbols_of(): makes a function from a text's bytes to the hashes of its symbols, an array for each CHUNK of bytes.
    """

    def run(batches):
        to_symbols, power = symbols_of(), powers(CHUNK + 2 * window)
        for batch in batches:
            row1, row2, text = (batch.column(k) for k in ("row1", "row2", "text"))
            rows, parts, size = [], [], 0

            def flush():
                index = pa.array(np.repeat(np.asarray(rows, np.int64), [len(p[0]) for p in parts]))
                key, ctx1, ctx2, lo, hi = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in range(5))
                return pa.RecordBatch.from_arrays([row1.take(index), row2.take(index), *map(pa.array, (key, ctx1, ctx2, lo << BITS | hi - lo))], ["row1", "row2", "key", "ctx1", "ctx2", "span"])

            for i in range(batch.num_rows):
                if not text[i].is_valid:
                    continue
                begin, held = 0, np.empty(0, np.uint64)
                for symbols in to_symbols(text[i].as_buffer()):
                    held = np.concatenate([held, symbols])
                    found = anchors_of(held, window, gram, power)
                    if len(found[0]):
                        rows.append(i)
                        parts.append((*found[:3], found[3] + begin, found[4] + begin))
                        size += len(found[0])
                    rest = min(len(held), window - 1)  # what windows over the end of the chunk need
                    begin += len(held) - rest
                    held = held[len(held) - rest :]
                if size > 200_000:
                    yield flush()
                    rows, parts, size = [], [], 0
            if parts:
                yield flush()

    return arrow_map(docs.select("row1", "row2", "text"), run, ANCHOR_SCHEMA)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, as maximal disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (inclusive) of the runs of true values."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def live(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors whose key occurs more than once, stored, and how many there are."""
    anchors = stored(anchors)
    keys = stored(anchors.groupBy("key").agg(F.count("*").alias("total")).filter("total > 1"))
    kept = stored(salted_join(anchors, keys, ["key"], "total", anchors.count(), F.struct("row1", "span")))
    discard(anchors, keys)
    return kept, kept.count()


def classes_of(anchors: DataFrame, limit: int) -> DataFrame:
    """One row per class of live anchors, stored: CLASS, n (occurrences), first and last (row1, row2, span), hot.

    hot: the key has over `limit` classes.
    """
    where = F.struct("row1", "row2", "span")
    groups = stored(anchors.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(where).alias("first"), F.max(where).alias("last")))
    hot = groups.groupBy("key").agg(F.count("*").alias("n_ctx")).filter(F.col("n_ctx") > limit).select("key", F.lit(True).alias("hot"))
    return groups.join(stored(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def bodies_of(groups: DataFrame, docs: DataFrame, window: int, cut, in_order: bool) -> DataFrame:
    """The contents of what represents the classes, stored: CLASS, part (0: the first, 1: the last), row1, hot, body.

    cut(): makes a function from a text's bytes to a function from (start, stop) in symbols to the bytes of that range.
    in_order: the last occurrence counts only if its row1 is larger than the first one's.
    """
    first, last = (F.struct(F.lit(k).alias("part"), f"{name}.row1", f"{name}.row2", f"{name}.span") for k, name in enumerate(("first", "last")))
    two = F.col("last.row1") > F.col("first.row1") if in_order else F.col("n") > 1
    places = groups.select(*CLASS, "hot", F.explode(F.when(two, F.array(first, last)).otherwise(F.array(first))).alias("x")).select(*CLASS, "hot", "x.*")
    wanted = places.groupBy("row1", "row2").agg(F.collect_list(F.struct(*CLASS, "part", "hot", "span")).alias("items"))
    joined = docs.select("row1", "row2", "text").join(wanted, ["row1", "row2"])
    names = [*CLASS, "part", "row1", "hot", "body"]
    kinds = [*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches):
        make, done = cut(), None
        for batch in batches:
            row1, row2, text, items = (batch.column(k) for k in ("row1", "row2", "text", "items"))
            out, size = [], 0
            for i in range(batch.num_rows):
                row = row1[i].as_py(), row2[i].as_py()
                if row == done:  # rows equal in id and text
                    continue
                done, of = row, make(text[i].as_buffer())
                for x in items[i].as_py():
                    lo = x["span"] >> BITS
                    out.append((*(x[k] for k in CLASS), x["part"], row[0], x["hot"], of(lo, lo + (x["span"] & (1 << BITS) - 1) + window)))
                    size += len(out[-1][-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return stored(arrow_map(joined, run, "key long, ctx1 long, ctx2 long, part int, row1 long, hot boolean, body binary"))


def anchor_place(symbols: np.ndarray, window: int, gram: int, power) -> int:
    """Where the anchor of a context stands, which all its windows share."""
    start = np.arange(window - gram + 1)
    return int(leftmost_minimum(Ranges(symbols[:window], power).of(start, start + gram), len(start))[0])


def hot_windows(bodies: DataFrame, window: int, gram: int, symbols_of) -> DataFrame:
    """The windows of hot keys' bodies that may start elsewhere: CLASS, part, row1, at (from the context's first), h1, h2.

    Equal windows have their anchor at the same offset, so the windows of a body whose offsets fall into one block of BLOCK
    have a core in common that a window equal to one of them has, too: blocks whose core stands in no other body go first,
    by their 128-bit hashes, and only the rest are cut into windows, with 128-bit hashes of their own.
    """
    keys, one = [*CLASS, "part"], ["h1", "h2"]
    hot = bodies.filter("hot").select(*keys, "row1", "body")

    def hashed(symbols, power, start, stop, salt):
        return [mix(Ranges(s, power).of(start, stop) ^ salt).view(np.int64) for s in (symbols, mix(symbols ^ SECOND))]

    def blocks(batches):
        to_symbols = symbols_of()
        for batch in batches:
            rows, parts = [], []
            for i, body in enumerate(batch.column("body")):
                symbols = np.concatenate([np.empty(0, np.uint64), *to_symbols(body.as_buffer())])
                power, at = powers(len(symbols) + 1), anchor_place(symbols, window, gram, powers(window + 1))
                block = np.unique((at - np.arange(len(symbols) - window + 1)) // BLOCK)
                begin = at - block * BLOCK
                rows.append(np.full(len(block), i))
                parts.append([block, *hashed(symbols, power, begin, begin - BLOCK + 1 + window, mix(block.astype(np.uint64)))])
            if rows:
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keys), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], [*keys, "block", *one])

    cores = stored(arrow_map(hot, blocks, "key long, ctx1 long, ctx2 long, part int, block long, h1 long, h2 long"))
    shared = stored(cores.groupBy(*one).agg(F.count("*").alias("n")).filter("n > 1"))
    live = salted_join(cores, shared, one, "n", cores.count(), F.struct(*keys)).groupBy(*keys).agg(F.collect_list("block").alias("blocks"))

    def windows(batches):
        to_symbols = symbols_of()
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                symbols = np.concatenate([np.empty(0, np.uint64), *to_symbols(body.as_buffer())])
                power, at = powers(len(symbols) + 1), anchor_place(symbols, window, gram, powers(window + 1))
                start = np.arange(len(symbols) - window + 1)
                start = start[np.isin((at - start) // BLOCK, batch.column("blocks")[i].values.to_numpy())]
                own = pa.array(np.full(len(start), i))
                names = [*keys, "row1"]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in names), pa.array(start), *map(pa.array, hashed(symbols, power, start, start + window, np.uint64(0)))], [*names, "at", *one])

    out = stored(arrow_map(hot.join(live, keys), windows, "key long, ctx1 long, ctx2 long, part int, row1 long, at long, h1 long, h2 long"))
    discard(cores, shared)
    return out


def found_in_hot_keys(bodies: DataFrame, window: int, gram: int, symbols_of, cut, search) -> DataFrame:
    """CLASS, part, a, b (equal): the windows of hot keys that also start elsewhere.

    Windows are grouped by their hashes; the first and the last of each group are searched as if the group were a key.
    """
    one = ["h1", "h2"]
    if bodies.filter("hot").isEmpty():
        return bodies.filter("hot").select(*CLASS, "part", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    windows = hot_windows(bodies, window, gram, symbols_of)
    where = F.struct("row1", *CLASS, "part", "at")
    groups = stored(windows.groupBy(*one).agg(F.count("*").alias("n"), F.min(where).alias("first"), F.max(where).alias("last")).filter("n > 1"))
    ends = groups.select(*one, F.explode(F.array(F.struct(F.lit(0).alias("end"), "first.*"), F.struct(F.lit(1).alias("end"), "last.*"))).alias("x")).select(*one, "x.*")
    joined = ends.join(bodies.filter("hot").select(*CLASS, "part", "body"), [*CLASS, "part"]).select(*one, "end", "row1", "at", "body")
    names = ["key", "ctx1", "ctx2", "part", "row1", "body"]

    def run(batches):
        make = cut()
        for batch in batches:
            bodies = [make(b.as_buffer())(a, a + window) for a, b in zip(batch.column("at").to_pylist(), batch.column("body"), strict=True)]
            h1, h2 = batch.column("h1"), batch.column("h2")
            yield pa.RecordBatch.from_arrays([h1, h1, h2, batch.column("end"), batch.column("row1"), pa.array(bodies, pa.binary())], names)

    cuts = stored(arrow_map(joined, run, "key long, ctx1 long, ctx2 long, part int, row1 long, body binary"))
    known = stored(search(cuts, window).groupBy(F.col("ctx1").alias("h1"), F.col("ctx2").alias("h2")).agg(F.max((F.col("part") == 0).cast("int")).alias("firsts"), F.max((F.col("part") == 1).cast("int")).alias("lasts")))
    known = stored(known.join(groups.select(*one, "n", F.col("first.row1").alias("least")), one))
    hits = salted_join(windows, known, one, "n", windows.count(), F.struct(*CLASS, "part", "at"))
    hits = hits.filter(F.when(F.col("row1") == F.col("least"), F.col("firsts")).otherwise(F.col("lasts")) == 1)
    out = stored(hits.select(*CLASS, "part", F.col("at").alias("a"), F.col("at").alias("b")))
    discard(windows, groups, cuts, known)
    return out


def removed_spans(docs: DataFrame, window: int, gram: int, limit: int, symbols_of, cut, search, in_order: bool) -> DataFrame:
    """(row1, row2, spans) of the symbols to remove, stored: array of structs a, b (half-open), not yet merged.

    docs(row1, row2, text). search(bodies, window) gives CLASS, part, a, b: the runs a..b of windows of a body, from its
    first, that start in another body of its key (in_order: in one of a smaller row1).
    """
    anchors, n = live(anchor_table(docs, window, gram, symbols_of))
    groups = classes_of(anchors, limit)
    bodies = bodies_of(groups, docs, window, cut, in_order)
    found = stored(search(bodies.filter("not hot"), window).unionByName(found_in_hot_keys(bodies, window, gram, symbols_of, cut, search)))
    discard(bodies)
    lists = [F.collect_list(F.when(F.col("part") == k, F.struct("a", "b"))).alias(name) for k, name in enumerate(("of_first", "of_rest"))]
    marks = stored(found.groupBy(*CLASS).agg(*lists).join(groups.select(*CLASS, "n", F.col("first.row1").alias("least")), CLASS))
    hit = salted_join(anchors, marks, CLASS, "n", n, F.struct("row1", "row2", "span"))
    ranges = F.when(F.col("row1") == F.col("least"), F.col("of_first")).otherwise(F.col("of_rest")) if in_order else F.col("of_first")
    lo = F.shiftright("span", BITS)
    rows = hit.select("row1", "row2", lo.alias("lo"), F.explode(ranges).alias("s"))
    out = stored(rows.groupBy("row1", "row2").agg(F.collect_list(F.struct((F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b") + window).alias("b"))).alias("spans")))
    discard(anchors, found, marks)
    return out
