"""Suffix-array dedup: removes every byte inside a long byte string that starts anywhere else, too.

Contexts of anchors that occur more than once (see anchors.py) go to partitions by anchor key; each task joins whole keys
to a text of a few MB and builds its suffix array by two-stage sorting: only suffixes smaller than their successors are
sorted directly, by 8-byte words to the depth the threshold needs; the rest are induced by one scan over the byte
buckets. Adjacent common prefixes, found by comparing bytes, then tell which windows start twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import CHUNK, CLASS, merged, mix, removed_spans, runs
from .common import arrow_map, table

WINDOW = 200
GRAM = 32
#: Classes of one key that one array takes; keys with more are cut into single windows.
HOT_CONTEXTS = 4000
#: Bytes of contexts in one suffix array, if the keys allow.
ARRAY_BYTES = 2_000_000
#: Not part of any UTF-8 text.
SEPARATOR = 255


def byte_symbols():
    """A function from UTF-8 bytes to arrays of their 64-bit hashes, one for each CHUNK bytes."""
    lookup = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def to_symbols(data):
        codes = np.frombuffer(data, np.uint8) if len(data) else np.empty(0, np.uint8)
        return (lookup[codes[i : i + CHUNK]] for i in range(0, len(codes), CHUNK))

    return to_symbols


def byte_cut():
    """A function from bytes to a function from (start, stop) to these bytes."""

    def of(data):
        view = memoryview(data)
        return lambda a, b: bytes(view[a:b])

    return of


def words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """For each place the 8 bytes from there as one big-endian number; zeros stand after the text."""
    padded = np.concatenate([text, np.zeros(2 * depth + 32, np.uint8)])
    return np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,)).astype(np.uint64)


class Prefixes:
    """Lengths of common prefixes of places of a text, `depth` at most, by comparing STRETCH bytes at a time."""

    STRETCH = 32

    def __init__(self, text: np.ndarray, depth: int):
        self.padded = np.concatenate([text, np.zeros(2 * depth + 2 * self.STRETCH, np.uint8)])
        #: For each place the bytes from there.
        self.stretches = np.ndarray(len(self.padded) - self.STRETCH + 1, f"V{self.STRETCH}", self.padded, strides=(1,))
        self.depth = depth

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, at = np.full(len(a), self.depth, np.int64), np.arange(len(a))
        for k in range(0, self.depth, self.STRETCH):
            if not len(at):
                break
            x, y = (self.stretches[p + k].view(np.uint64).reshape(len(p), -1) for p in (a, b))
            differ = np.bitwise_or.reduce([x[:, i] ^ y[:, i] for i in range(x.shape[1])]) != 0
            ends = np.flatnonzero(differ)
            if len(ends):
                first = (x[ends].view(np.uint8) != y[ends].view(np.uint8)).argmax(axis=1)
                out[at[ends]] = np.minimum(k + first, self.depth)
                at, a, b = at[~differ], a[~differ], b[~differ]
        return out

    def chained(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As common, for different places a that share 8 bytes with b at least, as those of equal words do.

        Pairs as far from each other as the next pair, and 8 bytes before it at most, go on where that one does, so that
        only the last one of such a chain is compared.
        """
        by = np.argsort(a)
        a, apart = a[by], (a - b)[by]
        ends = np.r_[(np.diff(a) > 8) | (np.diff(apart) != 0), True] if len(a) else np.empty(0, bool)
        last = a[ends]
        reach = last + self.common(last, last - apart[ends])
        out = np.empty(len(a), np.int64)
        out[by] = np.minimum(reach[np.cumsum(ends) - ends] - a, self.depth)
        return out


def sort_directly(words: np.ndarray, prefixes: Prefixes, places: np.ndarray, depth: int) -> np.ndarray:
    """places ordered by their suffixes' first `depth` bytes.

    Tied places are ordered by the word behind what their whole group has in common, so equal stretches cost no rounds.
    """
    order = places[np.argsort(words[places], kind="stable")]
    value = words[order]
    same = np.r_[value[1:] == value[:-1], False]  # tied with the next one
    while same.any():
        at = np.flatnonzero(same | np.r_[False, same[:-1]])
        head = np.flatnonzero(np.r_[True, ~same[at[1:] - 1]])
        size = np.diff(np.r_[head, len(at)])
        place = order[at]
        shared = np.minimum.reduceat(prefixes.chained(place, np.repeat(place[head], size)), head)
        group = np.repeat(np.arange(len(head)), size)
        going = np.repeat(shared < depth, size)
        same[at] = False  # settled, unless the next word ties again
        at, place, group = at[going], place[going], group[going]
        value = words[place + shared[group]]
        by = np.lexsort((value, group))
        order[at], value, group = place[by], value[by], group[by]
        same[at[:-1]] = (group[1:] == group[:-1]) & (value[1:] == value[:-1])
    return order


def next_true(flags: np.ndarray) -> np.ndarray:
    """For each place the first one from there on whose flag is set; the length of flags where there is none."""
    at = np.where(flags, np.arange(len(flags)), len(flags))
    return np.minimum.accumulate(at[::-1])[::-1]


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The order of the suffixes of text (of the wanted ones and those that induce them) to `depth` bytes, two-stage.

    A suffix is small if it precedes its successor. Small suffixes are sorted directly and close their byte's bucket;
    a scan over the buckets in order puts each other suffix, when its successor is met, at its bucket's front.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    differ = np.r_[text[1:] != text[:-1], True]
    rising = np.r_[text[1:] > text[:-1], False]  # the last suffix is followed by the empty one, which is smaller
    small = rising[next_true(differ)]
    kept = np.ones(n, bool) if wanted is None else wanted.copy()
    while True:  # a large suffix needs its successor
        more = np.flatnonzero(kept[:-1] & ~small[:-1] & ~kept[1:]) + 1
        if not len(more):
            break
        kept[more] = True
    count = np.bincount(text[kept], minlength=256)
    end = np.cumsum(count)
    front = end - count
    out = np.full(int(end[-1]), -1, np.int64)
    words = words_at(text, depth)
    direct = sort_directly(words, Prefixes(text, depth + 8), np.flatnonzero(small & kept), depth)
    owned = np.bincount(text[direct], minlength=256)
    begin = np.r_[0, np.cumsum(owned)]
    for c in range(256):
        out[end[c] - owned[c] : end[c]] = direct[begin[c] : begin[c + 1]]

    def induce(met):
        """Puts the large predecessors of met at their buckets' fronts."""
        before = met[met > 0] - 1
        before = before[kept[before] & ~small[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        had = np.bincount(first, minlength=256)
        start = np.r_[0, np.cumsum(had)]
        out[front[first] + np.arange(len(first)) - start[first]] = before
        front[:] += had

    induce(np.array([n]))  # the empty suffix comes first
    for c in np.flatnonzero(count):
        at, stop = end[c] - count[c], front[c]
        while at < stop:  # a run of c is induced within its own bucket
            induce(out[at:stop])
            at, stop = stop, front[c]
        induce(out[end[c] - owned[c] : end[c]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it, `depth` at most; 0 for the first."""
    a, b, words = order[1:], order[:-1], words_at(text, depth)
    differ = words[a] ^ words[b]
    out = np.zeros(len(order), np.int64)
    for k in range(1, 8):
        out[1:] += differ < np.uint64(1 << 8 * k)
    equal = np.flatnonzero(differ == 0)
    out[equal + 1] = Prefixes(text, depth).chained(a[equal], b[equal])
    return np.minimum(out, depth)


def joined_bodies(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text of bodies with a separator after each, where each begins, whose each byte is, which bytes start windows."""
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    sizes = np.array([len(b) + 1 for b in bodies])
    begins = np.cumsum(sizes) - sizes
    starts = np.arange(len(text)) - np.repeat(begins, sizes) < np.repeat(np.maximum(sizes - window, 0), sizes)
    return text, begins, np.repeat(np.arange(len(bodies)), sizes), starts


def windows_in_order(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of bodies and the places of all their windows in the order of its suffix array.

    Equal bodies are sorted once: a copy's windows stand behind those of the body that they repeat.
    """
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(b, len(number)) for b in bodies])
    text, begins, owner, starts = joined_bodies(list(number), window)
    order = suffix_array(text, window, starts)
    order = order[starts[order]]  # without those that only induce
    if len(number) == len(bodies):
        return text, order
    body = owner[order]
    offset = order - begins[body]
    text, begins, _, _ = joined_bodies(bodies, window)
    copies = np.bincount(same)
    begins = begins[np.argsort(same, kind="stable")]
    count = copies[body]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return text, begins[np.repeat((np.cumsum(copies) - copies)[body], count) + nth] + np.repeat(offset, count)


def repeated_windows(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that start anywhere else in the bodies: number of the body, first and last window.

    No window holds a separator, so neither does what two of them have in common.
    """
    text, order = windows_in_order(bodies, window)
    hit = common_prefixes(text, order, window) >= window
    twice = np.zeros(len(text), bool)
    twice[order[hit | np.r_[hit[1:], False]]] = True
    first, last = runs(twice)
    sizes = np.array([len(b) + 1 for b in bodies])
    begins = np.cumsum(sizes) - sizes
    body = np.searchsorted(begins, first, "right") - 1
    return body, first - begins[body], last - begins[body]


def keep_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def search_keys(bodies: DataFrame, window: int) -> DataFrame:
    """CLASS, part, a, b: the runs of windows of bodies that also start elsewhere in their keys' bodies."""
    names = [*CLASS, "part"]

    def search(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        body, a, b = repeated_windows(rows.column("body").to_pylist(), window)
        return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks().take(pa.array(body)) for k in names), pa.array(a), pa.array(b)], [*names, "a", "b"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if size > ARRAY_BYTES and key[-1] != last:
                cut = int(np.argmax(key != last))
                yield search([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("body"))).as_py()
            last = key[-1]
        if held:
            yield search(held)

    return arrow_map(bodies.repartition("key").sortWithinPartitions("key").select(*names, "body"), run, "key long, ctx1 long, ctx2 long, part int, a long, b long")


def row_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] = ("row1", "row2")) -> DataFrame:
    """docs with row1 (the id, 0 where it is null) and row2 (a hash of the text and of whether there is an id), or as names says.

    Rows equal in id and text share both, and so do their results.
    """
    return docs.withColumn(names[0], F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long"))).withColumn(names[1], F.xxhash64(text, F.col(doc_id).isNull()))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(row1, row2, spans) for docs(row1, row2, text): the byte spans to remove, half-open, not yet merged."""
    return removed_spans(docs, window, gram, hot_contexts, byte_symbols, byte_cut, search_keys, in_order=False)


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, spans (maximal removed byte spans, half-open), kept.

    Every byte covered by a `window`-byte string that also starts anywhere else, in the same text too, is removed;
    strings are judged on the input. Null texts count as empty, and texts under `window` bytes lose nothing. Repeated
    rows are repeats of each other, so both lose all they can; null ids do not matter. Cuts may fall inside a character:
    kept is binary. Other columns of docs are ignored. Strings are compared byte by byte, but members of a class of three
    or more contexts count as equal by 128-bit hashes, and rows that share an id by 64-bit hashes of their texts.
    """
    rows = row_ids(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    spans = duplicate_spans(rows, window, gram, hot_contexts)
    joined = rows.join(spans, ["row1", "row2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            doc, text, spans = (batch.column(k) for k in ("doc_id", "text", "spans"))
            for begin in range(0, batch.num_rows, 1000):
                sizes, cuts, kept = [], [], []
                for i in range(begin, min(begin + 1000, batch.num_rows)):
                    data = text[i].as_buffer().to_pybytes()
                    cut = merged([(x["a"], x["b"]) for x in spans[i].as_py() or ()])
                    sizes.append(len(data))
                    cuts.append([{"a": a, "b": b} for a, b in cut])
                    kept.append(keep_bytes(data, cut))
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(begin, 1000), pa.array(sizes, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return arrow_map(joined, run, "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = suffix_array_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The contract by a dictionary of all windows, for tests on small inputs with unique ids."""
    seen: dict[bytes, int] = {}
    texts = {d: (t or "").encode() for d, t in rows}
    for t in texts.values():
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = {}
    for d, t in texts.items():
        cut = merged([(i, i + window) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1])
        out[d] = (len(t), sum(b - a for a, b in cut), len(cut), hashlib.sha256(keep_bytes(t, cut)).hexdigest())
    return out
