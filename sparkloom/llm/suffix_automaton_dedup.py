"""Substring dedup by suffix automata of reference shards.

A window of 50 words goes if its words also start in a document with a smaller id. A shard's reference passages are
the contexts of an anchor key (see anchors.py), and passages are streamed through the shard's suffix automaton in the
order of their documents' ids: matching statistics give, at every word, the longest match with any earlier document, and
maximal spans of matches over the threshold are removed; then the passage joins the automaton. A plain broadcast of
the automata would grow with the corpus and meet every document with every shard, so passages are routed to shards by
their anchor key instead: equal windows share it, so each passage meets all the references it can match and no others.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .anchors import CHUNK, CLASS, merged, removed_spans
from .common import arrow_map, row_key, table, text_bytes, told_apart
from .suffix_array_dedup import row_ids

WINDOW = 50
GRAM = 8
#: Classes of one key that one automaton takes; keys with more are cut into single windows.
HOT_CONTEXTS = 400
#: Different words a task remembers the hashes of.
CACHED_WORDS = 200_000
_SPACE = re.compile(rb"[\t-\r ]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when it holds too many."""

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_symbols():
    """A function from UTF-8 bytes to arrays of the hashes of their words (runs of other than white space in ASCII).

    One array stands for the words of about CHUNK bytes, so that the words of a long text are not held at once.
    """
    known = WordHashes()

    def to_symbols(data):
        at = 0
        while at < len(data):
            stop = at + CHUNK
            if stop < len(data):
                space = _SPACE.search(data, stop)
                stop = space.start() if space else len(data)
            words = bytes(data[at:stop]).split()
            yield np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            at = stop

    return to_symbols


def word_cut():
    """A function from UTF-8 bytes to a function from (start, stop) in words to the bytes from the first to the last."""

    def of(data):
        space = _IS_SPACE[np.frombuffer(data, np.uint8)] if len(data) else np.empty(0, bool)
        edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
        view = memoryview(data)
        return lambda a, b: bytes(view[edges[2 * a] : edges[2 * b - 1]])

    return of


class SuffixAutomaton:
    """A generalised suffix automaton over integers, grown passage by passage."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, passage: list[int]) -> None:
        last = 0
        for symbol in passage:
            last = self._extend(last, symbol)

    def _clone(self, p: int, q: int, symbol: int) -> int:
        c = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # another passage went this way
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return new

    def matches(self, passage: list[int]) -> list[int]:
        """At each symbol the length of the longest substring of an added passage that ends there."""
        out, state, size = [], 0, 0
        step, link, length = self.next, self.link, self.length
        for symbol in passage:
            while state and symbol not in step[state]:
                state = link[state]
                size = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                size += 1
            out.append(size)
        return out


def search_shards(bodies: DataFrame, window: int) -> DataFrame:
    """CLASS, part, a, b: runs of windows of bodies that start in a body of their key from a smaller document."""
    names = [*CLASS, "part"]

    def key_runs(rows):
        rows.sort()
        auto, waiting, doc, number = SuffixAutomaton(), [], None, {}
        for row1, name, body in rows:
            if row1 != doc:
                for p in waiting:
                    auto.add(p)
                waiting, doc = [], row1
            words = [number.setdefault(w, len(number)) for w in body.split()]
            if len(auto.next) > 1:
                start = None
                for end, size in enumerate([*auto.matches(words), 0]):
                    if size >= window and start is None:
                        start = end - window + 1
                    elif size < window and start is not None:
                        yield (*name, start, end - window)
                        start = None
            waiting.append(words)

    def run(batches):
        rows, last, out = [], None, []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i == 3 else pa.int64()) for i in range(6)], [*names, "a", "b"])

        for batch in batches:
            for *name, row1, body in zip(*(batch.column(k).to_pylist() for k in (*names, "row1", "body")), strict=True):
                if name[0] != last:
                    out += key_runs(rows)
                    rows, last = [], name[0]
                    if len(out) > 50_000:
                        yield batch_of()
                        out.clear()
                rows.append((row1, tuple(name), body))
        out += key_runs(rows)
        if out:
            yield batch_of()

    return arrow_map(bodies.repartition("key").sortWithinPartitions("key").select(*names, "row1", "body"), run, "key long, ctx1 long, ctx2 long, part int, a long, b long")


def earlier_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(row1, row2, spans) for docs(row1, row2, text): word spans to remove, half-open, not yet merged; row1 is the order."""
    return removed_spans(docs, window, gram, hot_contexts, word_symbols, word_cut, search_shards, in_order=True)


def keep_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def suffix_automaton_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row per row of docs(doc_id, text): rid, doc_id, n_words, n_removed, spans (removed word spans), kept (text).

    Words are runs of characters other than space and \\x09-\\x0D. Each word covered by a window of `window` words
    that also starts in a row with a smaller doc_id is removed; windows are judged on the input. kept has the other
    words joined by one space. Rows with a null doc_id, null text or under `window` words lose nothing, and rows that
    share a doc_id do not remove from each other. Other columns of docs are ignored. Windows are compared word by word,
    but members of a class of three or more contexts count as equal by 128-bit hashes, and rows that share an id by
    64-bit hashes of their texts.
    """
    rows = row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    spans = earlier_spans(rows.filter("doc_id is not null"), window, gram, hot_contexts)
    joined = rows.join(spans, ["row1", "row2"], "left").select(row_key().alias("rid"), "doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            rid, doc, text, spans = (batch.column(k) for k in ("rid", "doc_id", "text", "spans"))
            for begin in range(0, batch.num_rows, 1000):
                total, removed, cuts, kept = [], [], [], []
                for i in range(begin, min(begin + 1000, batch.num_rows)):
                    words = text[i].as_buffer().to_pybytes().split()
                    cut = merged([(x["a"], x["b"]) for x in spans[i].as_py() or ()])
                    left = keep_words(words, cut)
                    total.append(len(words))
                    removed.append(len(words) - len(left))
                    cuts.append([{"a": a, "b": b} for a, b in cut])
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays(
                    [rid.slice(begin, 1000), doc.slice(begin, 1000), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.string())],
                    ["rid", "doc_id", "n_words", "n_removed", "spans", "kept"],
                )

    return arrow_map(joined, run, "rid binary, doc_id long, n_words long, n_removed long, spans array<struct<a:long,b:long>>, kept string")


def op7_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = suffix_automaton_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents with the words that remain; texts that lose nothing stay as they are.

    Of the texts only those move to their spans that may have some.
    """
    plain = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text", F.coalesce("text", F.lit("")))
    ids = ["__row1", "__row2"]
    rows = row_ids(plain.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"))).filter("doc_id is not null")
    spans = earlier_spans(rows).toDF(*ids, "__spans")
    clear, held = told_apart(row_ids(plain, "__id", "__text", tuple(ids)).drop("__id", "__text"), ids, spans)

    def run(batches):
        for batch in batches:
            text, spans = (batch.column(k) for k in ("text", "__spans"))
            kept = []
            for i in range(batch.num_rows):
                cut = merged([(x["a"], x["b"]) for x in spans[i].as_py() or ()])
                kept.append(b" ".join(keep_words(text_bytes(text, i).split(), cut)) if cut else text_bytes(text, i) if text[i].is_valid else None)
            columns = {**dict(zip(batch.schema.names, batch.columns, strict=True)), "text": pa.array(kept, pa.binary()).view(pa.string()), "__spans": spans.is_valid()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    names = [*docs.columns, "__spans"]
    done = arrow_map(held.join(spans, ids, "left").select(*names), run, StructType([*docs.schema.fields, StructField("__spans", BooleanType())]))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__spans"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clear.select(*docs.columns).unionAll(done.select(*docs.columns))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract by a dictionary of all windows, for tests on small inputs with unique ids."""
    least: dict[tuple, int] = {}
    texts = {d: (t or "").encode().split() for d, t in rows}
    for d, w in texts.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = {}
    for d, w in texts.items():
        cut = merged([(i, i + window) for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d])
        out[d] = (len(w), sum(b - a for a, b in cut), hashlib.sha256(b" ".join(keep_words(w, cut))).hexdigest())
    return out
