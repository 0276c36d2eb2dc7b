"""Best-fit packing of tokenised documents by Best-two-fit, on counts of lengths.

Documents of one length are interchangeable, so bins are found on the table of how many pieces have each length, which
has at most `capacity` rows however large the corpus: a bin is opened by the longest piece, filled greedily with the
longest piece that fits, and then its smallest piece is replaced by two unpacked pieces if they fit the expanded gap
more tightly. The bin is repeated as often as the counts allow. Pieces then take the places of their length by rank,
and ranks come from counts of (length, bucket) and row numbers within them, so no task holds all pieces of a length.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, row_key, stored, table

CAPACITY = 2048
#: The id after every document.
END = 0
#: Runs of white space from this length on are cut out of a text before its words are matched.
LONG_SPACE = 1000
PIECES = "rid binary, doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def byte_bpe(path: str | None = None):
    """An encoder from text to an array of ids. path: the vocabulary as base64 tokens and ranks; None: the public one.

    The special token in a text is one id, as in the tokenizers library. In a run of white space all but the last character
    are one word, all at the end of a text or before the special token; matching very long ones step by step would run
    out of stack, so they are cut out here and encoded as the words that they are.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    word = tiktoken.Encoding("byte_bpe_word", pat_str="[\\s\\S]+", mergeable_ranks=ranks, special_tokens={})
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    long_space = re.compile(f"[{space}]{{{LONG_SPACE},}}")

    def encode(text):
        out, at = [], 0
        for run in long_space.finditer(text):
            stop = run.end() if run.end() == len(text) or text.startswith(SPECIAL, run.end()) else run.end() - 1
            out += [own.encode_to_numpy(text[at : run.start()], allowed_special="all"), word.encode_to_numpy(text[run.start() : stop])]
            at = stop
        rest = own.encode_to_numpy(text[at:], allowed_special="all")
        return np.concatenate([*out, rest]) if out else rest

    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, capacity: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """PIECES rows (and ids) of docs(rid, doc_id, text)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        encode = byte_bpe(vocabulary)
        for batch in batches:
            rid, doc = batch.column("rid"), batch.column("doc_id")
            rows, out, held = [], [], 0

            def flush():
                index = pa.array(rows, pa.int64())
                cols = [rid.take(index), doc.take(index), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([r[4] for r in out], pa.list_(pa.int32()))], [*names, "ids"]
                return pa.RecordBatch.from_arrays(cols, names)

            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append(i)
                    out.append((piece, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                held += len(ids) if with_ids else 1
                if held > 1_000_000:
                    yield flush()
                    rows, out, held = [], [], 0
            if out:
                yield flush()

    return arrow_map(docs.select("rid", "doc_id", "text"), run, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] pieces: (how often, [(length, pieces of it)...]) with lengths of a bin descending."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []

    def longest(limit):
        """The longest unpacked length up to limit, or 0."""
        hit = np.flatnonzero(left[: limit + 1])
        return int(hit[-1]) if len(hit) else 0

    def best_two(room):
        """The two unpacked lengths with the largest sum up to room, or None."""
        have = np.flatnonzero(left[: room + 1])
        at = np.searchsorted(have, room - have, "right") - 1
        sums = np.where(at >= 0, have + have[at], 0)
        alone = (at >= 0) & (have[at] == have) & (left[have] < 2)
        sums[alone] = np.where(at[alone] > 0, have[alone] + have[at[alone] - 1], 0)
        if not len(sums) or sums.max() == 0:
            return None
        a = int(np.argmax(sums))
        return int(have[a]), int(sums[a] - have[a])

    while (top := longest(capacity)) > 0:
        left[top] -= 1
        used, gap = [top], capacity - top
        while gap and (x := longest(gap)):
            take = min(int(left[x]), gap // x)
            left[x] -= take
            used += [x] * take
            gap -= take * x
        if gap and len(used) > 1:
            least = used[-1]
            left[least] += 1
            two = best_two(gap + least)
            if two and sum(two) > least:
                used[-1:] = two
                gap += least - sum(two)
            else:
                two = (least,)
            for x in two:
                left[x] -= 1
        parts = [(x, used.count(x)) for x in sorted(set(used), reverse=True)]
        more = min(int(left[x]) // n for x, n in parts)
        for x, n in parts:
            left[x] -= more * n
        bins.append((1 + more, parts))
    return bins


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where pieces stand by (length, rank): sorted columns length, rank (first), sequence (first), each, offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for often, parts in bins:
        offset = 0
        for length, each in parts:
            rows.append((length, rank.get(length, 0), sequence, each, offset))
            rank[length] = rank.get(length, 0) + often * each
            offset += length * each
        sequence += often
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "each", "offset"))}


def placed(ranked: DataFrame, where: dict[str, np.ndarray]) -> DataFrame:
    """ranked(..., length, rank) with sequence_id and offset."""
    sent = ranked.sparkSession.sparkContext.broadcast(where)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)

    def run(batches):
        t = sent.value
        first = np.searchsorted(t["length"], np.arange(t["length"].max() + 2 if len(t["length"]) else 1))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = slice(first[x], first[x + 1])
                at[length == x] = first[x] + np.searchsorted(t["rank"][own], rank[length == x], "right") - 1
            over = rank - t["rank"][at]
            sequence, offset = t["sequence"][at] + over // t["each"][at], t["offset"][at] + over % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    return arrow_map(ranked, run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its byte-level BPE ids and the id 0; only those longer than `capacity` are cut, and only their first
    piece may be shorter. Null texts count as empty: one token. Every row is packed, repeated ones, those with a null
    doc_id and very long runs of white space as well; an empty table gives no rows. The driver sees the count of each length and nothing else. Other
    columns of docs are ignored.
    """
    rows = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", row_key())
    pieces = stored(tokenised(rows, capacity, vocabulary, with_ids))
    # As many buckets as pieces in each, about: then neither ranking within buckets nor adding up their sizes is long.
    buckets = max(1, math.isqrt(pieces.count()))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), F.lit(buckets)).cast("int"))
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    where = places(best_two_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", (F.col("own") + F.col("before")).cast("long"))
    extra = ["ids"] if with_ids else []
    out = placed(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *extra, "rank"), where)
    return out.drop("rank")


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the documents and their places."""
    return pack(docs)
