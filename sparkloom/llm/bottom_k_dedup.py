"""MinHash near-dedup by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; documents with equal sets form one class. A
class keeps the `k` smallest hashes of its set. Inverted lists are keyed by runs of three consecutive retained values:
similar sets share long stretches of the hash order, while sets that only share a common passage rarely do. Of the
runs of larger sets only those are used whose own hash is divisible by 3 or 6. Candidates come from the lists in
two rounds. First every member of a list meets the list's smallest member, its hub, only, so a group of n near copies
costs n rows, not n * n. Then only hubs whose members still lie in different components have their members compared in
full, a block against a block at a time, by the union-sketch estimate; what goes on from there is members with a likely
partner, not pairs. Every link is verified by the exact Jaccard similarity of the full sets.

Misses: a list or the estimate might miss a pair of sets with over SMALL shingles. Of 160,000 random pairs just at the
thresholds 0.85 and 0.8, of 76 to 4,000 shingles, all had a list in common and none was rejected by the estimate, which allows
five standard deviations. Full sets are compared by 64-bit hashes of their shingles, pair by pair.
All runs of sets with up to SMALL shingles are kept, and their similarity is exact from the start. Sets so small that
one value between them may leave no three in a row (4 and 5 shingles at 0.8) also key lists by runs of two. So pairs of
sets with up to SMALL shingles are not missed at thresholds over 2/3.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Ranges, mix, powers
from .common import arrow_map, components, discard, row_key, stored, table, text_bytes, told_apart
from .suffix_automaton_dedup import word_symbols

SHINGLE = 5
K = 128
#: Retained values in a list's key.
RUN = 3
#: Shingles up to which all runs of a set key lists, and up to which one in three does; one in six beyond.
SMALL, MIDDLE = 75, 256
#: Members of a block that one task compares, and of a part of it that one matrix holds.
BLOCK, PART = 1024, 256
SKETCH_SCHEMA = "rid binary, doc_id long, n long, cls binary, sketch array<long>"
#: Symbols hashed at once.
PIECE = 1 << 20
#: Bits, as a power of two, of the filter that says whose texts are to be hashed again: 1 MB.
MARK_BITS = 23


def shingle_hashes(symbols: np.ndarray, shingle: int, power) -> np.ndarray:
    """The sorted distinct hashes of the shingles of hashed words; a shorter sequence is one shingle, none gives none."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < shingle:
        return mix(Ranges(symbols, power).of(np.array([0]), np.array([n])) + np.uint64(n))
    parts = []
    for begin in range(0, n - shingle + 1, PIECE):
        part = symbols[begin : begin + PIECE + shingle - 1]
        start = np.arange(len(part) - shingle + 1)
        parts.append(np.unique(Ranges(part, power).of(start, start + shingle)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def marks_of(rids: DataFrame) -> np.ndarray:
    """A filter of 2 ** MARK_BITS bits, whatever the number of rids: a bit is set for each, by its leading bits."""
    at = F.shiftright(F.conv(F.hex(F.substring("rid", 1, 3)), 16, 10).cast("long"), 24 - MARK_BITS)
    words = rids.select(F.shiftright(at, 6).cast("int").alias("word"), at.alias("at"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def marked(rid: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Whether the bit of each rid is set."""
    lead = np.array([int.from_bytes(x[:3], "big") for x in rid.to_pylist()], np.int64) >> (24 - MARK_BITS)
    return (marks[lead >> 6] >> (lead & 63) & 1).astype(bool)


def hashed_sets(docs: DataFrame, shingle: int, k: int | None, marks: np.ndarray | None = None) -> DataFrame:
    """SKETCH_SCHEMA rows of docs(rid, doc_id, text), with the k smallest hashes, or with all where k is None; only of marked rids."""

    def run(batches):
        to_symbols, power = word_symbols(), powers(PIECE + shingle)
        for batch in batches:
            if marks is not None:
                batch = batch.filter(pa.array(marked(batch.column("rid"), marks), pa.bool_()))
            rid, doc, text = (batch.column(c) for c in ("rid", "doc_id", "text"))
            begin, sizes, classes, values = 0, [], [], []

            def flush(stop):
                offsets = pa.array(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32))
                flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int64))
                return pa.RecordBatch.from_arrays(
                    [rid.slice(begin, stop - begin), doc.slice(begin, stop - begin), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                    ["rid", "doc_id", "n", "cls", "sketch"],
                )

            held = 0
            for i in range(batch.num_rows):
                symbols = np.concatenate([np.empty(0, np.uint64), *to_symbols(text_bytes(text, i).lower())])
                full = np.sort(shingle_hashes(symbols, shingle, power).view(np.int64))
                sizes.append(len(full))
                classes.append(hashlib.blake2b(full.tobytes(), digest_size=16).digest())
                values.append(full if k is None else full[:k])
                held += len(values[-1])
                if held > 1_000_000:
                    yield flush(i + 1)
                    begin, sizes, classes, values, held = i + 1, [], [], [], 0
            if sizes:
                yield flush(batch.num_rows)

    return arrow_map(docs.select("rid", "doc_id", "text"), run, SKETCH_SCHEMA)


def ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, so that it is compared exactly."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def shortest(threshold: float) -> int:
    """Shingles up to which similar sets may share values and yet no run of three in a row, or 0.

    With d values in one set only and i in both, d + 1 stretches share the i; none holds three if i <= 2 * (d + 1), and
    i >= d * t / (1 - t). So d <= 2 * (1 - t) / (3 * t - 2), and no set is larger than i + d. Two in a row always remain.
    """
    num, den = ratio(threshold)
    if 3 * num <= 2 * den:
        return SMALL
    d = 2 * (den - num) // (3 * num - 2 * den)
    return min(SMALL, 3 * d + 2) if d else 0


def inverted(classes: DataFrame, threshold: float) -> DataFrame:
    """key, cls, n of the runs of retained values that key a list.

    Small sets keep all their runs, larger ones those whose hash is divisible by 3 or by 6: nested choices, so that
    sets of different sizes meet in the runs that the larger one keeps. The shortest sets add their runs of two.
    """
    runs = lambda r: F.transform(F.sequence(F.lit(0), F.size("sketch") - r), lambda i: F.xxhash64(*[F.col("sketch")[i + j] for j in range(r)]))
    few = shortest(threshold)
    part = F.when(F.col("n") <= SMALL, 1).when(F.col("n") <= MIDDLE, 3).otherwise(6)
    kept = F.filter(runs(RUN), lambda x: F.pmod(x, part) == 0)
    if few:
        kept = F.when(F.col("n") > few, kept).when(F.size("sketch") >= RUN, F.concat(kept, runs(RUN - 1))).otherwise(runs(RUN - 1))
    return classes.filter(F.size("sketch") >= (RUN - 1 if few else RUN)).select(F.explode(kept).alias("key"), "cls", "n")


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """cls, n, full (all hashes) of the classes wanted, made anew from one of their texts.

    No text moves: the tasks that read the texts hash those whose rid is marked in a filter of a fixed size. What others the
    filter lets through, few unless some millions are wanted, is left out by its class.
    """
    rids = wanted.join(classes.select("cls", "rid"), "cls").select("rid")
    sets = hashed_sets(docs, shingle, None, marks_of(rids)).select("cls", "n", F.col("sketch").alias("full")).dropDuplicates(["cls"])
    return stored(sets.join(wanted.select("cls").distinct(), "cls", "left_semi"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The (a, b) of pairs whose union sketch doesn't rule them out and whose full sets are similar enough."""
    size = lambda name: classes.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"))
    sketch = lambda name: classes.select(F.col("cls").alias(name), F.col("sketch").alias(f"s{name}"))
    num, den = ratio(threshold)
    # Sizes alone rule most pairs out; only the others take sketches along.
    sized = pairs.join(size("a"), "a").join(size("b"), "b").filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    both = sized.join(sketch("b"), "b").join(sketch("a"), "a")
    last = F.least(F.element_at("sa", -1), F.element_at("sb", -1))
    # Below the smaller of the last retained values both sketches are whole: a fair sample of the union.
    cut = F.when(F.col("na") > F.size("sa"), F.when(F.col("nb") > F.size("sb"), last).otherwise(F.element_at("sa", -1))).when(F.col("nb") > F.size("sb"), F.element_at("sb", -1))
    sampled = lambda s: F.when(F.col("last").isNull(), F.size(s)).otherwise(F.size(F.filter(s, lambda x: x <= F.col("last"))))
    est = both.withColumn("last", cut).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    est = est.withColumn("union", sampled("sa") + sampled("sb") - F.col("shared"))
    slack = F.when(F.col("last").isNull(), F.lit(0.0)).otherwise(5 * F.sqrt(F.col("union") * (threshold * (1 - threshold))))
    likely = stored(est.filter(F.col("shared") * den + slack * den >= num * F.col("union")).select("a", "b"))
    rows = likely.select(F.col("a").alias("cls")).unionAll(likely.select(F.col("b").alias("cls"))).distinct()
    sets = full_sets(rows, classes, docs, shingle)
    side = lambda name: sets.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col("full").alias(f"s{name}"))
    inter = F.size(F.array_intersect("sa", "sb"))
    out = stored(likely.join(side("a"), "a").join(side("b"), "b").withColumn("i", inter).filter(den * F.col("i") >= num * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"))
    discard(sets)
    return out


def similar_in(rows: list[tuple], threshold: float):
    """Pairs, as two arrays of places, of rows (cls, n, comp, side, sketch) of different components that may be similar.

    With two sides, a pair has one row of each. Rows are compared a part of the block at a time. Where both sketches are
    whole sets, the similarity is exact and a pair is certain.
    """
    num, den = ratio(threshold)
    n = np.array([r[1] for r in rows])
    comp = np.unique([r[2] for r in rows], return_inverse=True)[1]
    side = np.array([r[3] for r in rows])
    sizes = np.array([len(r[4]) for r in rows])
    last = np.array([r[4][-1] if len(r[4]) < r[1] else np.iinfo(np.int64).max for r in rows])
    flat = np.concatenate([r[4] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    value, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    often = count[value] > 1
    flat_at, flat_owner = value[often], owner[often]
    two = side.min() != side.max()
    order = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)] if two else [np.arange(len(rows))] * 2
    parts = [[o[i : i + PART] for i in range(0, len(o), PART)] for o in order]
    for pi, p in enumerate(parts[0]):
        for qi, q in enumerate(parts[1]):
            if not two and qi < pi:
                continue
            ok = (comp[p][:, None] != comp[q][None, :]) & (den * np.minimum(n[p][:, None], n[q][None, :]) >= num * np.maximum(n[p][:, None], n[q][None, :]))
            if not two and pi == qi:
                ok = np.triu(ok, 1)
            if not ok.any():
                continue
            marks = []
            have = np.intersect1d(flat_at[np.isin(flat_owner, p)], flat_at[np.isin(flat_owner, q)])
            for rows_of in (p, q):
                m = np.zeros((len(rows_of), len(have)), np.float32)
                for i, r in enumerate(rows_of):
                    m[i, np.searchsorted(have, np.intersect1d(have, flat_at[flat_owner == r]))] = 1
                marks.append(m)
            shared = marks[0] @ marks[1].T
            cut = np.minimum(last[p][:, None], last[q][None, :])
            union = -shared
            for at, (rows_of, cuts) in enumerate(((p, cut), (q, cut.T))):
                upto = np.array([np.searchsorted(rows[r][4], c, "right") for r, c in zip(rows_of, cuts, strict=True)], np.float32)
                union = union + (upto if at == 0 else upto.T)
            exact = cut == np.iinfo(np.int64).max
            slack = np.where(exact, 0, 5 * np.sqrt(np.maximum(union, 0) * (threshold * (1 - threshold))))
            i, j = np.nonzero(ok & ((shared + slack) * den >= num * union))
            if len(i):
                yield p[i], q[j]


def forest(pairs: list, size: int) -> np.ndarray:
    """For each of `size` places the least one reached from it by pairs of arrays of places."""
    root = np.arange(size)
    if pairs:
        a, b = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
        while True:
            old = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == old).all():
                break
    return root


def compared(rows: DataFrame, threshold: float, links: bool) -> DataFrame:
    """rows(a, x, y, cls, n, comp, side, sketch) compared within each (a, x, y).

    links: (src, dst) of a spanning forest of the similar pairs; else the rows, without sketch, that have a pair.
    """
    names = ["a", "x", "y", "cls", "n", "comp", "side"]

    def run(batches):
        group, last, out = [], None, []

        def settle():
            pairs = list(similar_in([(*r[3:], v) for r, v in group], threshold))
            if links:
                root = forest(pairs, len(group))
                out.extend((group[i][0][3], group[r][0][3]) for i, r in enumerate(root) if i != r)
            elif pairs:
                out.extend(group[i][0] for i in np.unique(np.concatenate([np.concatenate(p) for p in pairs])))

        def batch_of():
            if links:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["src", "dst"])
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            sketches = batch.column("sketch")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if row[:3] != last:
                    if len(group) > 1:
                        settle()
                    group, last = [], row[:3]
                    if len(out) > 50_000:
                        yield batch_of()
                        out = []
                group.append((row, sketches[i].values.to_numpy()))
        if len(group) > 1:
            settle()
        if out:
            yield batch_of()

    spread = rows.select(*names, "sketch").repartition("a", "x", "y").sortWithinPartitions("a", "x", "y")
    return arrow_map(spread, run, "src binary, dst binary" if links else "a binary, x int, y int, cls binary, n long, comp binary, side int")


def cross_links(groups: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (src, dst) between classes that share a hub and lie in different components, as spanning forests.

    groups: a (the hub), cls, n, comp, of the hubs with members in more than one component. Blocks of members are
    compared by sketches first; the members that may have a partner are compared again by their full sets. What moves
    is members, each once for every other block, never pairs.
    """
    sized = groups.join(groups.groupBy("a").agg(F.count("*").alias("members")), "a")
    blocks = sized.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(7)), "blocks").cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = blocks.withColumn("other", F.explode(other)).select(
        "a", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "cls", "n", "comp", (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    likely = stored(compared(met.join(classes.select("cls", "sketch"), "cls"), threshold, links=False))
    sets = full_sets(likely.select("cls").distinct(), classes, docs, shingle)
    return stored(compared(likely.join(sets.select("cls", F.col("full").alias("sketch")), "cls"), threshold, links=True))


def grouped(docs: DataFrame, threshold: float, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """rid, doc_id, n, component (null for texts without words), component_id of every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", row_key())
    full = stored(hashed_sets(rows, shingle, k))
    classes = stored(full.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct("rid", "n", "sketch")).alias("one")).select("cls", "least", "one.*"))
    sketched = stored(full.drop("sketch"))
    discard(full)
    lists = inverted(classes, threshold)
    hubs = lists.groupBy("key").agg(F.min("cls").alias("a"), F.count("*").alias("c")).filter("c > 1").select("key", "a")
    shared = stored(lists.join(hubs, "key").select("a", "cls", "n").distinct())
    near = shared.filter("a <> cls").select("a", F.col("cls").alias("b"))
    links = confirmed(near, classes, rows, shingle, threshold)
    near_groups = stored(components(links.toDF("src", "dst")))
    known = shared.join(near_groups.withColumnRenamed("node", "cls"), "cls", "left").select("a", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    apart = known.groupBy("a").agg((F.min("comp") != F.max("comp")).alias("apart"), F.count("*").alias("members")).filter("apart and members > 2").select("a")
    more = cross_links(stored(known.join(apart, "a").filter("a <> cls")), classes, rows, shingle, threshold)
    groups = components(near_groups.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionAll(more))
    discard(shared, links, near_groups, more)
    named = classes.select("cls", "least").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select("cls", "component", "component_id")
    out = sketched.select("rid", "doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(found, "cls", "left")
    return out.select("rid", "doc_id", "n", "component", "component_id")


def bottom_k_dedup(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """One row per row of docs(doc_id, text): rid, doc_id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z and cut into words at space and \\x09-\\x0D. Rows whose sets of `shingle`-word
    shingles have a Jaccard similarity of `threshold` or more are linked; component_id is the smallest doc_id reachable.
    Fewer words than `shingle` count as one shingle; null, empty and blank texts have none and link with nothing, so
    they are their own component. Rows with equal sets always link, repeated rows too. A row with a null doc_id links
    like any other but never names a component while another can; where all ids are null, component_id is null and
    the rows are kept. kept: doc_id equals component_id. Other columns of docs are ignored.
    """
    out = grouped(docs, threshold, shingle, k)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document at a similarity of 0.85."""
    return bottom_k_dedup(table(spark, sf_dir, "documents"), threshold=0.85).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, one with the smallest id; rows without words all stay.

    Of rows equal in id and text one stays; where all ids of a group are null, one of its rows stays too. Of the texts only
    those move that may go or be repeated.
    """
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__rid", row_key("__id"))
    worded = stored(grouped(docs, 0.8).filter("n > 0").groupBy(F.col("rid").alias("__rid")).agg(F.min("doc_id").alias("doc_id"), F.min("component").alias("component"), F.count("*").alias("copies")))
    first = worded.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__rid"))["__rid"].alias("first"))
    gone = worded.join(first, "component").select("__rid", (F.col("__rid") != F.col("first")).alias("gone"), "copies")
    gone = stored(gone.filter("gone or copies > 1"))
    repeated = gone.filter("not gone")
    clear, held = told_apart(keyed, ["__rid"], gone)
    once = clear.select(*docs.columns).unionAll(held.join(gone, "__rid", "left_anti").select(*docs.columns))
    again = told_apart(keyed, ["__rid"], repeated)[1].join(repeated, "__rid", "left_semi").dropDuplicates(["__rid"])
    return once.unionAll(again.select(*docs.columns))


def brute_force(rows: list[tuple[int, str | None]], threshold: float, shingle: int = SHINGLE) -> dict[int, tuple[int, int, bool]]:
    """The contract by all pairs, for tests on small inputs with unique ids."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    num, den = ratio(threshold)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
