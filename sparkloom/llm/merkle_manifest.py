"""Merkle dataset manifest with parent-preimage paths.

Every row of a dataset is a leaf; the leaves of a tree, in order, are hashed together two by two until one node, the
subroot, is left, and the subroots of all trees likewise give the root. What is stored are the parents' preimages: the
concatenated hashes of their children. A leaf joins the preimages of its ancestors: without the leaf's own slot of 64
characters a preimage gives its siblings, and with another hash spliced into that slot it gives the parent that a changed leaf
would have, so a fold of the path tells whether a row is still the one that was registered.

Leaves are numbered by one range-partitioned sort. LEVELS levels are built at a time, a block of 2 ** LEVELS nodes in
a group, so no tree, however large, meets in one task; a row joins its block's preimages and those above its block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, stored, table

#: Levels that one group of nodes builds.
LEVELS = 10
#: Characters of a hash as text.
SLOT = 64
#: Levels above the subroots are numbered from here; no tree is so high.
TOP = 1000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row: each field's UTF-8 byte count, a colon and its value; - for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(nodes: DataFrame, by: list[Column]) -> DataFrame:
    """nodes(tree, ...), stored, with `at`, a row's place within its tree in the order of `by`, from 0, and `size`, the rows of its tree.

    nodes must be a stored table. Rows are sorted over range partitions and written once with their partition and place in
    it, so that what counts the rows and what numbers them reads the same layout.
    """
    order = [F.col("tree"), *by]
    placed = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    spans = placed.groupBy("tree", "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    tree = Window.partitionBy("tree")
    spans = spans.select("tree", "__part", "__first", (F.sum("__n").over(tree.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(tree).alias("size"))
    out = placed.join(spans, ["tree", "__part"]).withColumn("at", F.col("__row") - F.col("__first") + F.col("__before"))
    out = stored(out.drop("__part", "__row", "__first", "__before"))
    discard(placed)
    return out


def all_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def preimages(nodes: DataFrame, done: int, levels: int) -> DataFrame:
    """tree, block, level, at, preimage, last, size of the parents up to `levels` levels above nodes(tree, at, size, hash).

    nodes stand on level `done`, where their tree has `size` of them. at: the parent's place on its level of the tree; last:
    whether it is the highest of its block.
    """

    def run(key, group):
        block, n = key[1].as_py(), group["size"][0].as_py()
        top, nodes = min(levels, (n - 1).bit_length()), dict(zip(group["at"].to_pylist(), group["hash"].to_pylist(), strict=True))
        row, out = [nodes[at] for at in sorted(nodes)], []
        for level in range(1, top + 1):
            pairs = ["".join(row[i : i + 2]) for i in range(0, len(row), 2)]
            out += [(done + level, (block << levels >> level) + i, pair, level == top) for i, pair in enumerate(pairs)]
            row = [sha256(pair) for pair in pairs]
        level, at, pair, last = zip(*out, strict=True)
        same = [key[0].as_py()] * len(out), [block] * len(out), [n] * len(out)
        return pa.table([same[0], same[1], pa.array(level, pa.int32()), at, pair, last, same[2]], ["tree", "block", "level", "at", "preimage", "last", "size"])

    blocks = nodes.select("tree", "at", "size", "hash", F.shiftright("at", levels).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree string, block long, level int, at long, preimage string, last boolean, size long")


class Paths:
    """The preimages that the nodes of one block, on level `done`, have as ancestors."""

    def __init__(self, parents: pa.Table, done: int, levels: int):
        rows = list(zip(*(parents[c].to_pylist() for c in ("level", "at", "preimage")), strict=True))
        self.own = {(level - done, at): preimage for level, at, preimage in rows if level <= done + levels}
        self.depth, self.done = max((level for level, _ in self.own), default=0), done
        self.above = sorted(row for row in rows if row[0] > done + levels)

    def of(self, at: int) -> list[tuple[int, int, str]]:
        """level, slot and preimage of each ancestor, upwards; the slot is the child's."""
        return [(self.done + k, at >> (k - 1) & 1, self.own[k, at >> k]) for k in range(1, self.depth + 1)] + self.above


def siblings(path: list[tuple[int, int, str]]) -> str:
    """The hashes beside the path, upwards, concatenated: each preimage without the slot of the path's own hash."""
    return "".join(preimage[: slot * SLOT] + preimage[(slot + 1) * SLOT :] for _, slot, preimage in path)


def folded(leaf: str, path: list[tuple[int, int, str]]) -> str:
    """The root that the path gives for this leaf, its hashes spliced into the slots."""
    for _, slot, preimage in path:
        leaf = sha256(preimage[: slot * SLOT] + leaf + preimage[(slot + 1) * SLOT :])
    return leaf


class Forest:
    """Trees over nodes(tree, at, size, hash), a stored table: the stored preimages of each round of `levels` levels."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS, base: int = 0):
        self.levels, self.base, self.parents = levels, base, []
        self.rounds = [nodes.select("tree", "at", "size", "hash")]
        while not (many := self.rounds[-1].filter("size > 1")).isEmpty():
            found = stored(preimages(many, base + levels * len(self.parents), levels))
            self.parents.append(found)
            left = F.shiftright(F.col("size") + ((1 << levels) - 1), levels)
            self.rounds.append(found.filter("last").select("tree", F.col("block").alias("at"), left.alias("size"), F.sha2(F.col("preimage").cast("binary"), 256).alias("hash")))

    def roots(self) -> DataFrame:
        """tree, hash of the last node of each tree."""
        return all_of([r.filter("size = 1").select("tree", "hash") for r in self.rounds])

    def ancestors(self, above: DataFrame | None = None) -> DataFrame:
        """tree, block, level, at, preimage: for each block of leaves its own preimages, and those that all its leaves share.

        For the latter `at` is the slot, 0 or 1. above(tree, level, at, preimage): slots and preimages above the trees' roots.
        """
        out = None
        for k in range(len(self.rounds) - 1, -1, -1):
            parts = [out] if out is not None else []
            if above is not None:
                ended = self.rounds[k].filter("size = 1").select("tree")
                parts.append(above.join(ended, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("block"), "level", "at", "preimage"))
            if k < len(self.parents):
                parts.append(self.parents[k].select("tree", "block", "level", "at", "preimage"))
            out = all_of(parts) if parts else None
            if k and out is not None:
                out = self.carried(self.rounds[k], out, self.base + k * self.levels)
        return out

    def carried(self, nodes: DataFrame, ancestors: DataFrame, done: int) -> DataFrame:
        """The paths of nodes that are blocks of the round below, as rows that their leaves share."""
        levels = self.levels

        def run(key, group, parents):
            paths = Paths(parents, done, levels)
            rows = [(key[0].as_py(), at, *row) for at in group["at"].to_pylist() for row in paths.of(at)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["tree", "block", "level", "at", "preimage"])

        blocks = nodes.select("tree", "at", F.shiftright("at", levels).alias("block"))
        return blocks.groupBy("tree", "block").cogroup(ancestors.groupBy("tree", "block")).applyInArrow(run, "tree string, block long, level int, at long, preimage string")


def verified(leaves: DataFrame, ancestors: DataFrame, root: str, levels: int, keep: list[str]) -> DataFrame:
    """keep, leaf, subroot, root, proof_sha256, folded_root, verified of leaves(keep, tree, at, hash, changed) and their ancestors."""

    def run(key, group, parents):
        paths = Paths(parents, 0, levels)
        out: list[tuple] = []
        for at, leaf, changed in zip(*(group[c].to_pylist() for c in ("at", "hash", "changed")), strict=True):
            path = paths.of(at)
            tops = [preimage for level, _, preimage in path if level <= TOP]
            found = folded(changed or leaf, path)
            out.append((leaf, sha256(tops[-1]) if tops else leaf, root, sha256(siblings(path)), found, found == root))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        columns = zip(*out, strict=True) if out else [[]] * 6
        columns = [pa.array(c, pa.bool_() if name == "verified" else pa.string()) for c, name in zip(columns, names, strict=True)]
        return pa.table([*(group[c] for c in keep), *columns], [*keep, *names])

    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in keep)
    blocks = leaves.select(*keep, "tree", "at", "hash", "changed", F.shiftright("at", levels).alias("block"))
    schema = f"{kinds}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("tree", "block").cogroup(ancestors.groupBy("tree", "block")).applyInArrow(run, schema)


def merkle_manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs(doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    There is a tree for each lang, null among them, and its leaves ascend by doc_id, null first; rows of one id stand in the
    order of their hashes, and rows equal in all five columns take neighbouring places. `changed` says which rows to fold with
    1 more in n_chars, as if tampered with; null counts as no, and null n_chars stay null. A lone leaf is its tree's subroot, a lone
    subroot the root; a path without siblings has the hash of the empty text as its proof. No rows give no rows. Other
    columns are ignored. Texts are hashed whole where they are read; only hashes move.
    """
    fields = {c: F.col(c) for c in FIELDS}
    more = {**fields, "n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    other = F.when(changed, leaf_hash(*more.values())) if changed is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = stored(docs.select("doc_id", tree.alias("tree"), leaf_hash(*fields.values()).alias("hash"), other.alias("changed"), F.monotonically_increasing_id().alias("row")))
    nodes = numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")])
    discard(leaves)
    forest = Forest(nodes, levels)
    subroots = stored(forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"))
    subroots = numbered(subroots, [F.col("name")])
    top = Forest(subroots, levels, TOP)
    root = top.roots().first()
    if root is None:
        return docs.limit(0).select("doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    above = top.ancestors()
    if above is not None:
        names = subroots.select("tree", F.col("at").alias("place"), "name", F.shiftright("at", levels).alias("block"))
        above = paths_by_name(names, above, levels)
    ancestors = forest.ancestors(above)
    if ancestors is None:
        ancestors = nodes.limit(0).select("tree", F.lit(0).cast("long").alias("block"), F.lit(0).alias("level"), "at", F.col("hash").alias("preimage"))
    return verified(nodes, ancestors, root["hash"], levels, ["doc_id"])


def paths_by_name(names: DataFrame, ancestors: DataFrame, levels: int) -> DataFrame:
    """tree (the name), level, at (the slot), preimage of the path of each of names(tree, place, name, block)."""

    def run(key, group, parents):
        paths = Paths(parents, TOP, levels)
        rows = [(name, *row) for at, name in zip(group["place"].to_pylist(), group["name"].to_pylist(), strict=True) for row in paths.of(at)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["tree", "level", "at", "preimage"])

    return names.groupBy("tree", "block").cogroup(ancestors.groupBy("tree", "block")).applyInArrow(run, "tree string, level int, at long, preimage string")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; ids whose crc32 is a multiple of 7 are tampered with."""
    return merkle_manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


#: DuckDB SQL for op12_merkle_manifest.
ORACLE = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS k, doc_id, lang, n_chars, text,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda x: coalesce(CAST(strlen(x) AS VARCHAR) || ':' || x, '-')) AS p,
         coalesce(CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, x: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, x)), 4294967295), 4294967295) AS crc FROM documents),
h AS (SELECT *, sha256(array_to_string(p, '')) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(p[1] || p[2] || p[3] || more || p[5]) ELSE sha256(array_to_string(p, '')) END AS changed FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce('=' || lang, '') AS tree FROM h),
b AS (SELECT tree, 0 AS level, i, leaf AS v FROM o
      UNION ALL SELECT x.tree, x.level + 1, x.i // 2, sha256(x.v || coalesce(y.v, '')) FROM b x LEFT JOIN b y ON y.tree = x.tree AND y.i = x.i + 1 WHERE x.i % 2 = 0 AND (x.i > 0 OR y.v IS NOT NULL)),
s AS (SELECT tree, max(level) AS depth FROM b GROUP BY tree),
r AS (SELECT b.tree, b.v, row_number() OVER (ORDER BY b.tree) - 1 AS i FROM b JOIN s ON s.tree = b.tree AND s.depth = b.level),
t AS (SELECT 0 AS level, i, v FROM r UNION ALL SELECT x.level + 1, x.i // 2, sha256(x.v || coalesce(y.v, '')) FROM t x LEFT JOIN t y ON y.i = x.i + 1 WHERE x.i % 2 = 0 AND (x.i > 0 OR y.v IS NOT NULL)),
top AS (SELECT max(level) AS depth FROM t),
up AS (SELECT k, tree, 0 AS level, i, '' AS proof, changed AS fold FROM o
       UNION ALL SELECT u.k, u.tree, u.level + 1, u.i // 2, u.proof || coalesce(n.v, ''), sha256(CASE WHEN u.i % 2 = 0 THEN u.fold || coalesce(n.v, '') ELSE n.v || u.fold END)
       FROM up u JOIN s ON s.tree = u.tree AND u.level < s.depth LEFT JOIN b n ON n.tree = u.tree AND n.level = u.level AND n.i = xor(u.i, 1)),
on_top AS (SELECT u.k, 0 AS level, r.i, u.proof, u.fold FROM up u JOIN s ON s.tree = u.tree AND s.depth = u.level JOIN r ON r.tree = u.tree
       UNION ALL SELECT u.k, u.level + 1, u.i // 2, u.proof || coalesce(n.v, ''), sha256(CASE WHEN u.i % 2 = 0 THEN u.fold || coalesce(n.v, '') ELSE n.v || u.fold END)
       FROM on_top u JOIN top ON u.level < top.depth LEFT JOIN t n ON n.level = u.level AND n.i = xor(u.i, 1)),
done AS (SELECT on_top.* FROM on_top JOIN top ON on_top.level = top.depth)
SELECT o.doc_id, o.leaf, r.v AS subroot, t.v AS root, sha256(done.proof) AS proof_sha256, done.fold AS folded_root, done.fold = t.v AS verified
FROM o JOIN done USING (k) JOIN r ON r.tree = o.tree JOIN top ON true JOIN t ON t.level = top.depth"""
