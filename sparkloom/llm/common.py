"""What several operators share: stored tables, row keys, Arrow plumbing, connected components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows and bytes in a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"
#: Hot keys that a join may send to every task, at most.
HOT_KEYS = 10_000
#: Bits, as a power of two, of the filter that says which rows a join need not move.
FILTER_BITS = 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary one stands in only in local runs that name none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (with _ for .) that hold inside the with statement only."""
    before = {k: spark.conf.get(k, None) for k in (name.replace("_", ".") for name in values)}
    try:
        for name, value in values.items():
            spark.conf.set(name.replace("_", "."), value)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Folders that stored() has written inside noting().
NOTED: list[list[str]] = []


@contextmanager
def noting(paths: list[str]):
    """Adds to `paths` the folder of each table that is stored inside the with statement."""
    NOTED.append(paths)
    try:
        yield
    finally:
        NOTED.pop()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files of the job go when the table is complete, not whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for paths in NOTED:
        paths.append(path)
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files behind tables from stored() that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def delete(spark: SparkSession, folders) -> None:
    """Deletes folders, if they are there, in whatever store they lie."""
    sc = spark.sparkContext
    for name in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches small enough that a few long texts, or many, don't fill a worker's memory.

    Batches are cut when the plan runs, which may be after this function, so the two session settings stay.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, spread, how: str = "inner", parts: int = 64) -> DataFrame:
    """left joined with right, which has each key once and in `weight` how many of left's `rows` rows hold it.

    Keys that hold over one in HOT_KEYS of left's rows are hot; there are fewer than HOT_KEYS of them, so their list can
    go to every task. Their rows in left are dealt over `parts` places by the column `spread`, and their row in right is
    repeated for each. The weight column is dropped.
    """
    limit = max(1000, rows // HOT_KEYS)
    hot = F.broadcast(right.filter(F.col(weight) > limit).select(*keys, F.lit(True).alias("__hot")))
    dealt = left.join(hot, keys, "left").withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")).drop("__hot")
    copied = right.withColumn("__part", F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")


def told_apart(rows: DataFrame, names: list[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those that hold none of keys(*names), told without moving a row, and those that may hold one.

    Rows are looked up in a filter of 2 ** FILTER_BITS bits that goes to every task, of 1 MB whatever the number of keys. A
    join with keys then moves the second part only: the rows that hold a key, and of the others about as large a
    share as bits are set, few up to a million keys. With many more keys it moves more, all rows at most.
    """
    at, bit = F.pmod(F.xxhash64(*names), F.lit(1 << FILTER_BITS)), "cast(__at & 63 as int)"
    set_bits = keys.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("__bits"))
    looked = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(set_bits), "__word", "left")
    may = F.coalesce(F.expr(f"shiftrightunsigned(__bits, {bit}) & 1"), F.lit(0)) == 1
    return tuple(looked.filter(x).select(*rows.columns) for x in (~may, may))


def kept_in_worker(name: str, make):
    """What make() gives, made once in a Python worker and kept there from task to task."""
    holder = sys.modules.setdefault("sparkloom_kept_in_worker", types.ModuleType("sparkloom_kept_in_worker"))
    if name not in vars(holder):
        setattr(holder, name, make())
    return getattr(holder, name)


def row_key(doc_id="doc_id", text="text"):
    """16 bytes that name a row by its id and text. Rows equal in both share it, and so do their results."""
    return F.unhex(F.md5(F.concat_ws("\u0001", F.coalesce(F.col(doc_id).cast("string"), F.lit("\\N")), F.coalesce(F.col(text), F.lit("")))))


def text_bytes(column: pa.Array, at: int) -> bytes:
    """The UTF-8 bytes of one text; null counts as empty."""
    x = column[at]
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst): component is the smallest node reachable.

    Alternating large-star and small-star rounds over the edge table; each round's edges are written to the shared
    folder. Isolated nodes are not listed. No edge, component or node list comes to the driver: only a count and a
    checksum per round. Empty input gives an empty table; repeated edges, loops and null ends do no harm. Raises an error
    if `rounds` rounds don't settle the components; the logarithm of the longest path is the usual number.
    """
    def both(e):
        return e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def mark(e):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()

    e = stored(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src is not null and dst is not null and src <> dst").distinct())
    seen = mark(e)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        near = both(e)
        least = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = near.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(least, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("x")).select("x.*")
        new = stored(small.filter("src <> dst").distinct())
        old, e, now = e, new, mark(new)
        discard(old)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
