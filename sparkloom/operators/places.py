"""Places of rows in an order, for groups of any size: tables written once, rows numbered over range partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary one stands in only in local runs that name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def written(rows: DataFrame) -> DataFrame:
    """rows as a Parquet table in the shared folder: read again and again with the same layout, whatever executors are lost."""
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing will read again."""
    for rows in tables:
        sc = rows.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame, each: int = 10_000) -> DataFrame:
    """rows dealt to tasks of about `each`: for work that is slow by the row, as a small file is read by one task however many rows it holds."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equality of keys, null with null, between the aliases a and b."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], total: str | None = None, unique: bool = False) -> DataFrame:
    """rows, written, with _at: the place within the group of `keys` in `order`, from 0; and _size: the rows of the group.

    total: also _before, the sum of this column over the rows ahead of a row in its group. Rows that tie take places in an
    order of their own; unique: there are none, so that rows need not be written before they are sorted. Rows are sorted over range partitions of keys and order and written with their partition and place
    in it, so a group, however large, is spread over tasks, and what counts rows and what numbers them reads one layout.
    """
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    if not by:
        raise ValueError("nothing to order by")
    # Ranges are sampled first: what is sorted must not change in between.
    fixed = rows.withColumn("_tie", F.lit(0)) if unique else written(rows.withColumn("_tie", F.monotonically_increasing_id()))
    placed = fixed.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    placed = written(placed.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    if not unique:
        discard(fixed)
    amount = F.col(total) if total else F.lit(0)
    spans = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"), F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row a partition and group
    ahead = group.orderBy("_part")
    spans = spans.select(*keys, "_part", "_first", (F.sum("_n").over(ahead) - F.col("_n")).alias("_ahead"), (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_past"), F.sum("_n").over(group).alias("_size"))
    a, b = placed.alias("a"), spans.alias("b")
    joined = a.join(b, same("a", "b", keys) & (F.col("a._part") == F.col("b._part")))
    at = F.col("a._row") - F.col("b._first") + F.col("b._ahead")
    out = joined.select("a.*", at.alias("_at"), F.col("b._size").alias("_size"), F.col("b._past").alias("_past"))
    if total:
        within = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("_before", F.sum(F.coalesce(amount, F.lit(0))).over(within) - F.coalesce(amount, F.lit(0)) + F.col("_past"))
    return out.drop("_part", "_row", "_past")


def ranked_values(rows: DataFrame, keys: Sequence[str], value: str, also: Sequence[Column] = ()) -> DataFrame:
    """(keys, value, n, before, total, also): each different value of a group, written, with how many rows hold it and how many lie below it.

    total: the rows of the group; also: further aggregates of the rows that hold the value. Null doesn't count. Rows are counted by
    value before they move, and values are numbered over ranges, so no task gets a whole group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *also)
    placed = numbered(counts, keys, [value], "n", unique=True).drop("_at", "_size").withColumnRenamed("_before", "before")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if not keys:
        return placed.withColumn("total", F.lit(totals.first()[0]))  # one row
    a, b = placed.alias("a"), totals.alias("b")
    return a.join(b, same("a", "b", keys)).select("a.*", "b.total")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """keys and a column for each share: exact quantiles by linear interpolation, of groups of any size.

    names: of the columns, else p and the percents. Null doesn't count, NaN is the largest number; a group of nulls has no row.
    """
    ranked = ranked_values(rows.select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("_v")))
    out = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("total") - 1)
        out += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}"), F.max(place - F.floor(place)).alias(f"_part{i}")]
    found = ranked.groupBy(*keys).agg(*out)
    named = names or [f"p{round(share * 100)}" for share in shares]
    between = lambda i: F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}"))
    found = found.select(*keys, *(between(i).alias(name) for i, name in enumerate(named)))
    return found if keys else found.filter(F.col(named[0]).isNotNull())
