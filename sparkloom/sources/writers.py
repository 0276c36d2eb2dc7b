"""Sinks: refusing, appending, upserting and exporting writers."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.numbers import significant

from .readers import exists


def save_splits(splits: Mapping[str, DataFrame], root: str, overwrite: bool = False) -> None:
    """All splits or none: each is written to a folder of its own beside root, and only then do they take their names."""
    spark = next(iter(splits.values())).sparkSession
    taken = [s for s in splits if exists(spark, f"{root}/{s}")]
    if taken and not overwrite:
        raise FileExistsError(f"{root} has {taken} already")
    jvm = spark.sparkContext._jvm
    work = f"{root}/.new-{uuid.uuid4().hex}"
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        for name, rows in splits.items():
            rows.write.parquet(f"{work}/{name}")
        for name in splits:
            target = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            if name in taken:  # the old split stays beside the new ones until all have their names
                files.rename(target, jvm.org.apache.hadoop.fs.Path(f"{root}/.old-{name}-{work[-32:]}"))
            if not files.rename(jvm.org.apache.hadoop.fs.Path(f"{work}/{name}"), target):
                raise OSError(f"{target} wasn't written")
        for name in taken:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/.old-{name}-{work[-32:]}"), True)
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(work), True)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def union_cells(rows: DataFrame, preferred: Sequence[str], digits: int = 6) -> DataFrame:
    """Text columns for a CSV: the preferred ones first, the others by name; doubles in `digits` significant digits."""
    first = [c for c in preferred if c in rows.columns]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*(significant(F.col(c), kinds[c], digits).alias(c) for c in [*first, *sorted(c for c in rows.columns if c not in first)]))


def write_union_csv(rows: DataFrame, path: str, preferred: Sequence[str], compression: str = "none", digits: int = 6) -> None:
    """CSV with the preferred columns first and the others in order of their names; doubles in `digits` significant digits, null as nothing."""
    union_cells(rows, preferred, digits).write.csv(path, header=True, compression=compression, emptyValue="")


def write_unified(tables: Mapping[str, DataFrame], path: str) -> None:
    """Tables of different columns as one, partitioned by their names."""
    parts = [rows.withColumn("table", F.lit(name)) for name, rows in tables.items()]
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p, allowMissingColumns=True)
    all_rows.write.partitionBy("table").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and new with one row a key: the last one, new rows after old ones; order is the column _order where it is given.

    Rows of one side and key that nothing orders are told apart by their values, so the result doesn't depend on the layout.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    values = F.to_json(F.struct(*sorted(c for c in both.columns if c not in ("_side", "_order"))))
    order = [F.col("_side").desc(), *([F.col("_order").desc()] if "_order" in both.columns else []), values.desc()]
    return both.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank", "_side")


def append_history(spark: SparkSession, rows: list[Mapping[str, str]], path: str, columns: Sequence[str]) -> None:
    """A few records with fixed columns, appended as CSV."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema).coalesce(1).write.mode("append").csv(path, header=True)


def export_matches(rows: DataFrame, path: str, form: str = "json") -> None:
    """Matches with their _index first, as JSON lines, Parquet, or CSV with a header and nested values as JSON."""
    out = rows.select("_index", *(c for c in rows.columns if c != "_index"))
    if form == "csv":
        nested = [f.name for f in out.schema.fields if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)]
        out = out.withColumns({c: F.to_json(c) for c in nested})
    out.write.format(form).options(**({"header": True} if form == "csv" else {})).save(path)


def merge_complete(spark: SparkSession, manifest: DataFrame, parts: DataFrame, shard: str, path: str, keys: Sequence[str]) -> None:
    """Upserts parts into the table under path, once every shard of the manifest is among them; else a ValueError.

    Merging the same parts again changes nothing. The new table is written beside the old one before it takes its place.
    """
    missing = manifest.select(shard).distinct().join(parts.select(shard).distinct(), shard, "left_anti")
    few = [r[0] for r in missing.orderBy(shard).limit(5).collect()]
    if few:
        raise ValueError(f"shards are missing, such as {few}")
    old = f"{path}/merged"
    merged = upserted(spark.read.parquet(old), parts, keys) if exists(spark, old) else upserted(parts.limit(0), parts, keys)
    save_splits({"merged": merged}, path, overwrite=True)
