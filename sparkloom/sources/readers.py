"""Readers for the file kinds of training runs; all give DataFrames, and paths may be in any store Spark reads."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in the store that its scheme names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dataset(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """The first of <name>_data/<split>, <name>/<split>, <name> under root, as Parquet."""
    tried = [f"{root}/{name}_data/{split}", f"{root}/{name}/{split}", f"{root}/{name}"]
    for path in tried:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"no dataset {name!r}; tried {tried}")


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON objects, one a line; blank lines don't count. strict: a line that isn't one stops the job, else it is left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), "value")
    if strict:
        shaped = F.when(F.trim("value").startswith("{"), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))))
        return parsed.select(shaped.alias("x")).select("x.*")
    return parsed.filter(F.trim("value").startswith("{") & F.expr("try_parse_json(value) is not null")).select("x.*")


def records(spark: SparkSession, path: str, schema: str | T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """JSON arrays, JSON lines or CSV by the path's end; a folder is read as JSON lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".csv"):
        rows = reader.csv(path, header=True)
    elif path.endswith(".json"):
        rows = reader.json(path, multiLine=True)
    else:
        rows = reader.json(path)
    return rows if limit is None else rows.limit(limit)


def aliased(rows: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column for each key: the first of its aliases that is there and not blank."""
    def first(names):
        cols = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*cols, F.lit(None).cast("string"))

    return rows.select(*(first(names).alias(k) for k, names in aliases.items()))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of text files, numbered from 0; long files are read in parts, and no row holds a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("_block", "_at")) - 1
    return lines.select("file", number.alias("line"), "text")


def question_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, question, answer) of text files with a question and an answer on alternate lines."""
    lines = numbered_lines(spark, path).select("file", F.col("line").alias("at"), F.col("text").alias("line"))
    pairs = lines.groupBy("file", F.floor(F.col("at") / 2).alias("number")).agg(
        F.max(F.when(F.col("at") % 2 == 0, F.trim("line"))).alias("question"), F.max(F.when(F.col("at") % 2 == 1, F.trim("line"))).alias("answer")
    )
    return pairs.filter("question <> '' and answer <> ''")


def tar_questions(spark: SparkSession, path: str) -> DataFrame:
    """(member, number, question, answer) of the text members of tar archives, gzipped or not; a task streams one archive."""
    def run(batches):
        import io
        import tarfile

        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for member in archive:
                        if not member.isfile() or not member.name.endswith(".txt"):
                            continue
                        lines = archive.extractfile(member).read().decode("utf-8").splitlines()
                        rows = [(member.name, i // 2, q.strip(), a.strip()) for i, (q, a) in enumerate(zip(lines[::2], lines[1::2], strict=False)) if q.strip() and a.strip()]
                        yield pd.DataFrame(rows, columns=["member", "number", "question", "answer"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, number int, question string, answer string")


def csv_columns(spark: SparkSession, paths: str | list[str], columns: Sequence[str], schema: str | None = None, torn: bool = False) -> DataFrame:
    """Named columns of CSV files with headers; a missing one is an error at once. torn: unreadable lines are left out."""
    # Without pruning, all columns of a line are parsed, whichever are asked for, so a torn one always shows.
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED" if torn else "FAILFAST").option("columnPruning", not torn)
    rows = (reader.schema(schema) if schema else reader).csv(paths)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {paths}")
    return rows.select(*columns)


def same_header_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files joined end to end; files with different headers are an error."""
    headers = {tuple(spark.read.option("header", True).csv(p).columns) for p in paths}
    if len(headers) != 1:
        raise ValueError(f"different headers: {sorted(headers)}")
    return spark.read.option("header", True).csv(paths)


def table_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one kind of a unified table, by its partition column; without that column, all rows."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("table") == name) if "table" in rows.columns else rows


def tolerant_config(spark: SparkSession, path: str) -> DataFrame:
    """(file, config) of JSON files: a VARIANT, null where the file doesn't parse."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("config"))


def experiments(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Enabled rows of an experiments table with their place in the file as record."""
    rows = numbered_lines(spark, path).select("file", F.col("line").alias("record"), F.col("text").alias("line"))
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns {missing}")
    schema = ", ".join(f"`{c}` string" for c in header)
    parsed = rows.filter("record > 0 and trim(line) <> ''").select("record", F.from_csv("line", schema).alias("x")).select("record", "x.*")
    return parsed.filter(F.coalesce(F.lower("enabled"), F.lit("true")).isin("", "true", "1", "yes")) if "enabled" in header else parsed


def dict_literals(lines: Column) -> Column:
    """The first Python dict literal of a text line as JSON text, or null: Spark has no parser for them."""
    @F.pandas_udf(T.StringType())
    def parse(texts: pd.Series) -> pd.Series:
        import ast
        import json

        def one(text):
            start = text.find("{")
            stop = text.rfind("}")
            while 0 <= start < stop:
                try:
                    found = ast.literal_eval(text[start : stop + 1])
                    if isinstance(found, dict):
                        return json.dumps({str(k): v for k, v in found.items()}, default=str)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    pass
                stop = text.rfind("}", start, stop)
            return None

        return texts.map(one, na_action="ignore")

    return parse(lines)


def log_steps(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, step, total, metrics) of training logs: dict lines with the last a/b progress at or before them.

    metrics keeps finite numbers only. Lines keep the order of their file, whose number travels with them.
    """
    lines = numbered_lines(spark, path)
    step, total = (F.regexp_extract("text", "(\\d+)/(\\d+)\\s*\\[", i) for i in (1, 2))
    seen = lines.select("file", "line", "text", F.when(step != "", step.cast("long")).alias("step"), F.when(total != "", total.cast("long")).alias("total"))
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = seen.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("step", "total")})
    parsed = carried.filter(F.col("text").contains("{")).withColumn("metrics", F.from_json(dict_literals(F.col("text")), "map<string,string>")).filter("metrics is not null")
    numbers = F.map_filter(F.transform_values("metrics", lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return parsed.select("file", "line", "step", "total", numbers.alias("metrics"))


def discovered(spark: SparkSession, root: str, pattern: str = "config.json") -> DataFrame:
    """(experiment, version, file) of the runs under root/<experiment>/<version>/.../pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    base = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    part = lambda i: F.regexp_extract("path", f"/{base}/([^/]+)/([^/]+)/", i)
    return files.select(part(1).alias("experiment"), part(2).alias("version"), F.col("path").alias("file")).filter("version <> ''")
