"""Incremental forms for append-only step logs: windowed means with a watermark, and keyed upserts.

The batch reference has no streams; these give the same numbers as the batch operators while files arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def step_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_means(events: DataFrame, time: str, keys: Sequence[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, keys, n, mean of tumbling windows; a stream drops what comes later than the watermark, a table nothing."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, time: str, keys: Sequence[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start, stop, keys, n of runs of events with no gap that long."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def distinct_steps(events: DataFrame, time: str, keys: Sequence[str], late: str = "2 hours") -> DataFrame:
    """Each key once while its watermark holds; a table's keys once."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def upsert_into(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key under path: every batch writes a new version beside the latest one before it.

    Within a batch the column _order decides where it is given; a batch that runs again writes its version anew.
    """
    from sparkloom.sources.readers import exists
    from sparkloom.sources.writers import upserted

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = next((f"{path}/v{n}" for n in range(number - 1, -1, -1) if exists(spark, f"{path}/v{n}")), None)
        (upserted(spark.read.parquet(old) if old else batch.limit(0), batch, keys)).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
