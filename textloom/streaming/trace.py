"""Streams: the training trace, the pools and ratchets carried from round to round, windowed event counts.

Windowed counts with watermarks are an extension of this engine over the events table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.selection import pool_merge
from textloom.sources.files import exists, is_file
from textloom.sources.sinks import json_safe


def trace_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A trace folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder (or file) of parquet as a stream, its schema taken from the data."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and is_file(spark, path) else reader.parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n, total) of tumbling event-time windows; rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process all that is there, batch by batch, and stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def append_trace(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Trace rows, NaN and infinities as null, appended as JSON lines exactly once."""
    query = json_safe(stream).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keep_pool(path: str, cap: int, schema: str) -> Callable[[DataFrame, int], None]:
    """A batch function that merges each batch into the stored pool of the ``cap`` lowest scored texts.

    Every batch writes its own folder and reads that of the batch before, so a batch that is run again gives the
    same result.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _last_batch(spark, path, number)
        old = spark.read.schema(schema).parquet(before) if before else spark.createDataFrame([], schema)
        pool_merge(old, batch, cap).select(*[f.name for f in old.schema]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def _last_batch(spark: SparkSession, path: str, number: int) -> str | None:
    """The folder of the latest batch before ``number`` that was written, on whatever file system."""
    return next((f"{path}/batch={n}" for n in range(number - 1, -1, -1) if exists(spark, f"{path}/batch={n}")), None)


def keep_ratchet(path: str, key: str, score: str, schema: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends, per key, the rows that are below everything seen before.

    Beside the folder of the rows, in ``<path>-lowest``, the lowest score of every key so far is kept, so a batch reads one
    table and not all batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = [f.name for f in spark.createDataFrame([], schema).schema]
        before = _last_batch(spark, f"{path}-lowest", number)
        lowest = spark.read.parquet(before) if before else batch.select(key, F.col(score).alias("_best")).limit(0)
        w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        fresh = batch.join(lowest, key, "left").withColumn("_best", F.least("_best", F.min(score).over(w)))
        kept = fresh.where(F.col("_best").isNull() | (F.col(score) < F.col("_best"))).drop("_best")
        kept.select(*names).write.mode("overwrite").parquet(f"{path}/batch={number}")
        now = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(score).alias("_best")).unionByName(lowest)
        now.groupBy(key).agg(F.min("_best").alias("_best")).write.mode("overwrite").parquet(f"{path}-lowest/batch={number}")

    return each
