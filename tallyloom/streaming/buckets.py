"""Streaming forms of the time-bucket operators.

They share their expressions with the batch forms. Completed buckets can leave
in append mode once the watermark passes them; update mode writes the buckets
that changed and equals the batch result at the end of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.core import scratch_path
from tallyloom.operators.reshape import first_per_key


def stream_table(
    spark: SparkSession, directory: str, name: str, time: str, files_per_trigger: int = 64
) -> DataFrame:
    """Parquet files of one table as a stream, in the schema of the table.

    A table is a folder of part files, or a single file. Watermarks need an
    instant, so the event time is cast to a timestamp with session time zone.
    """
    table = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(table).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if files.getFileStatus(path).isDirectory():
        stream = source.parquet(table)
    else:
        stream = source.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def replay_delay(table: DataFrame, time: str, more: str = "0 seconds") -> str:
    """Watermark delay under which a replay of a stored table loses no row in any order of its files.

    It is the time that the table spans, plus ``more``; state is bounded by the
    result of the replay.
    """
    span = F.max(time).cast("timestamp").cast("long") - F.min(time).cast("timestamp").cast("long")
    seconds = table.agg(span.alias("s")).first()["s"] or 0
    return f"{seconds + 1} seconds {more}"


def windowed_totals(
    events: DataFrame, time: str, size: str, late: str, keys: Sequence[str], **aggs: Column
) -> DataFrame:
    """Tumbling-window aggregates with a watermark."""
    w = F.window(time, size)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), *keys)
    return grouped.agg(*[v.alias(k) for k, v in aggs.items()]).select(
        F.col("w.start").alias("bucket"), *keys, *aggs
    )


def stream_aligned(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, shift: str, late: str
) -> DataFrame:
    """Stream-stream join on the same instant after moving the right clock."""
    moved = right.withColumn(time, F.col(time) + F.expr(f"interval {shift}"))
    return left.withWatermark(time, late).join(moved.withWatermark(time, late), [*keys, time])


def run_to_table(stream: DataFrame, tag: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Process all available input and give the sink table.

    Without keys, rows are final and appended once. With keys, each
    micro-batch writes only the buckets it changed, in a folder of its own
    (written again after a retry); the newest version of a bucket counts.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{tag}-out"), scratch_path(spark, f"{tag}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if keys is None:
        query = writer.outputMode("append").format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = writer.outputMode("update").foreachBatch(put).start()
    query.awaitTermination()
    versions = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return first_per_key(versions, keys, [F.desc("batch")]).drop("batch")
