"""Structured Streaming forms of the record, window, dedupe, resolution, alert and session operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators.records import parse
from spoorline.session import configure


def _numbered(batches):
    """Places of lines: where their block starts, and their number in it."""
    block, n = None, 0
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        places = []
        for at in zip(files, starts):
            block, n = (block, n + 1) if at == block else (at, 0)
            places.append(at[1] + n)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(places, pa.int64()), batch.column("raw")], ["file", "pos", "raw"])


def stream_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records ``(file, pos, raw, v)`` of line-delimited files as they arrive; bad lines are skipped.

    Files are split into blocks of ``spark.sql.files.maxPartitionBytes``, and a line belongs to the block it starts in.
    A line takes at least one byte, so block start plus its number in the block is unique and ascending in its file.
    ``file`` starts with the file's modification time, so records sort by the age of their file, then by their place.
    """
    configure(spark)
    lines = spark.readStream.options(**{"lineSep": "\n", **options}).text(path)
    age = F.lpad(F.unix_millis("_metadata.file_modification_time").cast("string"), 15, "0")
    body = F.regexp_replace(F.trim("value"), r",$", "")
    named = lines.select(F.concat_ws(" ", age, F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"), body.alias("raw"))
    return parse(named.where(~F.col("raw").isin("", "[", "]")).mapInArrow(_numbered, "file string, pos long, raw string"))


END_SECONDS = 4102444800.0  # a time after all data: the first second of the year 2100


def with_end(events: DataFrame, folder: str) -> DataFrame:
    """The stream with the rows that ``end_of_data`` will put into ``folder``."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("append").parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def end_of_data(events: DataFrame, folder: str) -> None:
    """Puts one row far behind all times, so that the next run moves the watermark past every open window."""
    spark = events.sparkSession
    empty = [F.lit(END_SECONDS if f.name == "ts_s" else None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*empty).write.mode("append").parquet(folder)


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    """``ts`` from the epoch seconds, with a watermark."""
    return events.withColumn("ts", F.timestamp_micros(F.round(F.col("ts_s") * 1e6).cast("long"))).withWatermark("ts", delay)


def stream_window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events per window and type; windows are epoch-aligned, late events are dropped."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        with_event_time(events, delay).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "event_type", "n")
    )


def stream_dedupe(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One event per key within the watermark delay."""
    return with_event_time(events, delay).dropDuplicatesWithinWatermark(keys)


def stream_dedupe_windows(events: DataFrame, keys: list[str], size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """One event per key and epoch-aligned window of event time, sent when it is first seen.

    The state of a window leaves once the watermark has passed its end, so it holds the keys of the open windows only,
    however long the stream runs; events later than that are dropped. Null keys are equal to each other.
    """
    return with_event_time(events, delay).withColumn("window", F.window("ts", size)).dropDuplicates([*keys, "window"])


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per source entity."""
    return (
        with_event_time(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "src_key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))
        .select("src_key", F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "n", "max_score")
    )


def stream_alerts(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Events at or above the stored baseline of their type, with the excess; a stream-static join."""
    return events.join(baseline.select("event_type", "threshold"), "event_type").where(
        F.col("score") >= F.col("threshold")
    ).withColumn("excess", F.col("score") - F.col("threshold"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now into a parquet table."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
