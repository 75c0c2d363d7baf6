"""Structured Streaming: windows over late events, speaker turns by session gap, resumable sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A growing folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, at: str, key: list[str], value: str, width: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Rows, mean and maximum per key and epoch-anchored window; rows later than the watermark are dropped."""
    t = F.col(at).cast("timestamp")
    g = df.withColumn("_t", t).withWatermark("_t", late).groupBy(*key, F.window("_t", width).alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "max")


def sliding(df: DataFrame, at: str, key: list[str], value: str, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    t = F.col(at).cast("timestamp")
    g = df.withColumn("_t", t).withWatermark("_t", late).groupBy(*key, F.window("_t", width, step).alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*key, F.col("w.start").alias("start"), "n", "mean")


def sessions(df: DataFrame, at: str, key: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events with no pause of ``gap`` between them."""
    t = F.col(at).cast("timestamp")
    g = df.withColumn("_t", t).withWatermark("_t", late).groupBy(*key, F.session_window("_t", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once while its state lives: repeated deliveries are dropped within the watermark."""
    return df.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(key).drop("_t")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint folder makes the next run go on behind it."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
