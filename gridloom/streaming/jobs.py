"""Structured Streaming: scene requests that become scenes, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.fields import simulate
from gridloom.session import shared_folder

REQUEST = "scene_id long, depth double, turn double"
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def scenes(spark: SparkSession, requests: str, out: str, checkpoint: str, size: int = 64) -> StreamingQuery:
    """Files of requests (JSON lines) -> scenes in Parquet. A restart goes on after the last batch;
    a batch that is run again replaces its own folder."""
    stream = spark.readStream.schema(REQUEST).json(requests)
    write = lambda batch, k: simulate(batch, size).write.mode("overwrite").parquet(f"{out}/batch={k}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events files of a folder as a stream, with a timestamp that watermarks accept."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out in append mode."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.unix_seconds("session_window.start").alias("started"), "events", "total")


def drained(result: DataFrame) -> DataFrame:
    """Run a streaming aggregation over what is there now; each batch writes the whole result table to the shared
    folder, and the last one is read back."""
    spark = result.sparkSession
    out = f"{shared_folder(spark)}/gridloom-stream-{uuid.uuid4().hex}"
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/table")
    query = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/table")


def appended(result: DataFrame) -> DataFrame:
    """Run a streaming aggregation with a watermark over what is there now: each batch adds only the windows that have closed, to files
    that are never written again; gives all of them."""
    spark = result.sparkSession
    out = f"{shared_folder(spark)}/gridloom-stream-{uuid.uuid4().hex}"
    query = result.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/table")
