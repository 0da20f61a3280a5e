"""Event streams: windowed counts and sessions with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import scratch_dir


def windowed(events: DataFrame, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Counts and sums by tumbling window and event type; works on streams and tables."""
    w = F.window("ts", width)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``user_id, session_start, session_end, n, total``: a user's events no further than ``gap`` apart; works on streams and tables."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return source.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def drained(spark: SparkSession, folder: str, name: str, build, keys: list[str]) -> DataFrame:
    """Run a streaming query over all files that ``folder`` has now, and return its last row of each of ``keys``.

    Batches bring updated rows only, so state behind the watermark is dropped.
    """
    base = f"{scratch_dir(spark).rstrip('/')}/strandline/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    out = build(stream)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in out.columns if c not in keys]
    last = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, batch int").parquet(f"{base}/out")
    return last.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*out.columns)
