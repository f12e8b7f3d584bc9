"""Lines as streams: windows over event time, with late rows bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.plans.durable import ensure_checkpoint_dir


def windowed(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total, low, high`` of tumbling windows; works on streams and on tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    value = F.col("value")
    sums = (F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return marked.groupBy(F.window("ts", every).alias("w"), "event_type").agg(*sums).select(F.col("w.start").alias("start"), "event_type", "n", "total", "low", "high")


def run_available(spark: SparkSession, folder: str, name: str, every: str = "1 hour") -> DataFrame:
    """Stream the Parquet file ``name`` of ``folder`` through ``windowed`` until all is read, and return the windows.

    State and results are in the shared checkpoint folder, so a restart goes on where
    it was. Every batch adds the windows that it changed in a folder of its own, which
    a repeated batch replaces; of a window the last version counts. The state keeps
    only windows that the watermark has not passed.
    """
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    query = windowed(stream, every).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    versions = spark.read.parquet(f"{at}/out")
    last = F.max_by(F.struct("n", "total", "low", "high"), "batch").alias("last")
    return versions.groupBy("start", "event_type").agg(last).select("start", "event_type", "last.*")
