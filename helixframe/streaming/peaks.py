"""Peak files as a stream: duplicates dropped within a watermark, counts per source and window of delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "peak_row_id BIGINT, file_id BIGINT, source_id STRING, peak_chr STRING, peak_start INT, peak_end INT, called_at TIMESTAMP_NTZ, loaded_at TIMESTAMP_NTZ"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts_by_window(peaks: DataFrame, window: str = "30 days", delay: str = "3650 days") -> DataFrame:
    """``source_id``, ``starts``, ``n``: distinct delivered rows per source and window of ``called_at``; later rows are dropped."""
    t = peaks.where("source_id IS NOT NULL").withColumn("at", F.col("called_at").cast("timestamp"))
    once = t.withWatermark("at", delay).dropDuplicatesWithinWatermark(["peak_row_id"])
    return once.groupBy("source_id", F.window("at", window)).agg(F.count(F.lit(1)).alias("n")).select("source_id", F.col("window.start").alias("starts"), "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """All that is there, then stop; the result is a table in memory called ``name`` (for tests)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
