"""Streams: idle gaps of users as session windows with a watermark, from a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, started, ended (of the last event), n: the same for a stream and for a table."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return found.select("user_id", "started", "ended", "n")


def stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, **options: str) -> None:  # noqa: ANN001
    """Run sessions() over the files that are in the folder now, into Parquet files of closed sessions."""
    source = spark.readStream.schema(schema).parquet(folder)
    query = sessions(source, **options).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
