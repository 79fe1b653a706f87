"""Route events as a stream: counts in event-time windows, with a watermark that ends windows and late rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    got = events.withColumn("ts", F.col("ts").cast("timestamp"))
    got = got.withWatermark("ts", late) if events.isStreaming else got
    agg = got.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    got = events.withColumn("ts", F.col("ts").cast("timestamp"))
    got = got.withWatermark("ts", late) if events.isStreaming else got
    agg = got.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
