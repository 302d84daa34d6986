"""An extension beyond batch costs: spending by tumbling window over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def spending(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total. Watermarks want a timestamp with a zone; the result is without one again."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    per = rows.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
