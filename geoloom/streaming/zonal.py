"""Daily zonal means over files as they arrive: what is done stays done, and a restart goes on from the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_means(events: DataFrame, *, late: str = "2 days", zone: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """(date, zone, mean, n) by tumbling days; a day is emitted once no event of it can come any more."""
    day = F.window(ts, "1 day").alias("day")
    kept = events.withWatermark(ts, late).groupBy(day, zone)
    return kept.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.to_date("day.start").alias("date"), zone, "mean", "n")


def run(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, **options) -> None:
    """Process the files that are there now, append the days that are complete, and stop."""
    events = spark.readStream.schema(schema).parquet(source)
    days = daily_means(events, **options)
    query = days.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
