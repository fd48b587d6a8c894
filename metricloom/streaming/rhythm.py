"""Hourly order and cancel counts on an event stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, order_type: str = "purchase", cancel_type: str = "error", by=("subject",)) -> DataFrame:
    """Tumbling one-hour counts; the same expression serves batch and stream.

    Counts combine on the map side, so one very active subject costs one row per task.
    """
    hour = F.window("ts", "1 hour")
    return (
        events.filter(F.col("event_type").isin(order_type, cancel_type))
        .groupBy(hour.alias("w"), *by)
        .agg(
            F.count_if(F.col("event_type") == order_type).alias("orders"),
            F.count_if(F.col("event_type") == cancel_type).alias("cancel"),
        )
        .select(F.col("w.start").alias("hour_start"), *by, "orders", "cancel")
    )


def stream_hourly(events: DataFrame, delay: str = "2 hours", **options) -> DataFrame:
    """Append-mode stream: an hour is emitted once the watermark has passed its end; rows
    later than the delay are dropped."""
    return hourly_counts(events.withWatermark("ts", delay), **options)
