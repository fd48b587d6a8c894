"""Small-order rhythm, retention and cancellation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_rate
from ..functions.periods import day_key, is_summary_period
from ..labels import QTY, SMALL, SMALL_NET

_DAY = ["subject", "day"]


def assign_campaign(days: DataFrame, campaigns: DataFrame, keys=("subject",)) -> DataFrame:
    """A day belongs to the campaign that covers it, if exactly one does.

    Campaign windows are opened to days first: an equality join instead of a range join.
    """
    keys = list(keys)
    opened = campaigns.select(
        *keys, "campaign", F.explode(F.sequence("small_start", "small_end")).alias("day")
    )
    single = opened.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("_n"), F.max("campaign").alias("campaign")
    ).filter("_n = 1").drop("_n")
    return days.join(single, keys + ["day"])


def hourly_to_day(hourly: DataFrame) -> DataFrame:
    """Hourly orders and cancels by order date."""
    return hourly.groupBy("subject", F.col("date").alias("day")).agg(
        F.sum(F.coalesce("orders", F.lit(0.0))).alias("orders"),
        F.sum(F.coalesce("cancel", F.lit(0.0))).alias("cancel"),
    )


def mix_orders(obs: DataFrame) -> DataFrame:
    """Small orders per day of the mix report: the metric itself, else net, else the first one."""
    rows = obs.filter((F.col("stat") == QTY) & (F.col("category") == QTY) & ~is_summary_period(F.col("period")))
    day = day_key(F.col("period"))

    def pick(name):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    return rows.groupBy("subject", day.alias("day")).agg(
        F.coalesce(pick(SMALL), pick(SMALL_NET), F.min_by("value", "row_ord"), F.lit(0.0)).alias("orders")
    )


def small_order_rhythm(mix: DataFrame, hourly_days: DataFrame, daily: DataFrame) -> DataFrame:
    """Hourly figures where the date exists there, else mix orders with the daily cancels.

    mix: subject, day, orders (already limited to the campaign). Subjects without any mix
    day use their hourly dates. daily: subject, day, cancel.
    """
    subjects = mix.select("subject").distinct()
    only_hourly = hourly_days.join(subjects, "subject", "left_anti").select(*_DAY, F.lit(0.0).alias("orders"))
    days = mix.select(*_DAY, "orders").unionByName(only_hourly)
    hourly = hourly_days.select(*_DAY, F.col("orders").alias("_o"), F.col("cancel").alias("_c"), F.lit(True).alias("_h"))
    joined = days.join(hourly, _DAY, "left").join(daily.select(*_DAY, F.col("cancel").alias("_d")), _DAY, "left")
    return joined.select(
        *_DAY,
        F.when(F.col("_h"), F.col("_o")).otherwise(F.col("orders")).alias("orders"),
        F.when(F.col("_h"), F.col("_c")).otherwise(F.coalesce("_d", F.lit(0.0))).alias("cancel"),
    )


def rhythm_rates(rhythm: DataFrame) -> DataFrame:
    kept = F.greatest(F.col("orders") - F.col("cancel"), F.lit(0.0))
    return rhythm.select(
        *rhythm.columns, kept.alias("retained"),
        safe_rate(kept, F.col("orders")).alias("retention_rate"),
        safe_rate(F.col("cancel"), F.col("orders")).alias("cancel_rate"),
    )


def campaign_totals(rated: DataFrame, by=("subject", "campaign")) -> DataFrame:
    """Sums per campaign; rates are derived from the sums."""
    return rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders"),
        F.sum("retained").alias("retained"), F.sum("cancel").alias("cancel"),
    ).withColumn("retention_rate", safe_rate(F.col("retained"), F.col("orders")))


def combined_totals(totals: DataFrame) -> DataFrame:
    """Several campaigns of a subject: counts added, the rate from the added counts."""
    return totals.groupBy("subject").agg(
        F.count(F.lit(1)).alias("campaigns"), F.sum("orders").alias("orders"),
        F.sum("retained").alias("retained"), F.sum("cancel").alias("cancel"),
    ).withColumn("retention_rate", safe_rate(F.col("retained"), F.col("orders")))


def hour_profile(hourly: DataFrame, values, part=("subject",), day=None) -> DataFrame:
    """All 24 hours of one day or of all days; hours without rows are 0."""
    rows = hourly if day is None else hourly.filter(F.col("date") == day)
    summed = rows.groupBy(*part, "hour").agg(*[F.sum(F.coalesce(v, F.lit(0.0))).alias(v) for v in values])
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    grid = rows.select(*part).distinct().select(*part, hours)
    return grid.join(summed, [*part, "hour"], "left").fillna(0.0, subset=list(values))


def kept_orders(profile: DataFrame) -> DataFrame:
    return profile.withColumn("kept", F.greatest(F.col("orders") - F.col("cancel"), F.lit(0.0)))


def daily_cancel(daily: DataFrame) -> DataFrame:
    """Cancels of a day, small and big; unknown rates stay gaps."""
    small = F.greatest(F.coalesce("small_cancel", F.lit(0.0)), F.lit(0.0))
    big = F.greatest(F.coalesce("big_cancel", F.lit(0.0)), F.lit(0.0))
    return daily.select(
        "subject", "date", small.alias("small"), big.alias("big"), (small + big).alias("total"),
        "convert_rate", "small_rate", "big_rate",
    )


def retreat_top(options: DataFrame, n: int = 15) -> DataFrame:
    """Highest total cancel rates of a subject across all dimensions."""
    w = Window.partitionBy("subject").orderBy(F.desc("share"), "ord")
    return options.select(
        "subject", F.concat_ws(" · ", "dimension", "label").alias("label"), "share", "cancel",
        F.row_number().over(w).alias("position"),
    ).filter(F.col("position") <= n)
