"""Proven date ranges of physical exports and what follows from them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import observed
from ..functions.periods import boundary_cutoff, day_key, iso_week
from ..labels import QTY


def source_coverage(obs: DataFrame, chart_obs: DataFrame = None, declared: DataFrame = None) -> DataFrame:
    """First and last day per file.

    Evidence: day columns with a valid total quantity over all subjects and sheets, and
    declared start/end pairs. Chart headers count only for files with no such evidence.
    """
    def span(df):
        day = day_key(F.col("period"))
        known = df.filter("grain = 'day'").filter(observed(F.col("value")).isNotNull() & day.isNotNull())
        return known.groupBy("source_order").agg(F.min(day).alias("start"), F.max(day).alias("end"))

    detail = span(obs.filter((F.col("stat") == QTY) & (F.col("category") == QTY)))
    if declared is not None:
        ok = declared.filter("start <= end").select("source_order", "start", "end")
        detail = detail.unionByName(ok).groupBy("source_order").agg(
            F.min("start").alias("start"), F.max("end").alias("end")
        )
    if chart_obs is None:
        return detail
    charts = span(chart_obs.filter("series is null"))
    return detail.unionByName(charts.join(detail, "source_order", "left_anti"))


def boundary_side(start: Column, end: Column, week: Column) -> Column:
    """'left' when the export ends on the cut of a boundary week, 'right' when it starts after."""
    cut = boundary_cutoff(week)
    return F.when((start <= cut) & (end == cut), "left").when(
        (start == F.date_add(cut, 1)) & (end >= start), "right"
    )


def with_side(pieces: DataFrame, coverage: DataFrame, period: str = "period") -> DataFrame:
    """Adds ``boundary`` (kind of boundary week or NULL), ``is_left`` (NULL when the file is
    on no proven side) and ``covered`` to every piece.

    Coverage has one row per file; the planner broadcasts it only below its size limit.
    """
    spans = coverage.select("source_order", F.col("start").alias("_s"), F.col("end").alias("_e"))
    tagged = pieces.withColumn("_week", iso_week(F.col(period)))
    side = boundary_side(F.col("_s"), F.col("_e"), F.col("_week"))
    return tagged.join(spans, "source_order", "left").select(
        *pieces.columns,
        F.col("_week.boundary").alias("boundary"),
        (side == "left").alias("is_left"),
        F.col("_s").isNotNull().alias("covered"),
    )


def covered_days(coverage: DataFrame, day: str = "day") -> DataFrame:
    """One row per file and covered day, for equality joins instead of range joins."""
    return coverage.select("source_order", F.explode(F.sequence("start", "end")).alias(day))


def fill_sparse_days(obs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Adds a 0 for each quantity row of a file at every day that other files of the same
    report and subject show and that lies in this file's range but has no column in it."""
    from .merge import is_quantity

    sheet = ["report", "subject"]
    daily = obs.filter("grain = 'day'").withColumn("_day", day_key(F.col("period"))).filter("_day is not null")
    present = daily.select(*sheet, "source_order", "_day").distinct()
    known = present.select(*sheet, "_day").distinct()
    sheets = present.select(*sheet, "source_order").distinct()
    inside = sheets.join(covered_days(coverage, "_day"), "source_order")
    missing = inside.join(known, sheet + ["_day"], "left_semi").join(
        present, sheet + ["source_order", "_day"], "left_anti"
    )
    rows = daily.filter(is_quantity("metric", "stat", "category")).groupBy(
        *sheet, "source_order", "metric", "stat", "category"
    ).agg(F.min("row_ord").alias("row_ord"))
    zeros = missing.join(rows, sheet + ["source_order"]).select(
        *sheet, F.lit("day").alias("grain"), F.date_format("_day", "yyyy-MM-dd").alias("period"),
        "metric", "stat", "category", F.lit(0.0).alias("value"), "source_order", "row_ord",
    )
    return obs.unionByName(zeros, allowMissingColumns=True)


def merged_intervals(ranges: DataFrame, keys) -> DataFrame:
    """Disjoint intervals (keys, start, end) of day ranges that may overlap, repeat or adjoin.

    A sweep in the order of starts: a range that begins more than a day after all ends before it opens
    an interval. A key holds one range per export; ranges without a start or an end, or that end before
    they start, cover nothing.
    """
    keys = list(keys)
    known = ranges.filter("start <= end").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.date_add(F.max("end").over(before), 1), F.lit(True))
    swept = known.withColumn("_opens", opens.cast("int"))
    numbered = swept.withColumn("_part", F.sum("_opens").over(Window.partitionBy(*keys).orderBy("start")))
    return numbered.groupBy(*keys, "_part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part")


def interval_days(ranges: DataFrame, keys, day: str = "day") -> DataFrame:
    """Every covered day of a key once, however many ranges cover it."""
    return merged_intervals(ranges, keys).select(*keys, F.explode(F.sequence("start", "end")).alias(day))


def value_or_covered_zero(wanted: DataFrame, values: DataFrame, coverage: DataFrame, keys) -> DataFrame:
    """The value of a day; else 0 when any export of that key covers the day; else NULL.

    wanted: keys + day. values: keys + day + value. coverage: keys + start + end.
    """
    keys = list(keys)
    covered = interval_days(coverage, keys).withColumn("_covered", F.lit(True))
    found = values.select(*keys, "day", "value", F.lit(True).alias("_found"))
    joined = wanted.join(found, keys + ["day"], "left").join(covered, keys + ["day"], "left")
    return joined.withColumn(
        "value", F.when(F.col("_found"), F.col("value")).when(F.col("_covered"), F.lit(0.0))
    ).drop("_found", "_covered")
