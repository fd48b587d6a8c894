"""Period-over-period comparison, ranking and structure operators.

Windows here run over merged tables: a key holds at most one row per calendar period, so
partition sizes are bounded by the calendar and not by the number of source rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import observed, relative_change
from ..functions.periods import is_summary_period, period_order, period_start
from ..functions.names import first_number
from ..labels import ALL_PERIODS, BATTERY
from .ordered import previous_period


def history_table(df: DataFrame, metrics, part=("subject", "grain"), order="period_start") -> DataFrame:
    """Every metric with its relative change to the period before (NULL without a base)."""
    w = Window.partitionBy(*part).orderBy(order)
    return df.select(
        *part, "period", order, *metrics,
        *[relative_change(F.col(m), F.lag(m).over(w)).alias(f"{m}_change") for m in metrics],
    )


def comparison(now: Column, before: Column) -> Column:
    delta = now - before
    known = now.isNotNull() & before.isNotNull()
    return F.struct(
        F.when(known, "available").otherwise("unavailable").alias("status"),
        F.when(known, before).alias("previous"),
        F.when(known, delta).alias("delta"),
        F.when(known, relative_change(now, before)).alias("rate"),
        F.when(known, F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")).alias("direction"),
    )


def kpi_comparison(kpis: DataFrame, part=("module", "subject", "grain", "label")) -> DataFrame:
    """Adds the movement against the previous *detail* page; summary pages never compare.

    A page without the label leaves the label unavailable on the next page.
    """
    page = [p for p in part if p != "label"] + ["_summary"]
    # Pages are numbered per subject; a label compares only with the page right before. Both
    # windows share one partitioning, and a page holds a handful of labels.
    pages = Window.partitionBy(*page).orderBy("period_start", "period")
    labels = Window.partitionBy(*page, "label").orderBy("_page")
    numbered = kpis.withColumn("_summary", is_summary_period(F.col("period")) | (F.col("period") == ALL_PERIODS)).withColumn("_page", F.dense_rank().over(pages))
    adjoining = ~F.col("_summary") & (F.lag("_page").over(labels) == F.col("_page") - 1)
    before = numbered.withColumn("_prev", F.when(adjoining, F.lag("value").over(labels)))
    return before.select(*kpis.columns, comparison(F.col("value"), F.col("_prev")).alias("comparison"))


def default_period(df: DataFrame, part=("subject", "grain"), order="ord") -> DataFrame:
    """Last detail period of a key; the last period of all when only summaries exist."""
    detail = ~is_summary_period(F.col("period"))
    return df.groupBy(*part).agg(
        F.coalesce(F.max_by("period", F.when(detail, F.col(order))), F.max_by("period", order)).alias("default_period")
    )


def previous_detail(periods: DataFrame, part=("subject", "grain")) -> DataFrame:
    detail = periods.filter(~is_summary_period(F.col("period")))
    return previous_period(detail, part)


def change_rank(df: DataFrame, direction: str, part, name: str, top: int = 10) -> DataFrame:
    """Strict risers or droppers by rate, names as tie-break; needs now, before columns."""
    now, before = observed(F.col("now")), observed(F.col("before"))
    comparable = df.withColumn("now", now).withColumn("before", before).filter("now is not null and before > 0")
    sign = 1 if direction == "rise" else -1
    rated = comparable.withColumn("rate", sign * (F.col("now") - F.col("before")) / F.col("before")).filter("rate > 0")
    w = Window.partitionBy(*part).orderBy(F.desc("rate"), F.asc(name))
    return rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def empty_rise_reason(df: DataFrame, part) -> DataFrame:
    """Keys without a riser: is there nothing to compare, or did nothing rise?"""
    now, before = observed(F.col("now")), observed(F.col("before"))
    ok = now.isNotNull() & (before > 0)
    return (
        df.groupBy(*part)
        .agg(F.max(F.coalesce(ok, F.lit(False))).alias("comparable"), F.max(F.coalesce(ok & (now > before), F.lit(False))).alias("rises"))
        .filter("not rises")
        .select(*part, F.when(F.col("comparable"), "no riser").otherwise("no comparable data").alias("reason"))
    )


def structure_change(df: DataFrame, part=("report", "subject", "grain")) -> DataFrame:
    """Share change per label against the previous page; a label new on the page has change 0."""
    part = list(part)
    steps = previous_period(df, part).select(*part, "period", "prev_period")
    before = df.select(*part, F.col("period").alias("prev_period"), "metric", "category", F.col("share").alias("_prev"))
    joined = df.join(steps, part + ["period"]).join(before, part + ["prev_period", "metric", "category"], "left")
    prior = F.coalesce("_prev", "share")
    return joined.select(*df.columns, prior.alias("previous"), (F.col("share") - prior).alias("change"))


def structure_rank(df: DataFrame, part=("report", "subject", "grain", "period", "metric")) -> DataFrame:
    """Rank inside a dimension: share descending, battery dimensions by capacity ascending."""
    battery = F.col("metric").contains(BATTERY)
    key = F.when(battery, first_number(F.col("category")).cast("double")).otherwise(-F.col("share"))
    w = Window.partitionBy(*part).orderBy(key, "ord")
    return df.withColumn("rank", F.row_number().over(w))


def battery_history(df: DataFrame, part=("report", "subject", "grain")) -> DataFrame:
    """Every battery label at every period (absent = 0) with its relative change."""
    part = list(part)
    rows = df.filter(F.col("metric") == BATTERY)
    periods = df.select(*part, "period", "period_start").distinct()
    labels = rows.select(*part, "category").distinct()
    full = periods.join(labels, part).join(
        rows.select(*part, "period", "category", F.col("share").alias("_share")), part + ["period", "category"], "left"
    ).withColumn("share", F.coalesce("_share", F.lit(0.0)))
    w = Window.partitionBy(*part, "category").orderBy("period_start")
    return full.select(
        *part, "period", "category", first_number(F.col("category")).alias("degree"), "share",
        relative_change(F.col("share"), F.lag("share").over(w)).alias("change"),
    )


def change_top(df: DataFrame, n: int = 18, part=("report", "subject", "grain", "period")) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.desc(F.abs("change")), "ord")
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def series_change(df: DataFrame, values, part, order="period_start") -> DataFrame:
    """Absolute change of densified series; NULL when either side is unknown."""
    w = Window.partitionBy(*part).orderBy(order)
    return df.select("*", *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_change") for v in values])


def last_known(df: DataFrame, names, part, order="step_ord", metric="metric", value="value") -> DataFrame:
    """Last known value of the first name that has one; a known 0 beats an alias."""
    found = [
        F.max_by(value, F.when((F.col(metric) == n) & F.col(value).isNotNull(), F.col(order))) for n in names
    ]
    return df.groupBy(*part).agg(F.coalesce(*found).alias("value"))


def subject_order(subjects: DataFrame, brand_order: DataFrame) -> DataFrame:
    """Group first, then brands in business order, then generations by brand and name."""
    rank = F.create_map(F.lit("group"), F.lit(0), F.lit("brand"), F.lit(1), F.lit("generation"), F.lit(2))
    brand = F.when(F.col("type") == "brand", F.col("name")).otherwise(F.coalesce("parent", F.lit("")))
    joined = subjects.withColumn("_brand", brand).join(
        brand_order.select(F.col("brand").alias("_brand"), F.col("position").alias("_position")), "_brand", "left"
    )
    return joined.select(
        *subjects.columns, rank[F.col("type")].alias("type_order"),
        F.coalesce("_position", F.lit(1_000_000)).alias("brand_order"),
    )


