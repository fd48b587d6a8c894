"""Launch rhythm: order sources per step, cumulative shares, several phases."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import union_all
from ..functions.numbers import complete_sum, finite, observed, observed_rate, safe_rate
from ..labels import (
    LAUNCH_CUM_DIRECT, LAUNCH_CUM_GROSS, LAUNCH_CUM_LOCK, LAUNCH_CUM_SHARE, LAUNCH_CUM_SMALL,
    LAUNCH_CUM_SMALL_RATE, LAUNCH_DAY_SHARE, LAUNCH_DIRECT, LAUNCH_ORDERS, LAUNCH_RETAINED, LAUNCH_SMALL,
)

_PHASE = ["subject", "campaign", "phase", "grain"]
_STEP = _PHASE + ["step", "step_ord", "step_date"]


def _metric(name, value=None):
    return F.max(F.when(F.col("metric") == name, F.col("value") if value is None else value))


def launch_steps(obs: DataFrame) -> DataFrame:
    """One row per step with the quantities the shares need; invalid quantities unknown."""
    known = observed(F.col("value"))
    gross = [_metric(n, known) for n in LAUNCH_CUM_GROSS]
    small = [_metric(n, known) for n in LAUNCH_CUM_SMALL]
    rate = [_metric(n, finite(F.col("value"))) for n in LAUNCH_CUM_SMALL_RATE]
    steps = obs.groupBy(*_STEP).agg(
        _metric(LAUNCH_ORDERS[0], known).alias("orders"),
        F.coalesce(*[_metric(n, known) for n in LAUNCH_RETAINED]).alias("retained"),
        _metric(LAUNCH_SMALL[0], known).alias("small"),
        _metric(LAUNCH_DIRECT[0], known).alias("direct"),
        _metric(LAUNCH_CUM_DIRECT, known).alias("cum_direct"),
        F.coalesce(*gross).alias("cum_gross"),
        F.coalesce(*small).alias("cum_small"),
        *[r.alias(f"small_rate_{i}") for i, r in enumerate(rate)],
        *[s.alias(f"small_{i}") for i, s in enumerate(small)],
        _metric(LAUNCH_CUM_LOCK, finite(F.col("value"))).alias("cum_lock"),
    )
    # A gross row wins even when it is 0; only an unknown gross is rebuilt.
    whole = F.coalesce(F.col("cum_gross"), F.when(F.col("cum_direct").isNotNull(), F.col("cum_small") + F.col("cum_direct")))
    return steps.withColumn("cum_gross", whole)


def direct_share(steps: DataFrame) -> DataFrame:
    """Daily and cumulative share of direct orders; quantities own these shares."""
    return steps.select(
        *_STEP, observed_rate(F.col("direct"), F.col("orders")).alias("day_share"),
        observed_rate(F.col("cum_direct"), F.col("cum_gross")).alias("cum_share"),
    )


def launch_sources(steps: DataFrame) -> DataFrame:
    """Order sources of a step: direct falls back to orders - small; total needs both."""
    direct = F.coalesce("direct", F.col("orders") - F.col("small"))
    return steps.select(*_STEP, "small", direct.alias("direct"), (F.col("small") + direct).alias("total"))


def launch_cumulative(steps: DataFrame) -> DataFrame:
    """Sums of the known steps: unknown steps are skipped, no known step gives 0."""
    return steps.groupBy(*_PHASE).agg(
        F.coalesce(F.sum("orders"), F.lit(0.0)).alias("orders"),
        F.coalesce(F.sum("retained"), F.lit(0.0)).alias("retained"),
    )


def phase_summary(steps: DataFrame) -> DataFrame:
    """Everything the phase cards and the multi-phase totals need, one row per phase."""
    share = observed_rate(F.col("cum_direct"), F.col("cum_gross"))
    known = steps.withColumn("_share", share)
    last_share = F.when(F.col("_share").isNotNull(), F.col("step_ord"))
    empty = F.when((F.col("cum_direct") == 0) & (F.col("cum_gross") == 0), F.col("step_ord"))

    def last(name):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("step_ord")))

    rates = [last(f"small_rate_{i}") for i in range(len(LAUNCH_CUM_SMALL_RATE))]
    smalls = [last(f"small_{i}") for i in range(len(LAUNCH_CUM_SMALL))]
    rows = known.groupBy(*_PHASE).agg(
        F.coalesce(F.sum("orders"), F.lit(0.0)).alias("orders"),
        F.coalesce(F.sum("retained"), F.lit(0.0)).alias("retained"),
        last("cum_lock").alias("locked"),
        F.coalesce(*smalls, F.lit(0.0)).alias("small"),
        F.coalesce(*rates, F.lit(0.0)).alias("small_rate"),
        F.max_by("_share", last_share).alias("direct_share"),
        F.coalesce(F.max_by("cum_direct", last_share), F.max_by("cum_direct", empty)).alias("direct_num"),
        F.coalesce(F.max_by("cum_gross", last_share), F.max_by("cum_gross", empty)).alias("direct_den"),
        F.min_by("step_date", F.when(F.col("step_date").isNotNull(), F.col("step_ord"))).alias("start_date"),
        F.max_by("step_date", F.when(F.col("step_date").isNotNull(), F.col("step_ord"))).alias("end_date"),
        F.count(F.lit(1)).alias("steps"),
    )
    # The base the known rate implies; unknown rates take no part in the weighted rate.
    base = F.when(F.col("small_rate") > 0, safe_rate(F.col("small"), F.col("small_rate"))).otherwise(F.lit(0.0))
    return rows.withColumn("small_base", base)


def phase_gaps(summary: DataFrame) -> DataFrame:
    """Phases in date order with the free days since the phase before."""
    w = Window.partitionBy("subject", "grain").orderBy("start_date", "phase")
    gap = F.datediff("start_date", F.lag("end_date").over(w)) - 1
    return summary.select(
        *summary.columns, F.row_number().over(w).alias("phase_no"),
        F.when(gap.isNotNull(), F.greatest(gap, F.lit(0))).alias("gap_days"),
        (F.lead("phase").over(w).isNull()).alias("is_default"),
    )


def launch_combined(summary: DataFrame) -> DataFrame:
    """Totals over the phases of a subject, each with its own completeness rule."""
    based = F.col("small_base") > 0
    pairs = F.count(F.when(F.col("direct_num").isNotNull() & F.col("direct_den").isNotNull(), 1))
    return summary.groupBy("subject", "grain").agg(
        F.count(F.lit(1)).alias("phases"),
        F.sum("orders").alias("orders"),
        complete_sum(F.col("locked")).alias("locked"),
        safe_rate(F.sum(F.when(based, F.col("small"))), F.sum(F.when(based, F.col("small_base")))).alias("small_rate"),
        F.when(pairs == F.count(F.lit(1)), observed_rate(F.sum("direct_num"), F.sum("direct_den"))).alias("direct_share"),
    )


def metric_matrix(obs: DataFrame, steps: DataFrame) -> DataFrame:
    """All metrics of a phase in long form, with the two derived shares replacing stored ones."""
    derived = direct_share(steps).select(
        *_STEP, F.explode(F.array(
            F.struct(F.lit(LAUNCH_DAY_SHARE).alias("metric"), F.col("day_share").alias("value")),
            F.struct(F.lit(LAUNCH_CUM_SHARE).alias("metric"), F.col("cum_share").alias("value")),
        )).alias("x"),
    ).select(*_STEP, "x.metric", "x.value")
    stored = obs.filter(~F.col("metric").isin(LAUNCH_DAY_SHARE, LAUNCH_CUM_SHARE))
    return stored.select(*_STEP, "metric", finite(F.col("value")).alias("value")).unionByName(derived)


def pair_hourly(phases: DataFrame, hourly: DataFrame) -> DataFrame:
    """Hourly sheet of a phase: by campaign if named, else by phase number, else the only one.

    phases, hourly: subject, campaign ('' if none), phase (NULL if none), sheet. Each way of
    matching is a join by equality, on the first sheet of its key.
    """
    first = F.min_by("sheet", "ord").alias("hourly_sheet")
    key = ["subject", "campaign", "phase", "sheet"]
    named = phases.filter("campaign <> ''").join(hourly.groupBy("subject", "campaign").agg(first), ["subject", "campaign"])
    counted = phases.filter("campaign = '' and phase is not null").join(hourly.groupBy("subject", "phase").agg(first), ["subject", "phase"])
    alone = phases.groupBy("subject").agg(F.count(F.lit(1)).alias("_phases")).filter("_phases = 1").select("subject")
    single = phases.filter("campaign = '' and phase is null").join(alone, "subject").join(hourly.groupBy("subject").agg(first), "subject")
    return union_all([x.select(*key, "hourly_sheet") for x in (named, counted, single)])


def hourly_profile_input(hourly: DataFrame) -> DataFrame:
    """Hourly launch rows: clock hour and the four order figures."""
    return hourly.groupBy("subject", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.coalesce(F.sum(F.when(F.col("metric") == LAUNCH_ORDERS[0], F.col("value"))), F.lit(0.0)).alias("orders"),
        F.coalesce(F.sum(F.when(F.col("metric") == LAUNCH_SMALL[0], F.col("value"))), F.lit(0.0)).alias("small"),
        F.coalesce(F.sum(F.when(F.col("metric") == LAUNCH_DIRECT[0], F.col("value"))), F.lit(0.0)).alias("direct"),
    )
