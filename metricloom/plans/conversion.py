"""Seven-stage conversion of order cohorts. Unknown quantities stay unknown.

The stages of a cohort are the columns of one row, so the rates between neighbouring
stages are plain column arithmetic and need no window and no shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import observed, observed_rate
from ..labels import STAGES

_COLUMNS = [f"s{i}" for i in range(1, len(STAGES) + 1)]
_KEYS = ["subject", "grain", "period"]


def _known(cohorts: DataFrame) -> DataFrame:
    return cohorts.select(
        *_KEYS, *[observed(F.col(c)).alias(c) for c in _COLUMNS],
        observed(F.col("order_to_lock_days")).alias("order_to_lock_days"),
        observed(F.col("lock_to_delivery_days")).alias("lock_to_delivery_days"),
    )


def _loss(i: int):
    # GREATEST skips NULL, so the unknown difference has to be kept explicitly.
    gap = F.col(_COLUMNS[i - 1]) - F.col(_COLUMNS[i])
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def stage_rates(cohorts: DataFrame) -> DataFrame:
    """One row per cohort and stage: value, share of orders, share of the stage before, loss."""
    known = _known(cohorts)
    rows = []
    for i, stage in enumerate(STAGES):
        now, before = F.col(_COLUMNS[i]), F.col(_COLUMNS[max(i - 1, 0)])
        loss = F.when(now.isNotNull(), F.lit(0.0)) if i == 0 else _loss(i)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("stage_no"), F.lit(stage).alias("stage"), now.alias("value"),
                observed_rate(now, F.col("s1")).alias("total_rate"),
                observed_rate(now, before).alias("stage_rate"), loss.alias("loss"),
            )
        )
    return known.select(*_KEYS, F.explode(F.array(*rows)).alias("x")).select(*_KEYS, "x.*")


def funnel(cohorts: DataFrame) -> DataFrame:
    """Key figures: total rate, orders, delivered, largest loss (only if every loss is known)."""
    known = _known(cohorts)
    losses = [_loss(i) for i in range(1, len(STAGES))]
    complete = F.lit(True)
    for loss in losses:
        complete = complete & loss.isNotNull()
    # The earlier stage wins a tie: compare (loss, -stage number).
    best = F.greatest(*[
        F.struct(F.coalesce(loss, F.lit(-1.0)).alias("loss"), F.lit(-i).alias("order"))
        for i, loss in enumerate(losses, start=1)
    ])
    names = F.array(*[F.lit(s) for s in STAGES])
    return known.select(
        *_KEYS,
        observed_rate(F.col("s7"), F.col("s1")).alias("total_rate"),
        F.col("s1").alias("orders"), F.col("s7").alias("delivered"),
        F.when(complete, best["loss"]).alias("largest_loss"),
        F.when(complete & (best["loss"] > 0), F.element_at(names, 1 - best["order"])).alias("largest_loss_stage"),
    )


def loss_bars(cohorts: DataFrame) -> DataFrame:
    """Positive known losses as a share of the cohort's orders."""
    known = _known(cohorts).filter("s1 > 0")
    rows = [
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(STAGES[i]).alias("stage"), _loss(i).alias("loss"))
        for i in range(1, len(STAGES))
    ]
    return known.select(*_KEYS, "s1", F.explode(F.array(*rows)).alias("x")).filter("x.loss > 0").select(
        *_KEYS, "x.*", (F.col("x.loss") / F.col("s1")).alias("share")
    )


def cohort_matrix(cohorts: DataFrame) -> DataFrame:
    """Total rates of stages 2-7 as columns, durations passed through."""
    return _known(cohorts).select(
        *_KEYS, *[observed_rate(F.col(c), F.col("s1")).alias(f"rate_{c}") for c in _COLUMNS[1:]],
        "order_to_lock_days", "lock_to_delivery_days",
    )
