"""Channel productivity: stores, active stores, orders per store."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import complete_sum, observed, observed_rate
from ..functions.periods import is_summary_period
from ..functions.text import compact_text
from ..labels import ACTIVE_STORES_OLD, CHANNEL, ORDER_REPORTS, QTY, SHARE, STORES
from ..operators.compare import series_change
from ..operators.merge import priority

_PAGE = ["subject", "grain", "period", "period_start"]
_NOT_CHANNELS = ("数量", "总计", "合计", "汇总")


def _order_report():
    """Channels are read from the order report; a lock report has channel rows of its own."""
    return F.col("report").isin(*ORDER_REPORTS)


def effective_store_counts(subjects: DataFrame, counts: DataFrame, overrides: DataFrame, group: str) -> DataFrame:
    """Stores per subject and channel: brand table, then the brand's override, then its own.

    The group adds up all configured brands, unknown as soon as one brand's number is. A
    generation only ever inherits from its own brand. Result: subject, channel, stores.
    """
    base = counts.select(compact_text(F.col("brand")).alias("_k"), "channel", F.col("n").cast("double").alias("n"))
    own = overrides.select(compact_text(F.col("subject")).alias("_k"), "channel", F.col("n").cast("double").alias("n"))
    brands = subjects.filter("type = 'brand'").select("name").unionByName(counts.select(F.col("brand").alias("name"))).distinct()
    brand = brands.select("name", compact_text(F.col("name")).alias("_k"))
    child = subjects.filter("type = 'generation' and parent is not null").select("name", compact_text(F.col("parent")).alias("_k"))
    itself = subjects.filter("type = 'generation'").select("name", compact_text(F.col("name")).alias("_k"))

    def take(names, table, level):
        return names.join(table, "_k").select(F.col("name").alias("subject"), "channel", "n", F.lit(level).alias("level"))

    def resolve(layers):
        return layers.groupBy("subject", "channel").agg(observed(F.max_by("n", "level")).alias("stores"))

    of_brands = resolve(take(brand, base, 1).unionByName(take(brand, own, 2)))
    of_children = resolve(take(child, base, 1).unionByName(take(child, own, 2)).unionByName(take(itself, own, 3)))
    whole = of_brands.groupBy(F.lit(group).alias("subject"), "channel").agg(complete_sum(F.col("stores")).alias("stores"))
    return of_brands.unionByName(of_children).unionByName(whole)


def channel_universe(obs: DataFrame) -> DataFrame:
    """Channels are the categories of the channel block, in source order; old rows add none."""
    rows = obs.filter(_order_report() & (F.col("metric") == CHANNEL) & F.col("stat").isin(QTY, SHARE, STORES))
    named = rows.filter(~F.col("category").isin(*_NOT_CHANNELS) & (F.col("category") != ""))
    return named.groupBy("subject", "grain", F.col("category").alias("channel")).agg(F.min("row_ord").alias("ord"))


def channel_values(obs: DataFrame) -> DataFrame:
    """count, share and active stores of every channel at every period, unknown as NULL.

    One aggregate over the observations; the dense grid is built from its small result. The
    new active-store layout wins wherever it has a physical cell, blank included.
    """
    detail = obs.filter(_order_report() & ~is_summary_period(F.col("period"), "channel"))
    in_block = (F.col("metric") == CHANNEL) & F.col("stat").isin(QTY, SHARE, STORES)
    new = (F.col("metric") == CHANNEL) & (F.col("stat") == STORES)
    old = (F.col("metric") == ACTIVE_STORES_OLD) & (F.col("stat") == QTY)
    value, order = observed(F.col("value")), priority()
    known = F.col("value").isNotNull()
    named = ~F.col("category").isin(*_NOT_CHANNELS) & (F.col("category") != "")
    cells = detail.groupBy(*_PAGE, F.col("category").alias("channel")).agg(
        F.min(F.when(in_block & named, F.col("row_ord"))).alias("ord"),
        F.max(F.when(in_block & (F.col("stat") == QTY), value)).alias("n"),
        F.max(F.when(in_block & (F.col("stat") == SHARE) & (value <= 1), value)).alias("share"),
        F.max(new).alias("_new"),
        F.min_by("value", F.when(new & known, order)).alias("_active_new"),
        F.min_by("value", F.when(old & known, order)).alias("_active_old"),
    )
    universe = cells.filter("ord is not null").groupBy("subject", "grain", "channel").agg(F.min("ord").alias("ord"))
    grid = cells.select(*_PAGE).distinct().join(universe, ["subject", "grain"])
    active = F.when(F.col("_new"), F.col("_active_new")).otherwise(F.col("_active_old"))
    found = cells.select("subject", "grain", "period", "channel", "n", "share", observed(active).alias("active"))
    return grid.join(found, ["subject", "grain", "period", "channel"], "left").select(
        *_PAGE, "channel", "ord", "n", "share", "active"
    )


def channel_ratios(values: DataFrame, stores: DataFrame) -> DataFrame:
    """active_rate (withheld when more active than existing stores) and productivity."""
    joined = values.join(stores, ["subject", "channel"], "left")
    wrong = F.coalesce(F.col("active") > F.col("stores"), F.lit(False))
    return joined.select(
        *values.columns, "stores", wrong.alias("inconsistent"),
        F.when(~wrong, observed_rate(F.col("active"), F.col("stores"))).alias("active_rate"),
        observed_rate(F.col("n"), F.col("stores")).alias("productivity"),
    )


def channel_change(ratios: DataFrame) -> DataFrame:
    """Absolute change of each figure against the subject's previous period.

    The input is dense (every channel at every period), so the row before is the period before.
    """
    return series_change(ratios, ["n", "share", "active_rate", "productivity"], ["subject", "grain", "channel"])


def channel_totals(ratios: DataFrame, stores: DataFrame) -> DataFrame:
    """Totals; the denominator holds all configured channels, also those without rows."""
    configured = stores.groupBy("subject").agg(complete_sum(F.col("stores")).alias("_configured"))
    active_unconfigured = F.col("stores").isNull() & (
        (F.coalesce("n", F.lit(-1.0)) != 0) | (F.coalesce("active", F.lit(-1.0)) != 0)
    )
    sums = ratios.groupBy(*_PAGE).agg(
        complete_sum(F.col("n")).alias("n"), complete_sum(F.col("active")).alias("active"),
        F.max(active_unconfigured).alias("_open"), F.max("inconsistent").alias("_wrong"),
    )
    joined = sums.join(configured, "subject", "left")
    total = F.when(~F.col("_open"), F.col("_configured"))
    return joined.select(
        *_PAGE, "n", "active", total.alias("stores"),
        F.when(~F.col("_wrong"), observed_rate(F.col("active"), total)).alias("active_rate"),
        observed_rate(F.col("n"), total).alias("productivity"),
    )


def channel_kpis(totals: DataFrame) -> DataFrame:
    rows = F.array(
        F.struct(F.lit("channel_orders").alias("label"), F.col("n").alias("value")),
        F.struct(F.lit("active_stores").alias("label"), F.col("active").alias("value")),
        F.struct(F.lit("active_rate").alias("label"), (F.col("active_rate") * 100).alias("value")),
        F.struct(F.lit("productivity").alias("label"), F.col("productivity").alias("value")),
    )
    return totals.select(F.lit("channel_analysis").alias("module"), *_PAGE, F.explode(rows).alias("x")).select(
        "module", *_PAGE, "x.label", "x.value"
    )


def visible_channels(ratios: DataFrame) -> DataFrame:
    """Channels configured to exactly 0 are hidden; unconfigured ones stay."""
    return ratios.filter(~F.col("stores").eqNullSafe(F.lit(0.0)))


def history_until(df: DataFrame, day) -> DataFrame:
    return df.filter(F.col("period_start") <= day)


def store_inconsistencies(ratios: DataFrame, examples: int = 3) -> DataFrame:
    """Channels with more active than existing stores: count, runs of periods, first examples.

    Runs follow the subject's own period sequence. One window and two aggregates share one
    partitioning by (subject, channel, grain).
    """
    keys = ["subject", "channel", "grain"]
    w = Window.partitionBy(*keys).orderBy("period_start", "period")
    numbered = ratios.withColumn("_at", F.row_number().over(w)).filter("inconsistent")
    text = F.concat_ws(":", "period", F.col("active").cast("bigint").cast("string"), F.col("stores").cast("bigint").cast("string"))
    marked = numbered.withColumn("_rn", F.row_number().over(w)).withColumn("_text", text)
    runs = marked.groupBy(*keys, (F.col("_at") - F.col("_rn")).alias("_run")).agg(
        F.min("_at").alias("_first"), F.min_by("period", "_at").alias("a"), F.max_by("period", "_at").alias("b"),
        F.count(F.lit(1)).alias("n"),
        F.collect_list(F.when(F.col("_rn") <= examples, F.struct("_rn", "_text"))).alias("_ex"),
    )
    span = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit("～"), "b"))
    packed = runs.groupBy(*keys).agg(
        F.sum("n").alias("cells"),
        F.array_sort(F.collect_list(F.struct("_first", span.alias("t")))).alias("_runs"),
        F.array_sort(F.flatten(F.collect_list("_ex"))).alias("_ex"),
    )
    return packed.select(
        *keys, "cells", F.array_join(F.transform("_runs", lambda r: r["t"]), "、").alias("ranges"),
        F.array_join(F.transform("_ex", lambda r: r["_text"]), "; ").alias("examples"),
    )


def channel_panel(obs: DataFrame, stores: DataFrame):
    """The whole channel analysis: per-channel rows with changes, and totals."""
    ratios = channel_ratios(channel_values(obs), stores)
    return channel_change(ratios), channel_totals(ratios, stores)


