"""The analyses by name: which tables they read and the key figures they give.

Every entry returns the same columns (module, subject, grain, period, label, value), so all
analyses of all subjects are one union, one comparison and one publication. A subject that
has no data for an analysis simply has no rows.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period_start
from ..labels import ALL_PERIODS
from ..operators.compare import kpi_comparison, structure_change
from ..operators.ordered import union_all
from ..operators.quality import import_health
from ..sources.cells import raw_tables
from ..sources.reports import publish, published_version
from . import cancellation, channel, conversion, fee, launch, overview, sku, structures

COLUMNS = ["module", "subject", "grain", "period", "label", "value"]


@dataclass(frozen=True)
class Analysis:
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]


def dated(df: DataFrame) -> DataFrame:
    """Adds the first day that the period's label names; figures compare in that order."""
    return df.withColumn("period_start", period_start(F.col("period")))


def figures(df: DataFrame, module: str | Column, values: dict, subject="subject", grain="", period="", start="") -> DataFrame:
    """Wide key figures as long rows; grain and period are column names or fixed texts, the module a fixed
    text or a column. ``start`` is the column that orders periods whose labels name no day."""
    def text(name):
        return F.col(name) if name in df.columns else F.lit(name)
    rows = F.array(*[F.struct(F.lit(label).alias("label"), c.cast("double").alias("value")) for label, c in values.items()])
    long = df.select(
        (F.lit(module) if isinstance(module, str) else module).alias("module"), F.col(subject).alias("subject"), text(grain).alias("grain"), text(period).alias("period"),
        *([F.col(start).alias("period_start")] if start else []), F.explode(rows).alias("x"),
    )
    shown = long.select("module", "subject", "grain", "period", "x.label", "x.value", *(["period_start"] if start else []))
    return shown if start else dated(shown)


def overview_figures(observations: DataFrame) -> DataFrame:
    return dated(overview.overview_kpis(overview.overview_base(observations)).select(*COLUMNS))


def channel_figures(channel_observations: DataFrame, stores: DataFrame) -> DataFrame:
    _, totals = channel.channel_panel(channel_observations, stores)
    return dated(channel.channel_kpis(totals).select(*COLUMNS))


def mix_figures(mix_observations: DataFrame) -> DataFrame:
    kpis = structures.mix_kpis(structure_change(structures.structures(mix_observations)))
    # The report names the module: order_mix, lock_mix or small_order_mix.
    return figures(kpis, F.col("report"), {
        "dimensions": F.col("dimensions"), "options": F.col("options"), "leading_share": F.col("leading_share") * 100,
        "focused": F.col("focused"), "max_change": F.col("max_change") * 100,
    }, grain="grain", period="period")


def conversion_figures(cohorts: DataFrame) -> DataFrame:
    return figures(conversion.funnel(cohorts), "conversion", {
        "total_rate": F.col("total_rate") * 100, "orders": F.col("orders"), "delivered": F.col("delivered"), "largest_loss": F.col("largest_loss"),
    }, grain="grain", period="period")


def cancellation_figures(rhythm: DataFrame) -> DataFrame:
    """rhythm: subject, campaign, day, orders, cancel."""
    totals = cancellation.campaign_totals(cancellation.rhythm_rates(rhythm))
    values = ["orders", "retained", "cancel", "retention_rate"]
    starts = rhythm.groupBy("subject", "campaign").agg(F.min("day").alias("period_start"))
    pages = totals.join(starts, ["subject", "campaign"]).select("subject", F.col("campaign").alias("period"), "period_start", *values)
    whole = cancellation.combined_totals(totals).select("subject", F.lit(ALL_PERIODS).alias("period"), F.lit(None).cast("date").alias("period_start"), *values)
    both = pages.withColumn("period_start", F.col("period_start").cast("date")).unionByName(whole)
    return figures(both, "cancellation", {
        "orders": F.col("orders"), "retained": F.col("retained"), "cancel": F.col("cancel"), "retention": F.col("retention_rate") * 100,
    }, grain="day", period="period", start="period_start")


def launch_figures(launch_observations: DataFrame) -> DataFrame:
    combined = launch.launch_combined(launch.phase_summary(launch.launch_steps(launch_observations)))
    return figures(combined, "launch_rhythm", {
        "orders": F.col("orders"), "locked": F.col("locked"), "small_rate": F.col("small_rate") * 100, "direct_share": F.col("direct_share") * 100,
    }, grain="grain", period="all")


def fee_brand_figures(fee_rows: DataFrame, fee_rank: DataFrame) -> DataFrame:
    cards = fee.rank_cards(fee_rank)
    totals = fee.fee_band_totals(fee.fee_orders(fee_rows))
    joined = (
        fee.covered_generations(cards).join(fee.brand_avg_option(fee_rows), "brand", "left")
        .join(fee.paid_share(totals), "brand", "left").join(fee.top_penetration(cards).select("brand", "percent"), "brand", "left")
    )
    zero = F.lit(0.0)
    return figures(joined, "option_fee", {
        "generations": F.col("generations"), "avg_option": F.coalesce("avg_option", zero),
        "paid_percent": F.coalesce("paid_percent", zero), "top_percent": F.coalesce("percent", zero),
    }, subject="brand", grain="month", period="all")


def fee_generation_figures(fee_rows: DataFrame) -> DataFrame:
    """Latest month of each generation: option and actual amount, best paid item."""
    best = fee.top_paid(fee.weighted_penetration(fee_rows, "paid"))
    months = fee.fee_month_totals(fee_rows)
    joined = best.join(months, ["generation", "period"], "left")
    return figures(joined, "option_fee", {
        "option_total": F.bround("option_total", 0), "actual_total": F.bround("actual_total", 0), "best_paid": F.bround(F.col("rate") * 100, 0),
    }, subject="generation", grain="month", period="period")


def sku_figures(sku_share: DataFrame, sku_topk: DataFrame) -> DataFrame:
    return figures(sku.sku_kpis(sku_share, sku_topk), "sku", {
        "active": F.col("active"), "top3": F.col("top3") * 100, "top5": F.col("top5") * 100, "needed": F.col("needed"),
    }, grain="week", period="period")


def generic_figures(sheet_status: DataFrame) -> DataFrame:
    """How the sheets of each subject were taken in. sheet_status: import_status()."""
    names = ("unmatched", "recognised", "to_check", "files", "unmatched_numeric")
    return figures(import_health(sheet_status), "generic", {n: F.col(n) for n in names}, grain="week", period=ALL_PERIODS)


def raw_figures(cells: DataFrame) -> DataFrame:
    """Size of every sheet's raw table: the file stands as subject, the sheet as period."""
    last = F.array_max(F.map_keys("values"))
    sizes = raw_tables(cells).groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("rows"), F.max(last).alias("columns"))
    return figures(sizes, "raw", {"rows": F.col("rows"), "columns": F.col("columns")}, subject="file", period="sheet")


ANALYSES = {
    "overview": Analysis(("observations",), overview_figures),
    "channel_analysis": Analysis(("channel_observations", "stores"), channel_figures),
    "order_mix": Analysis(("mix_observations",), mix_figures),
    "conversion": Analysis(("cohorts",), conversion_figures),
    "cancellation": Analysis(("rhythm",), cancellation_figures),
    "launch_rhythm": Analysis(("launch_observations",), launch_figures),
    "option_fee_brand": Analysis(("fee_rows", "fee_rank"), fee_brand_figures),
    "option_fee_generation": Analysis(("fee_rows",), fee_generation_figures),
    "sku": Analysis(("sku_share", "sku_topk"), sku_figures),
    "generic": Analysis(("sheet_status",), generic_figures),
    "raw": Analysis(("cells",), raw_figures),
}


def build_all(tables: dict, names=None) -> DataFrame:
    """Key figures of all analyses whose input tables are given."""
    chosen = [a for n, a in ANALYSES.items() if (names is None or n in names) and all(i in tables for i in a.inputs)]
    return union_all([a.build(*[tables[i] for i in a.inputs]) for a in chosen])


def run_batch(tables: dict, root: str, batch_id: str, manifest: DataFrame = None, code_version: str = "") -> None:
    """Compute, compare and publish one batch; a failed job, or another batch published meanwhile, leaves
    the current batch in place."""
    spark = next(iter(tables.values())).sparkSession
    seen = published_version(spark, root)
    compared = kpi_comparison(build_all(tables))
    publish(compared.drop("period_start"), root, batch_id, manifest, code_version, seen)
