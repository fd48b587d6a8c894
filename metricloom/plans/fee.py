"""Option amounts: bands, penetration, totals, rights, ranked items."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_combined_generation, normalize_band, parse_rank_item
from ..functions.numbers import norm_number, safe_rate
from ..functions.periods import period_start
from ..labels import BAND_ORDER, FREE_BAND

SUMMARIES = ("汇总", "合计", "总计")


def _zero(name: str = "value"):
    return F.coalesce(name, F.lit(0.0))


def fee_orders(fee: DataFrame) -> DataFrame:
    """Order counts per generation, month and band; summary columns left out."""
    rows = fee.filter("row_kind = 'orders'").filter(
        ~F.col("period").isin(*SUMMARIES) & ~F.col("band").isin(*SUMMARIES)
    )
    return rows.groupBy("brand", "generation", "period", normalize_band(F.col("band")).alias("band")).agg(
        F.sum(_zero()).alias("n"), F.min("col_ord").alias("col_ord")
    )


def band_position(band):
    """Known bands in business order, others after them in the order first seen."""
    lookup = F.create_map(*[F.lit(x) for i, b in enumerate(BAND_ORDER) for x in (b, i)])
    return lookup[band]


def band_order(orders: DataFrame) -> DataFrame:
    """Unified band list of a brand."""
    seen = orders.groupBy("brand", "band").agg(F.min("col_ord").alias("_seen"))
    known = band_position(F.col("band"))
    w = Window.partitionBy("brand").orderBy(F.coalesce(known, F.lit(len(BAND_ORDER))), "_seen", "band")
    return seen.select("brand", "band", F.row_number().over(w).alias("position"))


def fee_band_totals(orders: DataFrame) -> DataFrame:
    """Band totals over all months of every generation; bands it does not use are 0.

    Combined generations stay out, they would count twice.
    """
    own = orders.filter(~is_combined_generation(F.col("generation")))
    sums = own.groupBy("brand", "generation", "band").agg(F.sum("n").alias("n"))
    grid = own.select("brand", "generation").distinct().join(band_order(own), "brand")
    return grid.join(sums, ["brand", "generation", "band"], "left").select(
        "brand", "generation", "band", "position", _zero("n").alias("n")
    )


def fee_band_share(totals: DataFrame, part=("brand", "generation")) -> DataFrame:
    w = Window.partitionBy(*part)
    return totals.select(*totals.columns, safe_rate(F.col("n"), F.sum("n").over(w)).alias("share"))


def paid_share(totals: DataFrame) -> DataFrame:
    """Orders in paid bands over all orders of a brand, in whole percent, half to even."""
    paid = F.sum(F.when(F.col("band").contains(FREE_BAND), F.lit(0.0)).otherwise(F.col("n")))
    rate = F.try_divide(paid, F.sum("n")) * 100
    return totals.groupBy("brand").agg(F.coalesce(F.bround(rate, 0), F.lit(0.0)).alias("paid_percent"))


def brand_avg_option(fee: DataFrame) -> DataFrame:
    """Unweighted mean of the version amounts, taken from the labelled total column."""
    rows = fee.filter("row_kind = 'option_amount'").filter(
        F.col("period").isin(*SUMMARIES) & ~is_combined_generation(F.col("generation")) & ~F.col("label").isin(*SUMMARIES)
    )
    return rows.groupBy("brand").agg(F.bround(F.avg(_zero()), 0).alias("avg_option"))


def weighted_penetration(fee: DataFrame, kind: str = "penetration") -> DataFrame:
    """Item rates of a month weighted by the band's orders."""
    orders = fee_orders(fee).select("generation", "period", "band", "n")
    rates = fee.filter(F.col("row_kind") == kind).filter(~F.col("period").isin(*SUMMARIES) & ~F.col("band").isin(*SUMMARIES))
    rates = rates.select("generation", "period", normalize_band(F.col("band")).alias("band"), "grp", "label", "value")
    months = orders.groupBy("generation", "period").agg(F.sum("n").alias("_orders"))
    weighted = rates.join(orders, ["generation", "period", "band"]).groupBy("generation", "period", "grp", "label").agg(
        F.sum(_zero("value") * F.col("n")).alias("_w")
    )
    return weighted.join(months, ["generation", "period"]).select(
        "generation", "period", "grp", "label", safe_rate(F.col("_w"), F.col("_orders")).alias("rate")
    )


def _block_value():
    """Labelled total of a month block first, else the first numeric band (a true 0 wins)."""
    order = F.col("col_ord") + F.when(F.col("band").isin(*SUMMARIES), 0).otherwise(1 << 20)
    return F.coalesce(F.min_by("value", F.when(F.col("value").isNotNull(), order)), F.lit(0.0))


def fee_month_totals(fee: DataFrame) -> DataFrame:
    """Option and actual total of every month: rows labelled 合计 first, else the last total row.

    row_kind 'option_total' / 'actual_total'; grp holds the row label, col_ord the column,
    row_ord the row.
    """
    rows = fee.filter(F.col("row_kind").isin("option_total", "actual_total") & ~F.col("period").isin(*SUMMARIES))
    per_row = rows.groupBy("generation", "period", "row_kind", "grp", "row_ord").agg(_block_value().alias("value"))
    rank = F.col("row_ord") + F.when(F.col("grp") == "合计", 1 << 20).otherwise(0)
    picked = per_row.groupBy("generation", "period", "row_kind").agg(F.max_by("value", rank).alias("value"))
    return picked.groupBy("generation", "period").agg(
        F.coalesce(F.max(F.when(F.col("row_kind") == "option_total", F.col("value"))), F.lit(0.0)).alias("option_total"),
        F.coalesce(F.max(F.when(F.col("row_kind") == "actual_total", F.col("value"))), F.lit(0.0)).alias("actual_total"),
    )


def version_amounts(fee: DataFrame) -> DataFrame:
    """Option and actual amount per version and month, and the deducted part."""
    rows = fee.filter(F.col("row_kind").isin("option_amount", "actual_amount") & ~F.col("period").isin(*SUMMARIES))
    per_kind = rows.groupBy("generation", "period", "label", "row_kind").agg(_block_value().alias("value"))
    wide = per_kind.groupBy("generation", "period", "label").agg(
        F.max(F.when(F.col("row_kind") == "option_amount", F.col("value"))).alias("option_amount"),
        F.max(F.when(F.col("row_kind") == "actual_amount", F.col("value"))).alias("actual_amount"),
    ).filter("option_amount is not null and actual_amount is not null")
    return wide.withColumn(
        "deduction", safe_rate(F.col("option_amount") - F.col("actual_amount"), F.col("option_amount"))
    )


def rank_cards(rank: DataFrame) -> DataFrame:
    """Ranked items of every generation (combined ones included)."""
    return rank.filter("rank > 0").withColumn("item", parse_rank_item(F.col("item_text"))).filter("item is not null").select(
        "brand", "generation", "rank", "ord", "item.label", "item.rate", "item.amount"
    )


def covered_generations(cards: DataFrame) -> DataFrame:
    return cards.groupBy("brand").agg(F.countDistinct("generation").alias("generations"))


def top_penetration(cards: DataFrame) -> DataFrame:
    """Best first-ranked item of a brand; the first one on ties."""
    best = F.struct("rate", (-F.col("ord")).alias("o"))
    return cards.filter("rank = 1 and rate > 0").groupBy("brand").agg(
        F.max_by("label", best).alias("label"), F.bround(F.max("rate") * 100, 0).alias("percent")
    )


def top_paid(rates: DataFrame) -> DataFrame:
    """Best paid item of each generation's latest month; label order breaks ties."""
    dated = rates.withColumn("_start", period_start(F.col("period")))
    last = Window.partitionBy("generation")
    latest = dated.withColumn("_last", F.max("_start").over(last)).filter("_start = _last")
    w = Window.partitionBy("generation").orderBy(F.desc("rate"), "grp", "label")
    return latest.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        "generation", "period", "grp", "label", "rate"
    )


def rights(df: DataFrame) -> DataFrame:
    """Rights amount from the labelled value, else from whatever stands in the first two cells."""
    text = F.when(F.col("label") == "权益金额", F.col("value_text")).otherwise(F.concat_ws(" ", "label", "value_text"))
    return df.select("generation", F.coalesce(norm_number(text), F.lit(0.0)).alias("amount"), F.coalesce("content", F.lit("")).alias("content"))


def fee_free_only(totals: DataFrame) -> DataFrame:
    """Generations whose orders all sit in the free band: the header was probably misread."""
    free = F.sum(F.when(F.col("band") == FREE_BAND, F.col("n")).otherwise(F.lit(0.0)))
    paid = F.sum(F.when(F.col("band").contains(FREE_BAND), F.lit(0.0)).otherwise(F.col("n")))
    return totals.groupBy("brand", "generation").agg(free.alias("free_orders"), paid.alias("paid_orders")).filter(
        "free_orders > 0 and paid_orders = 0"
    )


def fee_column_order(fee: DataFrame) -> DataFrame:
    """Display position of a column: month, bands in source order, the month's total last."""
    total = F.col("band").isin(*SUMMARIES)
    w = Window.partitionBy("generation").orderBy(F.col("period").isin(*SUMMARIES), period_start(F.col("period")), total, "col_ord")
    columns = fee.groupBy("generation", "period", "band").agg(F.min("col_ord").alias("col_ord"))
    return columns.select("generation", "period", "band", F.row_number().over(w).alias("position"))
