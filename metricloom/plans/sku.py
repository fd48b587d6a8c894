"""SKU concentration: active SKUs, top-k shares, coverage, long tail."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.compare import comparison

_PAGE = ["subject", "period"]


def align_periods(share: DataFrame, topk: DataFrame) -> DataFrame:
    """All periods of either block per subject, joined by name and never by column offset."""
    return share.select(*_PAGE).unionByName(topk.select(*_PAGE)).distinct()


def complete_counts(share: DataFrame, topk: DataFrame, limit: float = 0.05) -> DataFrame:
    """Active and long-tail SKUs of every page without the grid of SKUs and periods: a page is
    complete when as many SKUs have a known share on it as the subject has at all."""
    codes = share.groupBy("subject").agg(F.countDistinct("code").alias("_codes"))
    pages = share.groupBy(*_PAGE).agg(
        F.countDistinct(F.when(F.col("share").isNotNull(), F.col("code"))).alias("_known"),
        F.count_if(F.col("share") > 0).alias("active"), F.count_if((F.col("share") > 0) & (F.col("share") <= limit)).alias("tail"),
    )
    whole = F.col("_known") == F.col("_codes")
    counted = pages.join(codes, "subject").select(*_PAGE, F.when(whole, F.col("active")).alias("active"), F.when(whole, F.col("tail")).alias("tail"))
    return align_periods(share, topk).join(counted, _PAGE, "left")


def align_sku(share: DataFrame, topk: DataFrame) -> DataFrame:
    """Every SKU at every period of the subject; periods the share block lacks are unknown."""
    codes = share.select("subject", "code", "ord").groupBy("subject", "code").agg(F.min("ord").alias("ord"))
    grid = align_periods(share, topk).join(codes, "subject")
    values = share.select(*_PAGE, "code", "share", F.lit(True).alias("in_block"))
    return grid.join(values, _PAGE + ["code"], "left").select(
        *_PAGE, "code", "ord", "share", F.coalesce("in_block", F.lit(False)).alias("in_block")
    )


def _complete():
    known = F.count("share") == F.count(F.lit(1))
    return known & F.max("in_block")


def active_sku(aligned: DataFrame) -> DataFrame:
    """SKUs with a positive share, known only if every SKU of the period is."""
    return aligned.groupBy(*_PAGE).agg(
        F.when(_complete(), F.count_if(F.col("share") > 0)).alias("active")
    )


def long_tail(aligned: DataFrame, limit: float = 0.05) -> DataFrame:
    return aligned.groupBy(*_PAGE).agg(
        F.when(_complete(), F.count_if((F.col("share") > 0) & (F.col("share") <= limit))).alias("tail")
    )


def topk_share(topk: DataFrame) -> DataFrame:
    """TOP3 and TOP5; TOP5 uses TOP3 when the sheet has no TOP5 row."""
    label = F.upper("label")
    has5 = F.max(label == "TOP5")
    top3 = F.max(F.when(label == "TOP3", F.col("share")))
    top5 = F.max(F.when(label == "TOP5", F.col("share")))
    return topk.groupBy(*_PAGE).agg(top3.alias("top3"), F.when(has5, top5).otherwise(top3).alias("top5"))


def coverage_rank(topk: DataFrame, level: float = 0.8) -> DataFrame:
    """First rank whose cumulative share reaches the level; unknown after an unknown rank."""
    reached = F.min(F.when(F.col("share") >= level, F.col("rank")))
    unknown = F.min(F.when(F.col("share").isNull(), F.col("rank")))
    return topk.groupBy(*_PAGE).agg(
        F.when(unknown.isNull() | (reached < unknown), reached).alias("needed")
    )


def sku_kpis(share: DataFrame, topk: DataFrame) -> DataFrame:
    """Key figures of every page; ``period_start`` of either block is carried along."""
    starts = [b.select(*_PAGE, "period_start") for b in (share, topk) if "period_start" in b.columns]
    pages = complete_counts(share, topk).drop("tail")
    if starts:
        dated = starts[0] if len(starts) == 1 else starts[0].unionByName(starts[1])
        pages = pages.join(dated.groupBy(*_PAGE).agg(F.min("period_start").alias("period_start")), _PAGE, "left")
    return (
        pages
        .join(topk_share(topk), _PAGE, "left")
        .join(coverage_rank(topk), _PAGE, "left")
    )


def sku_comparison(kpis: DataFrame) -> DataFrame:
    """Each figure against the sheet's previous period; ``period_start`` orders the pages."""
    names = ["active", "top3", "top5", "needed"]
    w = Window.partitionBy("subject").orderBy("period_start")
    joined = kpis.select("*", *[F.lag(n).over(w).alias(f"_{n}") for n in names])
    rows = [
        F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value"),
                 comparison(F.col(n).cast("double"), F.col(f"_{n}").cast("double")).alias("comparison"))
        for n in names
    ]
    return joined.select(*_PAGE, F.explode(F.array(*rows)).alias("x")).select(*_PAGE, "x.*")


def sku_rank(aligned: DataFrame) -> DataFrame:
    """Ranking of one page: numbered over all SKUs (unknown as 0), unknown rows left out after."""
    w = Window.partitionBy(*_PAGE).orderBy(F.desc(F.coalesce("share", F.lit(0.0))), "ord")
    return aligned.withColumn("rank", F.row_number().over(w)).filter("share is not null")


def topk_matrix(topk: DataFrame) -> DataFrame:
    """Rank x period, dense: a rank without a value at a period is unknown."""
    ranks = topk.select("subject", "rank", "label").distinct()
    periods = topk.select(*_PAGE).distinct()
    return ranks.join(periods, "subject").join(
        topk.select(*_PAGE, "rank", "share"), _PAGE + ["rank"], "left"
    ).select(*_PAGE, "rank", "label", "share")


def cumulative_topk(share: DataFrame) -> DataFrame:
    """The top-k block itself from SKU shares: cumulative share by rank, for every rank."""
    w = Window.partitionBy(*_PAGE).orderBy(F.desc("share"), "ord")
    top = share.withColumn("rank", F.row_number().over(w))
    running = Window.partitionBy(*_PAGE).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in ("period_start",) if c in share.columns]
    return top.select(
        *_PAGE, *kept, F.concat(F.lit("TOP"), "rank").alias("label"), "rank", F.sum("share").over(running).alias("share")
    )
