"""Counts and shares of configuration dimensions: join, leaders, key figures."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..labels import QTY, SHARE

PAGE = ("report", "subject", "grain", "period")


def structures(obs: DataFrame) -> DataFrame:
    """Share rows with their count, whatever the row order; a share without a count keeps
    a NULL count, a count without a share adds no row."""
    keys = ["report", "subject", "grain", "period", "period_start", "metric", "category"]
    rows = obs.filter(F.col("stat").isin(QTY, SHARE) & (F.col("category") != QTY))
    share, count = F.col("stat") == SHARE, F.col("stat") == QTY
    wide = rows.groupBy(*keys).agg(
        F.max(F.when(share, F.lit(1))).alias("_has"),
        F.max(F.when(share, F.col("value"))).alias("share"),
        F.max(F.when(count, F.col("value"))).alias("n"),
        F.min(F.when(share, F.col("row_ord"))).alias("ord"),
    )
    return wide.filter("_has = 1").select(*keys, F.coalesce("share", F.lit(0.0)).alias("share"), "n", "ord")


def dimension_leaders(df: DataFrame) -> DataFrame:
    """Largest share per dimension, the first one in source order on ties."""
    w = Window.partitionBy(*PAGE, "metric").orderBy(F.desc("share"), "ord")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def mix_kpis(changed: DataFrame) -> DataFrame:
    """Dimensions, options, leading share, concentrated dimensions, largest change."""
    per_dimension = changed.groupBy(*PAGE, "metric").agg(
        F.max("share").alias("top"), F.count(F.lit(1)).alias("options"), F.max(F.abs("change")).alias("moved")
    )
    return per_dimension.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("dimensions"),
        F.sum("options").alias("options"),
        F.max("top").alias("leading_share"),
        F.count_if(F.col("top") >= 0.5).alias("focused"),
        F.max("moved").alias("max_change"),
    )


def normalise_parts(df: DataFrame, part, value: str = "value", count: str = "n") -> DataFrame:
    """Part-of-whole output: positive parts only, their share, total count if all are known."""
    w = Window.partitionBy(*part)
    positive = df.filter(F.col(value) > 0)
    return positive.select(
        *df.columns,
        (F.col(value) / F.sum(value).over(w)).alias("part"),
        F.when(F.count(count).over(w) == F.count(F.lit(1)).over(w), F.sum(count).over(w)).alias("total_count"),
    )
