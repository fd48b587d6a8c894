"""Union of several exports of one report.

Base rule: per business key the first non-blank value in source order wins, a true 0 is
a value, nothing is summed. Exceptions, each with its own proof: quantities of a calendar
boundary week split over two adjoining exports, distinct store counts with a proven empty
side, and ratios rebuilt from merged counts.

All steps are grouped aggregates with map-side combine; no step gathers the pieces of a
key in one place, so a key with very many copies costs no more than its partial results.
Priority is one number per piece (file order, then row order), which keeps the aggregate
buffers fixed-width and the aggregation hash-based instead of sort-based.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cardinality, observed, observed_rate, same_value
from ..functions.periods import is_summary_period, period_key
from ..functions.text import clean_text
from ..labels import (
    ACTIVE_STORES_OLD, CHANNEL, COUNT_BLOCKS, PRIMARY_BY_REPORT, QTY, QUANTITY_LABELS,
    RATIO_WORDS, RETAINED, RETAINED_OLD, SHARE, STORES,
)
from .coverage import with_side
from .lineage import cut_lineage
from .ordered import cell_rectangles, compress_labels, range_text

OBS_KEYS = ["report", "subject", "grain", "metric", "stat", "category", "period"]
_NOT_ADDABLE = "|".join(re.escape(word) for word in RATIO_WORDS)


def is_store_field(metric="metric", stat="stat") -> Column:
    m, s = F.col(metric), F.col(stat)
    return ((m == ACTIVE_STORES_OLD) & (s == QTY)) | ((m == CHANNEL) & (s == STORES))


def is_quantity(metric="metric", stat="stat", category="category", fmt: str = None) -> Column:
    """Fields that may be added across exports."""
    labels = [F.coalesce(F.col(c), F.lit("")) for c in (metric, stat, category)]
    text = F.concat_ws("|", *labels)
    named = labels[0].isin(*QUANTITY_LABELS) | labels[1].isin(*QUANTITY_LABELS) | labels[2].isin(*QUANTITY_LABELS)
    plain = ~F.coalesce(F.col(fmt), F.lit("")).rlike("[%％]") if fmt else F.lit(True)
    return plain & ~F.coalesce(is_store_field(metric, stat), F.lit(False)) & ~text.rlike(_NOT_ADDABLE) & named


def unify_labels(obs: DataFrame) -> DataFrame:
    """One spelling per metric and period before keys are compared."""
    metric = clean_text(F.col("metric"))
    return obs.withColumn("metric", F.when(metric == RETAINED_OLD, RETAINED).otherwise(metric)).withColumn(
        "period", period_key(F.col("period"))
    )


def priority() -> Column:
    """File order first, row order inside the file, as one number."""
    return F.col("source_order").cast("bigint") * F.lit(1 << 31) + F.col("row_ord")


def _file_of(order: Column) -> Column:
    return F.floor(order / F.lit(1 << 31)).cast("int")


def merge_pieces(pieces: DataFrame, keys, coverage: DataFrame = None) -> DataFrame:
    """First non-blank value per key, plus the boundary-week second piece.

    pieces: keys, period, value, raw, source_order, row_ord, quantity. Result: keys, value,
    source_order, first_value, second_value, second_order, added.
    """
    keys = list(keys)
    present = pieces.filter(F.col("value").isNotNull() | F.col("raw").isNotNull())
    if coverage is None:
        present = present.withColumn("is_left", F.lit(None).cast("boolean"))
    else:
        present = with_side(present, coverage)
    present = present.withColumn("_ord", priority())
    first = present.groupBy(*keys).agg(
        F.min_by("value", "_ord").alias("first_value"),
        F.min("_ord").alias("_first"),
        F.min_by("is_left", "_ord").alias("_left"),
    )
    if coverage is None:
        merged = first.withColumn("second_value", F.lit(None).cast("double")).withColumn(
            "_second", F.lit(None).cast("bigint")
        )
    else:
        # Only boundary-week quantities with a proven side can be a second piece.
        open_first = first.filter("_left is not null and first_value >= 0")
        candidates = present.filter("quantity and boundary is not null and is_left is not null").filter(
            observed(F.col("value")).isNotNull()
        )
        second = (
            candidates.join(open_first, keys)
            .filter("is_left <> _left and value <> first_value")
            .groupBy(*keys)
            .agg(F.min_by("value", "_ord").alias("second_value"), F.min("_ord").alias("_second"))
        )
        merged = first.join(second, keys, "left")
    added = F.col("second_value").isNotNull()
    return merged.select(
        *keys,
        F.when(added, F.col("first_value") + F.col("second_value")).otherwise(F.col("first_value")).alias("value"),
        _file_of(F.col("_first")).alias("source_order"),
        "first_value",
        "second_value",
        _file_of(F.col("_second")).alias("second_order"),
        added.alias("added"),
        F.col("_left").alias("first_is_left"),
    )


def observation_pieces(obs: DataFrame, drop_summaries: bool = True) -> DataFrame:
    """Observations with unified labels and the addable flag, ready for merging."""
    pieces = unify_labels(obs)
    if drop_summaries:
        pieces = pieces.filter(~is_summary_period(F.col("period"), "parse"))
    return pieces.withColumn("quantity", is_quantity("metric", "stat", "category", "fmt"))


def merge_sources(obs: DataFrame, coverage: DataFrame = None) -> DataFrame:
    """Metric sheets: base rule and boundary-week addition."""
    return merge_pieces(observation_pieces(obs), OBS_KEYS, coverage)


def add_boundary_weeks(obs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Only the weeks that were added, with both pieces."""
    return merge_sources(obs, coverage).filter("added")


def merge_distinct_stores(obs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Store counts of boundary weeks: known only for one left and one right export with a 0.

    Result: report, subject, grain, period, category, value, reason, known.
    """
    sheet = ["report", "subject", "grain", "period"]
    pieces = with_side(unify_labels(obs), coverage).filter("boundary is not null")
    files = pieces.groupBy(*sheet, "source_order").agg(F.max("is_left").alias("is_left"))
    stores = pieces.filter(is_store_field()).withColumn(
        "layout", F.when(F.col("stat") == STORES, 2).otherwise(1)
    ).withColumn("n", F.when(F.col("raw").isNull(), cardinality(F.col("value"))))
    # Inside one file the new layout beats the old one, an explicit blank included.
    per_format = stores.groupBy(*sheet, "category", "source_order", "layout").agg(
        F.min("n").alias("low"), F.max("n").alias("high"),
        (F.count("n") == F.count(F.lit(1))).alias("complete"),
    )
    per_file = per_format.groupBy(*sheet, "category", "source_order").agg(
        F.max_by(
            F.when(F.col("complete") & (F.col("low") == F.col("high")), F.col("low")), "layout"
        ).alias("n")
    )
    # Absence matters: a channel is complete only if every export that shows the period
    # has a known number for it, which the two counts tell without a grid.
    shown = files.groupBy(*sheet).agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("is_left")).alias("lefts"),
        F.count_if(~F.col("is_left")).alias("rights"),
    ).filter("lefts > 0 and rights > 0")
    judged = per_file.groupBy(*sheet, "category").agg(
        F.count("n").alias("knowns"), F.min("n").alias("low"), F.max("n").alias("high"),
    ).join(shown, sheet)
    pair = F.expr("sources = 2 and lefts = 1 and rights = 1")
    complete = F.expr("knowns = sources")
    return judged.select(
        *sheet, "category",
        F.when(pair & complete & (F.col("low") == 0), F.col("high")).alias("value"),
        F.when(~pair, "extra source").when(~complete, "unknown side").when(
            F.col("low") > 0, "both sides have stores"
        ).otherwise("one side is empty").alias("reason"),
        (pair & complete & (F.col("low") == 0)).alias("known"),
    )


def primary_metric(report: str = "report") -> Column:
    chain = F.lit(None).cast("string")
    for word, metric in reversed(PRIMARY_BY_REPORT):
        chain = F.when(F.col(report).contains(word), metric).otherwise(chain)
    return chain


def rebuild_ratios(obs: DataFrame, merged: DataFrame, coverage: DataFrame) -> DataFrame:
    """Shares of added weeks: merged count over merged counts, else weighted by the primary pieces.

    Result: keys of the share rows, value, method (counts / weights / kept).
    """
    sheet = ["report", "subject", "grain", "period"]
    weeks = merged.filter("added").select(*sheet).distinct()
    shares = merged.filter(F.col("stat") == SHARE).join(weeks, sheet, "left_semi")
    counts = merged.filter((F.col("stat") == QTY) & (F.col("category") != QTY)).join(weeks, sheet, "left_semi")
    counts = counts.select(*sheet, "metric", "category", observed(F.col("value")).alias("n"))
    totals = counts.groupBy(*sheet, "metric").agg(F.sum("n").alias("total"))
    weights = merged.filter("added").filter(
        (F.col("metric") == primary_metric()) & (F.col("stat") == QTY) & (F.col("category") == QTY)
    ).select(
        *sheet,
        F.explode(F.array(
            F.struct(F.col("source_order").alias("source_order"), F.col("first_value").alias("w")),
            F.struct(F.col("second_order").alias("source_order"), F.col("second_value").alias("w")),
        )).alias("p"),
    ).select(*sheet, "p.*")
    rates = observation_pieces(obs).filter(F.col("stat") == SHARE).filter("value is not null").groupBy(
        *sheet, "metric", "category", "source_order"
    ).agg(F.min_by("value", "row_ord").alias("rate"))
    keys = sheet + ["metric", "category"]
    pairs = shares.select(*keys).join(weights, sheet).join(rates, keys + ["source_order"], "left")
    weighted = pairs.groupBy(*keys).agg(
        F.when(
            F.bool_and((F.col("w") == 0) | F.col("rate").isNotNull()) & (F.sum("w") > 0),
            F.sum(F.when(F.col("w") > 0, F.col("rate") * F.col("w")).otherwise(0.0)) / F.sum("w"),
        ).alias("by_weight")
    )
    joined = (
        shares.join(counts, keys, "left").join(totals, sheet + ["metric"], "left").join(weighted, keys, "left")
    )
    by_count = observed_rate(F.col("n"), F.col("total"))
    return joined.select(
        *keys, F.lit(SHARE).alias("stat"),
        F.coalesce(by_count, F.col("by_weight"), F.col("value")).alias("value"),
        F.when(by_count.isNotNull(), "counts").when(F.col("by_weight").isNotNull(), "weights").otherwise("kept").alias("method"),
    )


def merge_report(obs: DataFrame, coverage: DataFrame) -> DataFrame:
    """The full merge of a mix report: base rule, boundary weeks, store counts, ratios."""
    # Read three times below and by every analysis after it.
    merged = cut_lineage(merge_sources(obs, coverage))
    stores = merge_distinct_stores(obs, coverage).select(
        "report", "subject", "grain", "period", "category", F.col("value").alias("_stores"), F.lit(True).alias("_judged")
    )
    ratios = rebuild_ratios(obs, merged, coverage).select(*OBS_KEYS, F.col("value").alias("_ratio"))
    out = merged.drop("first_is_left").join(stores, ["report", "subject", "grain", "period", "category"], "left").join(ratios, OBS_KEYS, "left")
    value = F.when(F.col("_judged") & is_store_field(), F.col("_stores")).otherwise(F.coalesce("_ratio", "value"))
    return out.withColumn("value", value).drop("_stores", "_judged", "_ratio")


def merge_records(df: DataFrame, keys, fields, coverage: DataFrame = None, period: str = None) -> DataFrame:
    """Records with named keys: every field merged on its own by the base rule.

    Fields hold one type (double); the result is wide again, one row per key.
    """
    keys = list(keys)
    stacked = df.select(
        *keys, "source_order", "row_ord",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x"),
    ).select(*keys, "source_order", "row_ord", "x.field", "x.value")
    stacked = stacked.withColumn("raw", F.lit(None).cast("string")).withColumn(
        "quantity", ~F.col("field").rlike(_NOT_ADDABLE + "|rate|share|days")
    )
    if period and period != "period":
        stacked = stacked.withColumn("period", F.col(period))
    merged = merge_pieces(stacked, keys + ["field"], coverage if period else None)
    return merged.groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    )


def merge_fee(fee: DataFrame) -> DataFrame:
    """Fee tables: two-level column key (month, band); summaries stay inside their month."""
    keys = ["generation", "row_kind", "grp", "label", "period", "band"]
    pieces = fee.withColumn("raw", F.lit(None).cast("string")).withColumn("quantity", F.lit(False))
    return merge_pieces(pieces, keys).select(*keys, "value", "source_order")


def merge_blocks(df: DataFrame, keys, coverage: DataFrame = None) -> DataFrame:
    """Block layouts: merged per block title; only count blocks may add boundary weeks."""
    pieces = df.withColumn("raw", F.lit(None).cast("string")).withColumn(
        "quantity", F.col("block").isin(*COUNT_BLOCKS) & ~F.coalesce(F.col("fmt"), F.lit("")).rlike("[%％]")
    )
    return merge_pieces(pieces, ["block", *keys], coverage)


def merge_chart(chart: DataFrame, coverage: DataFrame) -> DataFrame:
    """Chart blocks: totals with boundary weeks, shares weighted where totals were added.

    Series shares fall back across files before the display rule turns blanks into 0.
    Result: report, subject, grain, period, series (NULL = total), value.
    """
    keys = ["report", "subject", "grain", "period"]
    base = chart.withColumn("period", period_key(F.col("period"))).withColumn("raw", F.lit(None).cast("string"))
    totals = merge_pieces(base.filter("series is null").withColumn("quantity", F.lit(True)), keys, coverage)
    lines = base.filter("series is not null")
    shares = merge_pieces(lines.withColumn("quantity", F.lit(False)), keys + ["series"])
    weights = totals.filter("added").select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("source_order").alias("source_order"), F.col("first_value").alias("w")),
            F.struct(F.col("second_order").alias("source_order"), F.col("second_value").alias("w")),
        )).alias("p"),
    ).select(*keys, "p.*")
    # Blank cells of an export are unknown, a series the export does not have counts as 0.
    rates = lines.groupBy(*keys, "series", "source_order").agg(
        F.min_by("value", "row_ord").alias("rate"), F.lit(True).alias("_cell")
    )
    names = lines.join(weights, keys + ["source_order"], "left_semi").select(*keys, "series").distinct()
    pairs = names.join(weights, keys).join(rates, keys + ["series", "source_order"], "left")
    rate = F.when(F.col("_cell"), F.col("rate")).otherwise(F.lit(0.0))
    rebuilt = pairs.groupBy(*keys, "series").agg(
        F.when(
            F.bool_and((F.col("w") == 0) | rate.isNotNull()) & (F.sum("w") > 0),
            F.sum(F.when(F.col("w") > 0, rate * F.col("w")).otherwise(0.0)) / F.sum("w"),
        ).alias("_rebuilt")
    )
    periods = base.select(*keys).distinct()
    all_series = lines.select(*keys[:3], "series").distinct()
    grid = periods.join(all_series, keys[:3])
    shown = grid.join(shares.select(*keys, "series", "value"), keys + ["series"], "left").join(
        rebuilt, keys + ["series"], "left"
    ).select(*keys, "series", F.coalesce("_rebuilt", "value", F.lit(0.0)).alias("value"))
    total_rows = periods.join(totals.select(*keys, "value"), keys, "left").select(
        *keys, F.lit(None).cast("string").alias("series"), F.coalesce("value", F.lit(0.0)).alias("value")
    )
    return total_rows.unionByName(shown)


def conflicts(obs: DataFrame, merged: DataFrame, coverage: DataFrame) -> DataFrame:
    """Pieces whose value lost against a different one, with the reason and, where the pieces tell
    them, the sheet and column that they stood in.

    The merged side has one row per key, so a skewed key is split by the join itself.
    """
    for name, kind in (("sheet", "string"), ("col_ord", "int")):
        if name not in obs.columns:
            obs = obs.withColumn(name, F.lit(None).cast(kind))
    pieces = with_side(observation_pieces(obs, drop_summaries=False), coverage).filter("value is not null or raw is not null")
    winner = merged.select(
        *OBS_KEYS, F.col("source_order").alias("first_order"), "first_value", "second_value", "first_is_left",
        F.col("value").alias("kept_value"),
    )
    joined = pieces.join(winner, OBS_KEYS)
    equal = F.coalesce(same_value(F.col("value"), F.col("first_value")), F.lit(False))
    equal = equal | F.coalesce(F.col("value") == F.col("second_value"), F.lit(False))
    # Two unreadable cells say nothing about each other.
    equal = equal | (F.col("value").isNull() & F.col("first_value").isNull())
    lost = joined.filter(~equal)
    cross = F.col("source_order") != F.col("first_order")
    reason = (
        F.when(cross & is_summary_period(F.col("period"), "conflict"), "summaries not comparable")
        .when(F.col("boundary").isNull(), "different values")
        .when(~cross, "same file twice")
        .when(~F.col("quantity") & (F.col("is_left") != F.col("first_is_left")), "split of a boundary week")
        .when(~F.col("covered"), "coverage unknown")
        .otherwise("pieces do not adjoin")
    )
    return lost.select(
        *OBS_KEYS, F.when(cross, "cross file").otherwise("same file").alias("kind"), reason.alias("reason"),
        "first_order", "source_order", "kept_value", F.col("value").alias("lost_value"), "row_ord", "sheet", "col_ord",
    )


_REPORT_KEYS = ["report", "subject", "metric", "kind", "reason", "first_order", "source_order"]


def _rolled(found: DataFrame) -> DataFrame:
    """TOP ranks share one metric."""
    return found.withColumn("metric", F.regexp_replace("metric", r"(?i)^TOP\d+$", "TOP"))


def conflict_report(found: DataFrame, examples: int = 3) -> DataFrame:
    """One row per metric and pair of files: how often, which runs of periods, the first examples.

    The runs of a row are at most as many as the calendar has periods. ``conflict_cells`` tells where
    in the sheets the lost values stood.
    """
    keys, rolled = _REPORT_KEYS, _rolled(found)
    counted = rolled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("period").alias("periods"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
    )
    # Runs of labels have a kind of their own.
    told = ["side" if k == "kind" else k for k in keys]
    ranges = range_text(compress_labels(rolled.withColumnRenamed("kind", "side"), told, "period"), told).withColumnRenamed("side", "kind")
    order = Window.partitionBy(*keys).orderBy("period", "category", "row_ord", "lost_value")
    first = rolled.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= examples)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "period", "category", "kept_value", "lost_value"))).alias("examples"))
    return counted.join(ranges, keys).join(shown, keys)


def conflict_cells(found: DataFrame) -> DataFrame:
    """Rectangles of lost cells per sheet, one row each."""
    placed = _rolled(found).filter("sheet is not null and col_ord is not null")
    points = placed.select(*_REPORT_KEYS, "sheet", F.col("row_ord").cast("bigint").alias("row"), F.col("col_ord").cast("bigint").alias("col"))
    return cell_rectangles(points, [*_REPORT_KEYS, "sheet"])


def boundary_report(added: DataFrame, coverage: DataFrame = None, examples: int = 3) -> DataFrame:
    """Added weeks: number of fields, sources with their proven ranges, up to three examples."""
    text = F.concat_ws("/", "subject", "metric", "category")
    ranked = added.withColumn("_text", text)
    totals = ranked.groupBy("period").agg(
        F.count(F.lit(1)).alias("fields"),
        F.min(F.least("source_order", "second_order")).alias("first_source"),
        F.max(F.greatest("source_order", "second_order")).alias("last_source"),
    )
    w = Window.partitionBy("period").orderBy("_text", "report", "grain", "stat")
    top = ranked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= examples)
    packed = top.groupBy("period").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_text"))), lambda x: x["_text"]).alias("_ex")
    )
    report = totals.join(packed, "period", "left").withColumn("examples", F.array_join("_ex", "; ")).drop("_ex")
    if coverage is not None:
        # One row per file; broadcast only below the planner's limit.
        for side in ("first", "last"):
            spans = coverage.select(F.col("source_order").alias(f"{side}_source"), F.struct("start", "end").alias(f"{side}_range"))
            report = report.join(spans, f"{side}_source", "left")
    return report


def store_merge_notes(judged: DataFrame) -> DataFrame:
    """Distinct-store decisions per sheet, period and reason."""
    return judged.groupBy("report", "subject", "grain", "period", "reason", "known").agg(
        F.count(F.lit(1)).alias("channels")
    )


def active_store_priority(obs: DataFrame) -> DataFrame:
    """Active stores per period and channel: the new layout wins wherever it has a physical
    cell (blank included); periods only known in the old layout keep their history."""
    keys = ["report", "subject", "grain", "period", "category"]
    rows = unify_labels(obs).filter(is_store_field()).withColumn(
        "layout", F.when(F.col("stat") == STORES, 2).otherwise(1)
    )
    first = rows.groupBy(*keys, "layout").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), priority())).alias("value")
    )
    return first.groupBy(*keys).agg(F.max_by("value", "layout").alias("value"), F.max("layout").alias("layout"))


def period_union(*frames) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out.distinct()


def dedupe_messages(messages: DataFrame) -> DataFrame:
    return messages.dropDuplicates()

