"""From the cells of many report files to merged tables and analyses.

Every sheet is given a layout by its file and sheet name. Each layout has one reader and one merge, which
run once over all of its sheets together, whatever their number; what no layout claims stays apart as raw
rows. File order is path order and decides which export comes first.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import NamingRules, grain_from_name, sheet_subject
from ..functions.periods import day_key, is_summary_period, period_start
from ..labels import CHART_WORD, COHORT_DURATION_HEADERS, DAILY_HEADERS, HOURLY_HEADERS, STAGES
from ..operators.coverage import fill_sparse_days, source_coverage
from ..operators.lineage import cut_lineage
from ..operators.merge import merge_chart, merge_fee, merge_records, merge_report
from ..sources import cells as layout
from ..sources.reports import classify_report
from .overview import overview_base, override_from_chart

_SHEET = ["file", "sheet"]
_MIX = ("order_mix", "small_order_mix", "lock_mix")
_COHORT = [f"s{i}" for i in range(1, len(STAGES) + 1)] + list(COHORT_DURATION_HEADERS)
_SPLIT = "\n"


def layout_of(report: Column, sheet: Column) -> Column:
    """matrix, chart, hourly, daily, cohort, fee; NULL for sheets that are kept apart."""
    charted = sheet.contains(CHART_WORD)
    return (
        F.when(report.isin(*_MIX), F.when(charted, "chart").otherwise("matrix"))
        .when(sheet.contains("小订分时退订"), "hourly")
        .when(sheet.contains("日度退订"), "daily")
        .when(report == "conversion", "cohort")
        .when((report == "option_fee") & ~sheet.contains("排名"), "fee")
    )


def list_sheets(cells: DataFrame, rules: NamingRules) -> DataFrame:
    """One row per sheet: file, sheet, report, subject, grain, layout, source_order."""
    named = cells.select(*_SHEET).distinct().withColumn("report", classify_report(F.col("file")))
    listed = named.withColumn("layout", layout_of(F.col("report"), F.col("sheet")))
    # A row per file; files are numbered in path order.
    files = listed.select("file").distinct().withColumn("source_order", F.row_number().over(Window.orderBy("file")) - 1)
    return listed.join(files, "file").select(
        *_SHEET, "report", sheet_subject(F.col("sheet"), rules).alias("subject"), grain_from_name(F.col("sheet")).alias("grain"), "layout", "source_order",
    )


@dataclass(frozen=True)
class Dispatch:
    cells: DataFrame
    rules: NamingRules

    @cached_property
    def sheets(self) -> DataFrame:
        return cut_lineage(list_sheets(self.cells, self.rules))

    def of(self, name: str) -> DataFrame:
        """Cells of all sheets of one layout; the list of sheets is small beside them."""
        return self.cells.join(self.sheets.filter(F.col("layout") == name).select(*_SHEET), _SHEET, "left_semi")

    def _read(self, name: str, read) -> DataFrame:
        """All sheets of a layout, read once, with what their names say."""
        told = self.sheets.filter(F.col("layout") == name).select(*_SHEET, "report", F.col("subject").alias("sheet_subject"), "grain", "source_order")
        rows = read(self.of(name)).join(told, _SHEET)
        return rows.drop("sheet_subject") if "subject" in rows.columns else rows.withColumnRenamed("sheet_subject", "subject")

    @cached_property
    def pieces(self) -> DataFrame:
        """Rows of the matrix sheets before merging."""
        return cut_lineage(self._read("matrix", layout.tidy_metric_cells))

    @cached_property
    def chart_pieces(self) -> DataFrame:
        return cut_lineage(self._read("chart", layout.tidy_chart_cells).filter(~is_summary_period(F.col("period"), "parse")))

    @cached_property
    def coverage(self) -> DataFrame:
        """Proven range of each file, from day columns, declared cells and, failing these, charts."""
        declared = layout.declared_coverage(self.cells).join(self.sheets.select(*_SHEET, "source_order"), _SHEET)
        return cut_lineage(source_coverage(self.pieces, self.chart_pieces, declared))

    @cached_property
    def observations(self) -> DataFrame:
        """Merged matrix sheets: days that an export leaves out inside its range count 0, then first
        value, boundary weeks, distinct stores and rebuilt ratios."""
        merged = merge_report(fill_sparse_days(self.pieces, self.coverage), self.coverage)
        keys = ["report", "subject", "grain", "metric", "stat", "category"]
        order = self.pieces.groupBy(*keys[:3], "metric", "stat", "category").agg(F.min("row_ord").alias("row_ord"))
        # The merged metric may have a newer spelling than the sheet; such rows come last.
        placed = merged.join(order, keys, "left").withColumn("row_ord", F.coalesce("row_ord", F.lit((1 << 31) - 1)))
        return cut_lineage(placed.withColumn("period_start", period_start(F.col("period"))))

    @cached_property
    def charts(self) -> DataFrame:
        """Merged chart blocks, by subject and headline."""
        both = F.concat_ws(_SPLIT, "subject", F.coalesce("headline", F.lit("")))
        merged = merge_chart(self.chart_pieces.withColumn("subject", both), self.coverage)
        return merged.withColumn("headline", F.split_part("subject", F.lit(_SPLIT), F.lit(2))).withColumn("subject", F.split_part("subject", F.lit(_SPLIT), F.lit(1)))

    def _records(self, name: str, headers: dict, keys: list, fields: list, rates: list) -> DataFrame:
        def read(cells):
            header = layout.resolve_header(cells, headers, keys)
            return layout.header_records(cells, header, keys, fields, rates)

        rows = self._read(name, read).withColumn("date", day_key(F.col("date"))).withColumnRenamed("row", "row_ord")
        if "hour" in keys:
            rows = rows.withColumn("hour", F.regexp_extract("hour", r"\d+", 0).try_cast("int"))
        return merge_records(rows.filter(F.col("date").isNotNull()), ["subject", *keys], [*fields, *rates])

    @cached_property
    def hourly(self) -> DataFrame:
        return self._records("hourly", HOURLY_HEADERS, ["date", "hour"], ["orders", "cancel"], [])

    @cached_property
    def daily(self) -> DataFrame:
        counts = ["small_cancel", "small_cancel_cum", "big_cancel"]
        return self._records("daily", DAILY_HEADERS, ["date"], counts, [f for f in DAILY_HEADERS if f not in ("date", *counts)])

    @cached_property
    def cohorts(self) -> DataFrame:
        rows = self._read("cohort", layout.tidy_cohort_cells).withColumnRenamed("row", "row_ord")
        return merge_records(rows, ["subject", "grain", "period"], _COHORT, self.coverage, "period")

    @cached_property
    def fee(self) -> DataFrame:
        return merge_fee(self._read("fee", layout.tidy_fee_cells).withColumnRenamed("subject", "generation"))

    @cached_property
    def separate(self) -> DataFrame:
        """Raw rows of all sheets without a layout."""
        apart = self.cells.join(self.sheets.filter("layout is null").select(*_SHEET), _SHEET, "left_semi")
        return layout.raw_tables(apart)

    @cached_property
    def overview(self) -> DataFrame:
        return override_from_chart(overview_base(self.observations), self.charts)
