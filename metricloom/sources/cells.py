"""Sheet layouts as relational work over ``cells`` (one row per stored cell).

A layout is read with joins: header cells to body cells by column, label cells to body
cells by row. Blank cells are simply absent, nothing is expanded to a grid.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import hour_timestamp, is_amount_band, normalize_band
from ..functions.numbers import finite, norm_number, norm_rate
from ..functions.periods import day_key, day_label, is_summary_period, source_key
from ..functions.text import clean_text, compact_identifier, compact_text, header_key
from ..labels import (
    COHORT_DURATION_HEADERS, COHORT_QUANTITY_HEADERS, COVERAGE_ENDS, COVERAGE_STARTS, LAUNCH_RETAINED,
    OPTION_RETREAT_HEADERS, PERIOD_HEADERS, RETAINED, RETAINED_OLD, STAGES, TOTAL,
)
from ..operators.ordered import forward_fill, running_count
from ..plans.fee import SUMMARIES

_SHEET = ["file", "sheet"]


def cell_text(prefix: str = "") -> Column:
    """What the cell reads as: text, ISO day or time, or the number without a trailing .0."""
    s, d, ts = (F.col(prefix + c) for c in ("s", "d", "ts"))
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    number = F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    stamp = F.regexp_replace(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")
    return clean_text(F.coalesce(s, stamp, number))


def cell_value() -> Column:
    """Number of a cell; booleans are never numbers."""
    return F.when(F.col("kind") != "b", F.coalesce(finite(F.col("d")), norm_number(F.col("s"))))


def cell_rate() -> Column:
    return F.when(F.col("kind") != "b", norm_rate(F.col("s"), F.col("d"), F.col("fmt")))


def _row_labels(cells: DataFrame, columns: dict) -> DataFrame:
    """One row per sheet row with the text of some columns (NULL when blank)."""
    picked = cells.filter(F.col("col").isin(*columns))
    return picked.groupBy(*_SHEET, "row").agg(
        *[F.nullif(F.max(F.when(F.col("col") == c, cell_text())), F.lit("")).alias(name) for c, name in columns.items()]
    )


def _header(cells: DataFrame, row: int, first_col: int, name: str) -> DataFrame:
    return cells.filter((F.col("row") == row) & (F.col("col") >= first_col)).select(*_SHEET, "col", cell_text().alias(name))


def tidy_metric_cells(cells: DataFrame) -> DataFrame:
    """Wide metric sheet -> long rows; metric and statistic are filled down."""
    labels = _row_labels(cells.filter("row >= 2"), {1: "metric", 2: "stat", 3: "category"})
    labels = forward_fill(labels, ["metric", "stat"], _SHEET, "row").filter("category is not null")
    header = _header(cells, 1, 4, "label")
    day = day_label(day_key(F.col("label")))
    header = header.filter("label <> ''").filter(~is_summary_period(F.col("label"), "parse")).select(
        *_SHEET, "col", F.coalesce(day, source_key(F.col("label"))).alias("period")
    )
    body = cells.filter("row >= 2 and col >= 4")
    rate = F.col("stat") == "占比"
    return body.join(header, _SHEET + ["col"]).join(labels, _SHEET + ["row"]).select(
        *_SHEET, "period", "metric", "stat", "category",
        F.when(rate, cell_rate()).otherwise(cell_value()).alias("value"),
        F.when(cell_value().isNull(), cell_text()).alias("raw"), "fmt", F.col("row").alias("row_ord"), F.col("col").alias("col_ord"),
    )


def tidy_chart_cells(cells: DataFrame) -> DataFrame:
    """Chart blocks: subject in column 1, header one row below, series until the total row."""
    labels = _row_labels(cells, {1: "subject", 2: "name"})
    labels = running_count(labels, F.col("subject").isNotNull(), "block", _SHEET, "row").filter("block > 0")
    starts = labels.filter("subject is not null").select(*_SHEET, "block", F.col("row").alias("start"), F.col("subject").alias("title"))
    rows = labels.join(starts, _SHEET + ["block"])
    headline = rows.filter("row = start + 1").select(*_SHEET, "block", F.col("name").alias("headline"))
    names = rows.filter("row > start + 1")
    # Rows after the first blank label or the total row do not belong to the block.
    closed = names.groupBy(*_SHEET, "block").agg(
        F.min(F.when(F.col("name").isNull(), F.col("row"))).alias("_blank"),
        F.min(F.when(F.col("name") == TOTAL, F.col("row"))).alias("_total"),
    )
    kept = names.join(closed, _SHEET + ["block"]).filter(
        "name is not null and (_blank is null or row < _blank) and (_total is null or row <= _total)"
    )
    head_rows = starts.select(*_SHEET, "block", (F.col("start") + 1).alias("row"))
    header = cells.filter("col >= 3").join(head_rows, _SHEET + ["row"]).select(
        *_SHEET, "block", "col", source_key(cell_text()).alias("period")
    )
    body = cells.filter("col >= 3").join(kept.select(*_SHEET, "row", "block", "title", "name"), _SHEET + ["row"])
    return body.join(header, _SHEET + ["block", "col"]).join(headline, _SHEET + ["block"], "left").select(
        *_SHEET, F.col("title").alias("subject"), "headline", "period",
        F.when(F.col("name") != TOTAL, F.col("name")).alias("series"), cell_value().alias("value"), F.col("row").alias("row_ord"),
    )


def _alias_field(key: Column, aliases: dict) -> Column:
    # Fixed, short alias lists become one map literal instead of a join.
    pairs = {}
    for field, names in aliases.items():
        for name in names:
            pairs.setdefault(name, field)
    keys = F.array(*[header_key(F.lit(n)) for n in pairs])
    fields = F.array(*[F.lit(f) for f in pairs.values()])
    at = F.array_position(keys, key)
    return F.when((key != "") & (at > 0), F.element_at(fields, at.cast("int")))


def resolve_header(cells: DataFrame, aliases: dict, required, max_rows: int = 12) -> DataFrame:
    """Header row and column per field. The row with most fields wins, the first on ties;
    sheets without all required fields are left out, columns are never guessed."""
    named = cells.filter(F.col("row") <= max_rows).withColumn("field", _alias_field(header_key(cell_text()), aliases))
    named = named.filter("field is not null").groupBy(*_SHEET, "row", "field").agg(F.min("col").alias("col"))
    wanted = F.array(*[F.lit(f) for f in required])
    scored = named.groupBy(*_SHEET, "row").agg(F.count(F.lit(1)).alias("n"), F.collect_set("field").alias("found"))
    w = Window.partitionBy(*_SHEET).orderBy(F.desc("n"), "row")
    best = scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    best = best.filter(F.size(F.array_except(wanted, "found")) == 0).select(*_SHEET, "row")
    return named.join(best, _SHEET + ["row"]).select(*_SHEET, F.col("row").alias("header_row"), "field", "col")


def header_records(cells: DataFrame, header: DataFrame, text_fields, number_fields, rate_fields=()) -> DataFrame:
    """Rows under a resolved header as named columns."""
    body = cells.join(header, _SHEET + ["col"]).filter("row > header_row")
    def pick(field, value):
        return F.max(F.when(F.col("field") == field, value)).alias(field)
    return body.groupBy(*_SHEET, "row").agg(
        *[pick(f, cell_text()) for f in text_fields],
        *[pick(f, cell_value()) for f in number_fields],
        *[pick(f, cell_rate()) for f in rate_fields],
    )


def resolve_grouped_header(cells: DataFrame, max_rows: int = 10) -> DataFrame:
    """Two-row cohort header: stage names over 数量, filled to the right, any column order.

    Result: file, sheet, header_row, field, col; only complete headers.
    """
    top = cells.filter(F.col("row") <= max_rows + 1)
    texts = top.select(*_SHEET, "row", "col", F.nullif(cell_text(), F.lit("")).alias("text")).filter("text is not null")
    columns = texts.select(*_SHEET, "col").distinct()
    rows = texts.filter(F.col("row") <= max_rows).select(*_SHEET, "row").distinct()
    grid = rows.join(columns, _SHEET).join(texts, _SHEET + ["row", "col"], "left")
    below = texts.select(*_SHEET, (F.col("row") - 1).alias("row"), "col", F.col("text").alias("sub"))
    both = grid.withColumn("group", F.col("text"))
    both = forward_fill(both, ["group"], _SHEET + ["row"], "col").join(below, _SHEET + ["row", "col"], "left")
    quantity = F.col("sub").isNull() | header_key(F.col("sub")).isin(*COHORT_QUANTITY_HEADERS)
    stage = F.when(quantity, _alias_field(header_key(F.col("group")), {f"s{i}": (s,) for i, s in enumerate(STAGES, 1)}))
    period = _alias_field(header_key(F.col("text")), {"period": PERIOD_HEADERS})
    duration = F.coalesce(
        _alias_field(header_key(F.col("text")), COHORT_DURATION_HEADERS),
        _alias_field(header_key(F.col("sub")), COHORT_DURATION_HEADERS),
    )
    found = both.withColumn("field", F.coalesce(period, duration, stage)).filter("field is not null")
    found = found.groupBy(*_SHEET, "row", "field").agg(F.min("col").alias("col"))
    scored = found.filter(~F.col("field").isin(*COHORT_DURATION_HEADERS)).groupBy(*_SHEET, "row").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*_SHEET).orderBy(F.desc("n"), "row")
    best = scored.withColumn("_rn", F.row_number().over(w)).filter(f"_rn = 1 and n = {len(STAGES) + 1}")
    return found.join(best.select(*_SHEET, "row"), _SHEET + ["row"]).select(
        *_SHEET, F.col("row").alias("header_row"), "field", "col"
    )


def tidy_cohort_cells(cells: DataFrame) -> DataFrame:
    """Cohort sheet -> one row per period with the seven stages and two durations."""
    header = resolve_grouped_header(cells)
    fields = [f"s{i}" for i in range(1, len(STAGES) + 1)] + list(COHORT_DURATION_HEADERS)
    return header_records(cells.filter("row > 1"), header.withColumn("header_row", F.col("header_row") + 1), ["period"], fields).filter(
        "period is not null and period <> ''"
    )


def split_parallel_blocks(cells: DataFrame) -> DataFrame:
    """Side-by-side tables: two or more titles in row 1 with an empty column in between.

    Result: cells plus block (title) and block_no; sheets without such titles are left out.
    """
    stored = cells.filter(cell_text() != "")
    titles = stored.filter("row = 1").select(*_SHEET, "col", cell_text().alias("title"))
    used = stored.select(*_SHEET, "col").distinct()
    w = Window.partitionBy(*_SHEET).orderBy("col")
    spans = titles.select(
        *_SHEET, "title", F.col("col").alias("from_col"),
        F.lead("col").over(w).alias("to_col"), F.row_number().over(w).alias("block_no"),
    )
    # Every used column belongs to the last title at or before it.
    tagged = used.join(spans.select(*_SHEET, F.col("from_col").alias("col"), "from_col"), _SHEET + ["col"], "left")
    owned = forward_fill(tagged, ["from_col"], _SHEET, "col").filter("from_col is not null")
    width = owned.groupBy(*_SHEET, "from_col").agg(F.count(F.lit(1)).alias("used")).join(spans, _SHEET + ["from_col"])
    # A block ends where a used column is missing before the next title.
    parallel = width.groupBy(*_SHEET).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("to_col").isNull(), True).otherwise(F.col("used") < F.col("to_col") - F.col("from_col"))).alias("_gaps"),
    ).filter("_n >= 2 and _gaps")
    chosen = owned.join(parallel.select(*_SHEET), _SHEET, "left_semi").join(
        spans.select(*_SHEET, "from_col", "title", "block_no"), _SHEET + ["from_col"]
    )
    return stored.join(chosen, _SHEET + ["col"])


def tidy_option_retreat(cells: DataFrame) -> DataFrame:
    """Vertical blocks titled …退订比例, each with its own header."""
    stored = cells.withColumn("text", cell_text()).filter("text <> ''")
    rows = stored.groupBy(*_SHEET, "row").agg(F.count(F.lit(1)).alias("_n"), F.max("text").alias("_t"))
    title = (F.col("_n") == 1) & F.col("_t").endswith("退订比例")
    rows = running_count(rows, title, "block", _SHEET, "row").withColumn("is_title", title)
    field = _alias_field(header_key(F.col("text")), OPTION_RETREAT_HEADERS)
    named = stored.withColumn("field", field)
    heads = named.groupBy(*_SHEET, "row").agg(
        F.collect_set("field").alias("_f"), F.min(F.when(F.col("field").isNull(), F.col("col"))).alias("label_col")
    ).filter(F.array_contains("_f", "orders") & F.array_contains("_f", "cancel") & F.array_contains("_f", "share") & F.col("label_col").isNotNull())
    marked = rows.join(heads.select(*_SHEET, "row", "label_col"), _SHEET + ["row"], "left")
    marked = running_count(marked, F.col("label_col").isNotNull(), "head_no", _SHEET, "row")
    titles = marked.filter("is_title").select(*_SHEET, "block", F.col("_t").alias("title"))
    columns = named.filter("field is not null").join(
        marked.filter("label_col is not null").select(*_SHEET, "row", "head_no"), _SHEET + ["row"]
    ).groupBy(*_SHEET, "head_no", "field").agg(F.min("col").alias("col"))
    label_columns = marked.filter("label_col is not null").select(*_SHEET, "head_no", F.lit("label").alias("field"), F.col("label_col").alias("col"))
    columns = columns.unionByName(label_columns)
    own_head = marked.filter("label_col is not null").select(*_SHEET, "head_no", F.col("block").alias("head_block"))
    body = marked.filter("block > 0 and not is_title and label_col is null").join(own_head, _SHEET + ["head_no"]).filter("head_block = block")
    wide = stored.join(body.select(*_SHEET, "row", "block", "head_no"), _SHEET + ["row"]).join(
        columns, _SHEET + ["head_no", "col"]
    ).groupBy(*_SHEET, "block", "row").agg(
        F.max(F.when(F.col("field") == "label", F.col("text"))).alias("label"),
        *[F.coalesce(F.max(F.when(F.col("field") == f, cell_value())), F.lit(0.0)).alias(f) for f in ("orders", "cancel")],
        *[F.coalesce(F.max(F.when(F.col("field") == f, cell_rate())), F.lit(0.0)).alias(f) for f in ("pre_share", "post_share", "share")],
    ).filter("label is not null")
    return wide.join(titles, _SHEET + ["block"]).select(
        *_SHEET, F.regexp_replace("title", "退订比例$", "").alias("dimension"), "label",
        "orders", "cancel", "pre_share", "post_share", "share", F.col("row").alias("ord"),
    )


def fee_layout(cells: DataFrame) -> DataFrame:
    """Band header row and order row of a fee sheet.

    A band row counts only with a quantity row in the next six rows; a labelled quantity
    row beats an unlabelled one, then more bands, then the lower row.
    """
    bands = cells.filter("row <= 15 and col >= 3").filter(is_amount_band(cell_text())).select(
        *_SHEET, F.col("row").alias("band_row"), "col"
    )
    counted = bands.groupBy(*_SHEET, "band_row").agg(F.count(F.lit(1)).alias("n_bands"))
    near = cells.filter("row <= 21 and col >= 3 and d is not null")
    under = bands.join(near, _SHEET + ["col"]).filter("row > band_row and row <= band_row + 6")
    labels = _row_labels(cells.filter("row <= 21"), {1: "l1", 2: "l2"})
    rows = under.groupBy(*_SHEET, "band_row", "row").agg(F.max(F.abs("d") > 1).alias("big")).join(labels, _SHEET + ["row"], "left")
    label = compact_identifier(F.concat_ws("", "l1", "l2"))
    named = label.rlike("订单|数量") | (~label.contains("金额") & label.rlike("总计|合计"))
    loose = ~label.contains("金额") & F.col("big")
    choice = rows.groupBy(*_SHEET, "band_row").agg(
        F.min(F.when(named, F.col("row"))).alias("explicit"), F.min(F.when(loose, F.col("row"))).alias("fallback")
    ).filter("explicit is not null or fallback is not null").join(counted, _SHEET + ["band_row"])
    w = Window.partitionBy(*_SHEET).orderBy(
        F.col("explicit").isNotNull().desc(), F.desc("n_bands"), F.desc("band_row"), F.desc(F.coalesce("explicit", "fallback"))
    )
    return choice.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        *_SHEET, "band_row", F.coalesce("explicit", "fallback").alias("order_row")
    )


def tidy_fee_cells(cells: DataFrame) -> DataFrame:
    """Fee sheet body in long form: month, band, group, label, value; summaries excluded."""
    layout = fee_layout(cells)
    heads = cells.join(layout, _SHEET).filter("col >= 3 and (row = band_row or row = band_row - 1)")
    columns = heads.groupBy(*_SHEET, "col", "band_row", "order_row").agg(
        F.nullif(F.max(F.when(F.col("row") < F.col("band_row"), cell_text())), F.lit("")).alias("period"),
        F.max(F.when(F.col("row") == F.col("band_row"), cell_text())).alias("band"),
    )
    columns = forward_fill(columns, ["period"], _SHEET, "col").filter(
        F.col("period").isNotNull() & F.col("band").isNotNull()
        & ~F.col("period").isin(*SUMMARIES) & ~F.col("band").isin(*SUMMARIES) & (F.col("band") != "")
    ).withColumn("band", normalize_band(F.col("band")))
    labels = forward_fill(_row_labels(cells, {1: "grp", 2: "label"}), ["grp"], _SHEET, "row")
    body = cells.join(columns, _SHEET + ["col"]).filter("row >= order_row").join(labels, _SHEET + ["row"], "left")
    is_order = F.col("row") == F.col("order_row")
    kind = (
        F.when(is_order, "orders")
        .when(F.col("label") == "选配金额", "option_amount").when(F.col("label") == "实际金额", "actual_amount")
        .when(F.col("label") == "选配金额总计", "option_total").when(F.col("label") == "实际金额总计", "actual_total")
        .otherwise("penetration")
    )
    rate = kind == "penetration"
    return body.select(
        *_SHEET, "period", "band", kind.alias("row_kind"), "grp",
        F.when(kind.isin("option_amount", "actual_amount"), F.col("grp")).otherwise(F.col("label")).alias("label"),
        F.when(rate, cell_rate()).otherwise(cell_value()).alias("value"), F.col("col").alias("col_ord"), F.col("row").alias("row_ord"),
    )


def tidy_launch_cells(cells: DataFrame) -> DataFrame:
    """Launch sheet: step labels in row 1, dates in row 2, metrics below."""
    steps = _header(cells, 1, 2, "step").filter((F.col("step") != "") & (F.col("step") != TOTAL))
    dates = cells.filter("row = 2 and col >= 2").select(
        *_SHEET, "col", F.coalesce(F.to_date("ts"), day_key(F.col("s"), F.col("d"))).alias("step_date")
    )
    labels = _row_labels(cells.filter("row >= 3"), {1: "metric"}).filter("metric is not null")
    metric = F.replace(F.col("metric"), F.lit(RETAINED_OLD), F.lit(RETAINED))
    rate = F.col("metric").rlike("率|进度|占比")
    return cells.filter("row >= 3 and col >= 2").join(steps, _SHEET + ["col"]).join(dates, _SHEET + ["col"], "left").join(
        labels, _SHEET + ["row"]
    ).select(
        *_SHEET, "step", F.col("col").alias("step_ord"), "step_date", metric.alias("metric"),
        F.when(rate, cell_rate()).otherwise(cell_value()).alias("value"),
    )


def tidy_launch_hourly(cells: DataFrame, epoch_1904: bool = False):
    """Hourly launch sheet: (rows with a real clock time, rejected header cells)."""
    heads = cells.filter("row = 2 and col >= 2").withColumn("text", cell_text()).filter(
        (F.col("text") != "") & ~F.col("text").isin("总计", "合计")
    )
    serial = F.when(F.col("kind") != "b", F.col("d"))
    stamp = F.coalesce(F.col("ts"), hour_timestamp(F.col("s"), serial, F.lit(epoch_1904)))
    heads = heads.select(*_SHEET, "col", "text", stamp.alias("stamp"))
    labels = _row_labels(cells.filter("row >= 3"), {1: "metric"}).filter("metric is not null")
    # The current spelling of a metric wins over the old one when both rows exist.
    current, old = LAUNCH_RETAINED
    spelled = labels.groupBy(*_SHEET).agg(F.max(F.col("metric") == current).alias("_has"))
    labels = labels.join(spelled, _SHEET).filter(~(F.col("_has") & (F.col("metric") == old))).withColumn(
        "metric", F.when(F.col("metric") == old, current).otherwise(F.col("metric"))
    )
    body = cells.filter("row >= 3 and col >= 2").join(heads.filter("stamp is not null"), _SHEET + ["col"]).join(
        labels.select(*_SHEET, "row", "metric"), _SHEET + ["row"]
    )
    rows = body.select(*_SHEET, "metric", F.coalesce(cell_value(), F.lit(0.0)).alias("value"), F.col("stamp").alias("time"))
    return rows.withColumnRenamed("time", "ts"), heads.filter("stamp is null").select(*_SHEET, "col", "text")


def _find_row(cells: DataFrame, label: str, max_rows: int = 15) -> DataFrame:
    return cells.filter(F.col("row") <= max_rows).filter(cell_text() == label).groupBy(*_SHEET).agg(
        F.min("row").alias("head"), F.min_by("col", "row").alias("at")
    )


def _block_periods(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """Header cells from ``first`` up to (without) ``stop``, in one header row."""
    return cells.join(heads, _SHEET).filter("row = head and col >= first and (stop is null or col < stop)").select(
        *_SHEET, "head", "col", cell_text().alias("period")
    ).filter("period <> ''")


def tidy_sku_cells(cells: DataFrame):
    """SKU sheet: (share rows, cumulative rank rows). The blocks own their period headers."""
    total = cells.filter(F.col("row") <= 15).filter(cell_text() == "总计占比").groupBy(*_SHEET).agg(
        F.min("row").alias("head"), F.min(F.when(F.col("col") >= 6, F.col("col"))).alias("stop")
    )
    heads = total.withColumn("first", F.lit(6))
    share_heads = _block_periods(cells, heads)
    rows = cells.join(heads.select(*_SHEET, "head"), _SHEET).filter("row > head")
    names = {1: "code", 2: "version", 3: "exterior", 4: "interior", 5: "wheel"}
    labels = _row_labels(rows, names).filter("code is not null")
    share = rows.join(share_heads.drop("head"), _SHEET + ["col"]).join(labels, _SHEET + ["row"]).select(
        *_SHEET, "period", *names.values(), cell_rate().alias("share"), F.col("row").alias("ord")
    )
    starts = cells.join(heads.select(*_SHEET, "head"), _SHEET).filter("row = head").filter(cell_text() == "累计锁单").groupBy(
        *_SHEET, "head"
    ).agg(F.min("col").alias("start"))
    ends = cells.join(starts, _SHEET).filter("row = head and col > start").filter(cell_text() == TOTAL).groupBy(*_SHEET).agg(F.min("col").alias("stop"))
    cumulative = starts.join(ends, _SHEET, "left").withColumn("first", F.col("start") + 1)
    rank_heads = _block_periods(cells, cumulative)
    ranks = cells.join(starts, _SHEET).filter("row > head and col = start").select(*_SHEET, "row", F.upper(cell_text()).alias("label")).filter("label <> ''")
    topk = rows.join(rank_heads.drop("head"), _SHEET + ["col"]).join(ranks, _SHEET + ["row"]).select(
        *_SHEET, "period", "label", F.regexp_extract("label", r"(\d+)", 1).try_cast("int").alias("rank"), cell_rate().alias("share")
    )
    return share, topk


def tidy_combo_cells(cells: DataFrame) -> DataFrame:
    """Combination sheet: repeated blocks 累计锁单 | dimensions | periods | 总计."""
    head = _find_row(cells, "累计锁单").select(*_SHEET, "head")
    line = cells.join(head, _SHEET).filter("row = head").select(*_SHEET, "head", "col", cell_text().alias("text"))
    numbered = running_count(line, F.col("text") == "累计锁单", "block", _SHEET, "col").filter("block > 0")
    is_period = F.col("text").rlike(r"^(\d{2}|\d{4})(WK|[-/.年])\d{1,2}")
    closing = numbered.groupBy(*_SHEET, "block").agg(
        F.min("col").alias("start"), F.min(F.when(F.col("text") == TOTAL, F.col("col"))).alias("stop"),
        F.min(F.when(is_period, F.col("col"))).alias("first"),
    )
    spans = numbered.join(closing, _SHEET + ["block"]).filter("stop is null or col < stop")
    dims = spans.filter("col > start and col < first").select(*_SHEET, "block", "col")
    periods = spans.filter("col >= first").select(*_SHEET, "block", "col", F.col("text").alias("period"))
    ranks = spans.filter("col = start").select(*_SHEET, "block", "col", "head")
    titles = cells.join(ranks, _SHEET + ["col"]).filter("row = greatest(head - 1, 1)").select(
        *_SHEET, "block", F.replace(cell_text(), F.lit("配置组合_"), F.lit("")).alias("title")
    )
    body = cells.join(head, _SHEET).filter("row > head")
    rank_rows = body.join(ranks.drop("head"), _SHEET + ["col"]).select(*_SHEET, "block", "row", cell_text().alias("rank_label")).filter("rank_label <> ''")
    words = body.join(dims, _SHEET + ["col"]).filter(cell_text() != "").groupBy(*_SHEET, "block", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell_text().alias("t")))), lambda x: x["t"]), " × ").alias("label")
    )
    return body.join(periods, _SHEET + ["col"]).join(rank_rows, _SHEET + ["block", "row"]).join(
        words, _SHEET + ["block", "row"], "left"
    ).join(titles, _SHEET + ["block"], "left").select(
        *_SHEET, "title", "rank_label", F.coalesce("label", "rank_label").alias("label"), "period", cell_rate().alias("share")
    )


def tidy_rank_cells(cells: DataFrame) -> DataFrame:
    """Ranked items under the column headed 总计/合计 (else the last column)."""
    last = cells.groupBy(*_SHEET).agg(F.max("col").alias("_last"))
    named = cells.filter("row <= 5").filter(compact_identifier(cell_text()).isin("总计", "合计")).groupBy(*_SHEET).agg(
        F.min(F.struct("row", "col")).alias("_at")
    )
    column = last.join(named, _SHEET, "left").select(*_SHEET, F.coalesce("_at.col", "_last").alias("col"))
    labels = forward_fill(_row_labels(cells.filter("row >= 3"), {1: "generation", 2: "rank_text"}), ["generation"], _SHEET, "row")
    items = cells.filter("row >= 3").join(column, _SHEET + ["col"])
    return items.join(labels, _SHEET + ["row"]).select(
        *_SHEET, "generation", F.coalesce(norm_number(F.col("rank_text")).cast("int"), F.lit(0)).alias("rank"),
        cell_text().alias("item_text"), F.col("row").alias("ord"),
    )


def declared_coverage(cells: DataFrame) -> DataFrame:
    """Start and end dates a sheet states in its first ten rows, per file and sheet."""
    rows = cells.filter("row <= 10 and col <= 2")
    label = F.max(F.when(F.col("col") == 1, compact_text(F.col("s"))))
    day = F.max(F.when(F.col("col") == 2, F.coalesce(F.to_date("ts"), day_key(F.col("s")))))
    pairs = rows.groupBy(*_SHEET, "row").agg(label.alias("label"), day.alias("day"))
    return pairs.groupBy(*_SHEET).agg(
        F.max_by("day", F.when(F.col("label").isin(*COVERAGE_STARTS) & F.col("day").isNotNull(), F.col("row"))).alias("start"),
        F.max_by("day", F.when(F.col("label").isin(*COVERAGE_ENDS) & F.col("day").isNotNull(), F.col("row"))).alias("end"),
    ).filter("start <= end")


def raw_tables(cells: DataFrame) -> DataFrame:
    """Visible sheets as rows of text over the occupied columns.

    A first row holding one single value is a title and is dropped. Result: file, sheet,
    row, values MAP<col, text>, width.
    """
    shown = cells.filter(~F.coalesce("hidden", F.lit(False))).withColumn("text", cell_text()).filter("text <> ''")
    first = shown.groupBy(*_SHEET).agg(F.min("row").alias("_first"), F.countDistinct("row").alias("_rows"))
    rows = shown.groupBy(*_SHEET, "row").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "text")))).alias("values"),
        F.count(F.lit(1)).alias("width"),
    )
    return rows.join(first, _SHEET).filter("not (row = _first and width = 1 and _rows > 1)").select(*_SHEET, "row", "values", "width")


def preview(cells: DataFrame, rows: int = 80, cols: int = 24) -> DataFrame:
    """Corner of a sheet with the count of numeric cells in it."""
    corner = cells.filter((F.col("row") <= rows) & (F.col("col") <= cols))
    return corner.groupBy(*_SHEET).agg(
        F.count_if(F.col("kind") == "n").alias("numeric_cells"), F.max("row").alias("rows"), F.max("col").alias("cols")
    )

