"""Registered queries: merging of exports, layouts, quality, notes, streaming, expressions."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names, numbers, periods
from ..labels import DELIVERED, GRAINS, LOCKED, ORDERS, POWER, QTY, RETAINED, SHARE
from ..operators import annotate, coverage, merge, ordered, quality
from ..operators.lineage import cut_lineage, shared_folder
from ..plans import channel, dispatch, overview, structures
from ..plans import registry as analyses
from ..sources import cells as layout
from ..sources import reports, search
from ..streaming import refresh, rhythm
from . import tables as T
from .registry import out, register
from .sql import dbl, dy, mo, query, r6, wk

# ---- merging ----------------------------------------------------------------------------

def _scalar():
    return (F.col("stat") == QTY) & (F.col("category") == QTY)


# The two order metrics of the weekly exports, as (metric, left piece, right piece).
_PIECES = ("pcs AS (SELECT subject, period, pieces, '大定' AS metric, l, r, f1, f2 FROM exl UNION ALL "
           "SELECT subject, period, pieces, '留存大定', ll, lr, f1, f2 FROM exl)")
_SUM = "CASE WHEN pieces = 1 OR l = r THEN l ELSE l + r END"


def _weekly(spark, sf):
    # Several merge steps read the pieces: aggregate the orders once and keep the result.
    return cut_lineage(T.exports(spark, sf, ("week",)))


@register("g01_merge_sources", query("exl", "SELECT subject, period, metric, l AS value, CAST(f1 AS BIGINT) AS source_order FROM pcs", _PIECES))
def g01(spark, sf):
    merged = merge.merge_sources(_weekly(spark, sf)).filter(_scalar())
    return out(merged, "subject", "period", "metric", "value", "source_order")


@register("g02_unify_labels", query("exl", "SELECT metric, count(*) AS n, sum(l) AS total FROM pcs GROUP BY 1", _PIECES))
def g02(spark, sf):
    merged = merge.merge_sources(merge.unify_labels(_weekly(spark, sf))).filter(_scalar())
    return out(merged.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "metric", "n", "total")


@register("g04_boundary_weeks", query("exl", (
    f"SELECT subject, period, metric, {_SUM} AS value, pieces > 1 AND l <> r AS added, CASE WHEN pieces > 1 AND l <> r THEN r END AS second_value FROM pcs"), _PIECES))
def g04(spark, sf):
    merged = merge.merge_sources(_weekly(spark, sf), T.export_ranges(spark, sf)).filter(_scalar())
    return out(merged, "subject", "period", "metric", "value", "added", "second_value")


@register("i08_boundary_report", query("exl ex0", (
    "SELECT period, fields, first_source, last_source, examples, strftime(make_date(2023 + first_source // 2, CASE WHEN first_source % 2 = 1 THEN 7 ELSE 1 END, 1), '%Y-%m-%d') AS first_start, "
    "strftime(make_date(2023 + (last_source + 1) // 2, CASE WHEN last_source % 2 = 0 THEN 7 ELSE 1 END, 1) - 1, '%Y-%m-%d') AS last_end FROM ("
    "SELECT period, count(*) AS fields, min(f1) AS first_source, max(f2) AS last_source, array_to_string(list_sort(list(t))[1:3], '; ') AS examples FROM ("
    "SELECT period, f1, f2, subject || '/' || metric || '/数量' AS t FROM pcs WHERE pieces > 1 AND l <> r UNION ALL "
    "SELECT period, f1, f2, subject || '/门店类型/' || seg FROM sgl WHERE pieces > 1 AND l <> r) GROUP BY 1)"),
    _PIECES + ", sg AS (SELECT subject, seg, CAST(date_trunc('week', day) AS DATE) AS ps, f, CAST(count(*) AS DOUBLE) AS n FROM ex0 GROUP BY 1, 2, 3, 4), "
    "sgl AS (SELECT subject, seg, " + wk("ps") + " AS period, min(f) AS f1, max(f) AS f2, count(*) AS pieces, arg_min(n, f) AS l, arg_max(n, f) AS r FROM sg GROUP BY 1, 2, ps)"))
def i08(spark, sf):
    spans = T.export_ranges(spark, sf)
    report = merge.boundary_report(merge.add_boundary_weeks(_weekly(spark, sf), spans), spans)
    return out(report, "period", "fields", "first_source", "last_source", "examples", F.col("first_range.start").alias("first_start"), F.col("last_range.end").alias("last_end"))


_SEG = ("sg AS (SELECT subject, seg, CAST(date_trunc('week', day) AS DATE) AS ps, f, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT o_custkey) AS buyers FROM ex0 GROUP BY 1, 2, 3, 4), "
        "sgl AS (SELECT subject, seg, ps, count(*) AS pieces, arg_min(n, f) AS l, arg_max(n, f) AS r FROM sg GROUP BY 1, 2, 3), "
        "sgm AS (SELECT subject, seg, ps, CASE WHEN pieces = 1 OR l = r THEN l ELSE l + r END AS n FROM sgl), "
        "grown AS (SELECT subject, ps FROM sgl WHERE pieces > 1 AND l <> r UNION SELECT subject, ps FROM exl WHERE pieces > 1 AND (l <> r OR ll <> lr))")


@register("g05_distinct_stores", query("ex0 exl", (
    "SELECT e.subject, e.period, s.seg AS channel, CASE WHEN s.files < 2 THEN 'unknown side' ELSE 'both sides have stores' END AS reason, false AS known FROM exl e JOIN "
    "(SELECT subject, seg, ps, count(*) AS files FROM sg GROUP BY 1, 2, 3) s USING (subject, ps) WHERE e.pieces = 2"), _SEG))
def g05(spark, sf):
    judged = merge.merge_distinct_stores(_weekly(spark, sf), T.export_ranges(spark, sf))
    return out(judged, "subject", "period", F.col("category").alias("channel"), "reason", "known")


@register("i07_store_merge_notes", query("ex0 exl", (
    "SELECT subject, period, reason, count(*) AS channels FROM (SELECT e.subject, e.period, CASE WHEN s.files < 2 THEN 'unknown side' ELSE 'both sides have stores' END AS reason FROM exl e JOIN "
    "(SELECT subject, seg, ps, count(*) AS files FROM sg GROUP BY 1, 2, 3) s USING (subject, ps) WHERE e.pieces = 2) GROUP BY 1, 2, 3"), _SEG))
def i07(spark, sf):
    judged = merge.merge_distinct_stores(_weekly(spark, sf), T.export_ranges(spark, sf))
    return out(merge.store_merge_notes(judged), "subject", "period", "reason", "channels")


_RATIOS = (
    "SELECT m.subject, " + wk("m.ps") + " AS period, '门店类型' AS metric, m.seg AS category, " + r6("m.n / sum(m.n) OVER (PARTITION BY m.subject, m.ps)") + " AS value, 'counts' AS method "
    "FROM sgm m JOIN grown g ON g.subject = m.subject AND g.ps = m.ps UNION ALL "
    "SELECT e.subject, e.period, '动力', 'F', " + r6("CASE WHEN pieces > 1 AND l <> r THEN (ll + lr) / (l + r) ELSE ll / l END") + ", CASE WHEN pieces > 1 AND l <> r THEN 'weights' ELSE 'kept' END "
    "FROM exl e JOIN grown g ON g.subject = e.subject AND g.ps = e.ps"
)


@register("g06_rebuild_ratios", query("ex0 exl", _RATIOS, _SEG))
def g06(spark, sf):
    obs, spans = _weekly(spark, sf), T.export_ranges(spark, sf)
    ratios = merge.rebuild_ratios(obs, cut_lineage(merge.merge_sources(obs, spans)), spans)
    return out(ratios, "subject", "period", "metric", "category", "value", "method")


@register("g_merge_report", query("ex0 exl", (
    "SELECT subject, metric, stat, count(*) AS n, count(value) AS known, round(sum(value), 5) AS total FROM ("
    f"SELECT subject, metric, '数量' AS stat, {_SUM} AS value FROM pcs UNION ALL SELECT subject, '门店类型', '数量', n FROM sgm UNION ALL "
    "SELECT s.subject, '门店类型', '占比', coalesce(q.value, s.share) FROM (SELECT s.subject, s.seg, s.ps, " + wk("s.ps") + " AS period, arg_min(s.n / w.n, s.f) AS share FROM sg s JOIN exw w ON w.subject = s.subject AND w.ps = s.ps AND w.f = s.f GROUP BY 1, 2, 3) s "
    "LEFT JOIN q ON q.subject = s.subject AND q.period = s.period AND q.metric = '门店类型' AND q.category = s.seg UNION ALL "
    "SELECT e.subject, '动力', '占比', coalesce(q.value, e.ll / e.l) FROM exl e LEFT JOIN q ON q.subject = e.subject AND q.period = e.period AND q.metric = '动力' UNION ALL "
    "SELECT s.subject, '门店类型', '贡献门店数', CASE WHEN e.pieces = 1 THEN s.buyers END FROM (SELECT subject, seg, ps, CAST(arg_min(buyers, f) AS DOUBLE) AS buyers FROM sg GROUP BY 1, 2, 3) s JOIN exl e USING (subject, ps)"
    ") GROUP BY 1, 2, 3"), _PIECES + ", " + _SEG + f", q AS ({_RATIOS})"))
def g_report(spark, sf):
    merged = merge.merge_report(_weekly(spark, sf), T.export_ranges(spark, sf))
    rows = merged.groupBy("subject", "metric", "stat").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.round(F.sum("value"), 5).alias("total")
    )
    return out(rows, "subject", "metric", "stat", "n", "known", "total")


# Lost pieces of boundary weeks: power shares, shares and stores of channels (quantities add up).
_LOST = (_SEG + ", lost AS ("
    "SELECT subject, period, ps, f1, f2, '动力' AS metric, 'F' AS category, '占比' AS stat, 1 AS o, ll / l AS kept_value, lr / r AS lost_value FROM exl WHERE pieces > 1 AND abs(ll / l - lr / r) > 1e-12 UNION ALL "
    "SELECT a.subject, " + wk("a.ps") + ", a.ps, a.f, b.f, '门店类型', a.seg, x.stat, x.o, x.va, x.vb FROM sg a JOIN sg b ON a.subject = b.subject AND a.seg = b.seg AND a.ps = b.ps AND a.f < b.f "
    "JOIN exw wa ON wa.subject = a.subject AND wa.ps = a.ps AND wa.f = a.f JOIN exw wb ON wb.subject = b.subject AND wb.ps = b.ps AND wb.f = b.f, "
    "LATERAL (VALUES ('占比', 2, a.n / wa.n, b.n / wb.n), ('贡献门店数', 3, CAST(a.buyers AS DOUBLE), CAST(b.buyers AS DOUBLE))) x(stat, o, va, vb) WHERE abs(x.va - x.vb) > 1e-12)")


@register("g08_conflicts", query("ex0 exl", (
    "SELECT subject, period, metric, stat, category, 'split of a boundary week' AS reason, " + r6("kept_value") + " AS kept_value, " + r6("lost_value") + " AS lost_value FROM lost"), _LOST))
def g08(spark, sf):
    obs, spans = _weekly(spark, sf), T.export_ranges(spark, sf)
    found = merge.conflicts(obs, merge.merge_sources(obs, spans), spans)
    return out(found, "subject", "period", "metric", "stat", "category", "reason", "kept_value", "lost_value")


@register("g08_conflict_report", query("ex0 exl", (
    "SELECT subject, metric, CAST(f1 AS BIGINT) AS first_order, CAST(f2 AS BIGINT) AS source_order, count(*) AS cells, count(DISTINCT period) AS periods, min(period) AS ranges, "
    + r6("arg_min(kept_value, (category, o))") + " AS kept_value, " + r6("arg_min(lost_value, (category, o))") + " AS lost_value, least(count(*), 3) AS examples FROM lost GROUP BY subject, metric, f1, f2"), _LOST))
def g08_report(spark, sf):
    obs, spans = _weekly(spark, sf), T.export_ranges(spark, sf)
    report = merge.conflict_report(merge.conflicts(obs, merge.merge_sources(obs, spans), spans))
    first = F.col("examples")[0]
    return out(report, "subject", "metric", "first_order", "source_order", "cells", "periods", "ranges", first["kept_value"].alias("kept_value"), first["lost_value"].alias("lost_value"), F.size("examples").alias("examples"))


@register("d34_source_coverage", query("ex0", "SELECT CAST(f AS BIGINT) AS source_order, strftime(min(day), '%Y-%m-%d') AS start, strftime(max(day), '%Y-%m-%d') AS \"end\" FROM ex0 GROUP BY 1"))
def d34(spark, sf):
    return out(coverage.source_coverage(T.exports(spark, sf)), "source_order", "start", "end")


@register("a17_published_batches", query("oc", (
    "SELECT 'pinned' AS reader, subject, period, retained AS value FROM oc WHERE grain = 'month' UNION ALL SELECT 'current', subject, period, retained FROM oc WHERE grain = 'week'")))
def a17(spark, sf):
    """A reader holds the batch of months while the batch of weeks is published; a batch that was begun
    before that is refused."""
    root = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    rows = T.observations(spark, sf, ("week", "month")).filter(F.col("metric") == RETAINED)
    rows = rows.select(F.lit("overview").alias("module"), "subject", "grain", "period", "value")
    begun = reports.publish(rows.filter("grain = 'month'"), root, "months")
    held = reports.pin_batch(spark, root, "reader", 1)
    reports.publish(rows.filter("grain = 'week'"), root, "weeks", seen=begun)
    try:
        reports.publish(rows, root, "late", seen=begun)
    except reports.PublishConflict:
        pass
    reports.remove_expired(spark, root, keep=1)
    pinned = reports.read_published(spark, root, batch_id=held).withColumn("reader", F.lit("pinned"))
    current = reports.read_published(spark, root).withColumn("reader", F.lit("current"))
    return out(pinned.unionByName(current), "reader", "subject", "period", "value")


@register("g03_fill_sparse_days", query("ex0", (
    "SELECT subject, strftime(day, '%Y-%m-%d') AS period, CAST(f + 100 AS BIGINT) AS source_order, 0.0 AS value FROM (SELECT subject, day, f, count(*) FILTER (st = 'F') AS lf FROM ex0 GROUP BY 1, 2, 3) d WHERE lf = 0 "
    "AND EXISTS (SELECT 1 FROM ex0 e WHERE e.subject = d.subject AND e.f = d.f AND e.st = 'F')")))
def g03(spark, sf):
    daily = T.exports(spark, sf, ("day",)).filter(_scalar())
    # Locked orders come from exports of their own, which leave out days without any.
    locked = daily.filter("metric = '净大定' and value > 0").withColumn("source_order", F.col("source_order") + 100)
    both = daily.filter(F.col("metric") == ORDERS).unionByName(locked)
    spans = T.export_ranges(spark, sf).select("source_order", "start", "end")
    spans = spans.unionByName(spans.withColumn("source_order", F.col("source_order") + 100))
    filled = coverage.fill_sparse_days(both, spans).filter("value = 0")
    return out(filled, "subject", "period", "source_order", "value")


@register("c10_value_or_covered_zero", query("od", (
    "SELECT n.generation AS subject, strftime(d.day, '%Y-%m-%d') AS day, CASE WHEN v.locked > 0 THEN v.locked WHEN d.day BETWEEN n.a AND n.b THEN 0.0 END AS value FROM "
    "(SELECT generation, day FROM (SELECT DISTINCT brand, day FROM od) JOIN places USING (brand)) d JOIN (SELECT generation, min(day) AS a, max(day) AS b FROM od WHERE locked > 0 GROUP BY 1) n USING (generation) LEFT JOIN od v ON v.generation = n.generation AND v.day = d.day")))
def c10(spark, sf):
    days = T.order_days(spark, sf)
    values = days.filter("locked > 0").select(F.col("generation").alias("subject"), "day", F.col("locked").alias("value"))
    spans = values.groupBy("subject").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    # Every generation is asked for on every day its brand has orders.
    wanted = days.select("brand", "day").distinct().join(T.places(spark, sf), "brand").select(F.col("generation").alias("subject"), "day")
    return out(coverage.value_or_covered_zero(wanted, values, spans, ["subject"]), "subject", "day", "value")


@register("g07_merge_records", query("exl", (
    f"SELECT subject, period, {_SUM} AS orders, CASE WHEN pieces = 1 OR ll = lr THEN ll ELSE ll + lr END AS locked, " + r6("ll / l") + " AS lock_rate FROM exl")))
def g07(spark, sf):
    wide = _weekly(spark, sf).filter(_scalar()).groupBy("subject", "period", "source_order").agg(
        F.max(F.when(F.col("metric") == ORDERS, F.col("value"))).alias("orders"),
        F.max(F.when(F.col("metric") != ORDERS, F.col("value"))).alias("locked"),
    ).withColumn("lock_rate", F.col("locked") / F.col("orders")).withColumn("row_ord", F.lit(1))
    merged = merge.merge_records(wide, ["subject", "period"], ["orders", "locked", "lock_rate"], T.export_ranges(spark, sf), "period")
    return out(merged, "subject", "period", "orders", "locked", "lock_rate")


@register("g09_merge_fee", query("fc", (
    "SELECT generation, period, band, coalesce(CAST(nullif(count(*) FILTER (flag = 'A'), 0) AS DOUBLE), CAST(count(*) AS DOUBLE)) AS value FROM fc GROUP BY 1, 2, 3")))
def g09(spark, sf):
    cube = T.fee_observations(spark, sf)
    first = T.fee_table(cube.filter("l_returnflag = 'A'")).filter("row_kind = 'orders'").withColumn("source_order", F.lit(0))
    second = T.fee_table(cube).filter("row_kind = 'orders'").withColumn("source_order", F.lit(1))
    return out(merge.merge_fee(first.unionByName(second)), "generation", "period", "band", "value")


@register("g10_merge_blocks", query("exl", (
    f"SELECT '累计锁单' AS block, subject, period, {_SUM} AS value FROM exl UNION ALL SELECT '占比', subject, period, " + r6("ll / l") + " FROM exl")))
def g10(spark, sf):
    obs = _weekly(spark, sf)
    count = obs.filter(_scalar() & (F.col("metric") == ORDERS)).withColumn("block", F.lit("累计锁单"))
    share = obs.filter(F.col("metric") == POWER).withColumn("block", F.lit(SHARE))
    merged = merge.merge_blocks(count.unionByName(share), ["subject", "period"], T.export_ranges(spark, sf))
    return out(merged, "block", "subject", "period", "value")


@register("g11_merge_chart", query("exl", (
    f"SELECT subject, period, 'total' AS series, {_SUM} AS value FROM exl UNION ALL "
    "SELECT subject, period, 'F', " + r6("CASE WHEN pieces > 1 AND l <> r THEN (ll + lr) / (l + r) ELSE ll / l END") + " FROM exl")))
def g11(spark, sf):
    obs = _weekly(spark, sf)
    total = obs.filter(_scalar() & (F.col("metric") == ORDERS)).withColumn("series", F.lit(None).cast("string"))
    line = obs.filter(F.col("metric") == POWER).withColumn("series", F.col("category"))
    columns = ["report", "subject", "grain", "period", "series", "value", "source_order", "row_ord"]
    merged = merge.merge_chart(total.select(*columns).unionByName(line.select(*columns)), T.export_ranges(spark, sf))
    return out(merged.withColumn("series", F.coalesce("series", F.lit("total"))), "subject", "period", "series", "value")


@register("g15_dedupe_messages", query("ev", "SELECT DISTINCT brand, generation, event_type FROM ev"))
def g15(spark, sf):
    return out(merge.dedupe_messages(T.event_places(spark, sf).select("brand", "generation", "event_type")), "brand", "generation", "event_type")


@register("j01_refresh_batch", query("exl", (
    f"SELECT subject, period, metric, {_SUM} AS value FROM pcs WHERE period IN (SELECT period FROM exl WHERE f2 = (SELECT max(f2) FROM exl))"), _PIECES))
def j01(spark, sf):
    obs = _weekly(spark, sf).filter(_scalar())
    last = obs.agg(F.max("source_order").alias("source_order"))
    newest = obs.join(last, "source_order", "left_semi")
    keys = refresh.affected_keys(newest)
    wanted = keys.select("period").distinct()
    every = refresh.affected_keys(obs).join(wanted, "period", "left_semi")
    merged = refresh.refresh_batch(obs, every, T.export_ranges(spark, sf))
    return out(merged, "subject", "period", "metric", "value")


@register("j01_refresh_folder", query("exw", (
    f"SELECT subject, period, metric, {_SUM} AS value, f1 AS source_order FROM pcs"),
    "exl AS (SELECT subject, ps, " + wk("ps") + " AS period, min(f) AS f1, max(f) AS f2, count(*) AS pieces, arg_min(n, f) AS l, arg_max(n, f) AS r, arg_min(lf, f) AS ll, arg_max(lf, f) AS lr "
    "FROM exw WHERE f > (SELECT min(f) FROM exw) GROUP BY 1, 2), " + _PIECES))
def j01_folder(spark, sf):
    """Results after the latest export was added, the second rewritten with right numbers and the first deleted."""
    root = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    rows = _weekly(spark, sf).withColumn("source_file", F.concat(F.lit("export_"), F.lpad(F.col("source_order").cast("string"), 4, "0")))
    rows = rows.withColumn("source_sheet", F.lit(None).cast("string")).select(*schemas.OBSERVATIONS.fieldNames())
    ends = rows.agg(F.min("source_order").alias("first"), F.max("source_order").alias("last")).first()
    at, spans = F.col("source_order"), T.export_ranges(spark, sf)

    def write(part):
        part.withColumn("name", F.col("source_file")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(f"{root}/in")

    wrong = F.when(at == ends["first"] + 1, F.col("value") * 3).otherwise(F.col("value"))
    write(rows.filter(at < ends["last"]).withColumn("value", wrong))
    coverage_of = lambda read: spans.join(read.select("source_order").distinct(), "source_order", "left_semi")
    refresh.refresh_folder(spark, f"{root}/in", f"{root}/out", coverage_of)
    write(rows.filter((at == ends["last"]) | (at == ends["first"] + 1)))
    deleted = "name=export_" + str(ends["first"]).zfill(4)
    refresh.refresh_folder(spark, f"{root}/in", f"{root}/out", coverage_of, exclude=[deleted])
    merged = refresh.latest_results(spark, f"{root}/out").filter(_scalar())
    return out(merged, "subject", "period", "metric", "value", "source_order")


@register("j03_hourly_counts", query("ev", (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, brand AS subject, count(*) FILTER (event_type = 'purchase') AS orders, count(*) FILTER (event_type = 'error') AS cancel "
    "FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2")))
def j03(spark, sf):
    events = T.event_places(spark, sf).withColumn("subject", F.col("brand")).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = rhythm.hourly_counts(events)
    return out(counts.withColumn("hour", F.date_format("hour_start", "yyyy-MM-dd HH")), "hour", "subject", "orders", "cancel")


# ---- ordered operators ------------------------------------------------------------------

@register("e11_islands", query("od", (
    "SELECT generation, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS length FROM (SELECT generation, day, "
    "day - CAST(row_number() OVER (PARTITION BY generation ORDER BY day) AS INTEGER) AS run FROM od) GROUP BY generation, run")))
def e11(spark, sf):
    days = T.order_days(spark, sf).select("generation", F.date_format("day", "yyyy-MM-dd").alias("label"))
    runs = ordered.compress_labels(days, ["generation"], "label")
    return out(runs, "generation", F.col("first_label").alias("first_day"), F.col("last_label").alias("last_day"), "length")


@register("e12_cell_rectangles", query("ev", (
    "SELECT brand, row_first, row_last, min(hour) AS col_first, max(hour) AS col_last FROM (SELECT *, hour - row_number() OVER (PARTITION BY brand, row_first, row_last ORDER BY hour) AS g FROM ("
    "SELECT brand, hour, min(d) AS row_first, max(d) AS row_last FROM (SELECT *, d - row_number() OVER (PARTITION BY brand, hour ORDER BY d) AS run FROM (SELECT DISTINCT brand, hour(ts) AS hour, day(ts) AS d FROM ev WHERE event_type = 'error')) "
    "GROUP BY brand, hour, run)) GROUP BY brand, row_first, row_last, g")))
def e12(spark, sf):
    points = T.event_places(spark, sf).filter("event_type = 'error'").select(
        "brand", F.dayofmonth("ts").cast("bigint").alias("row"), F.hour("ts").cast("bigint").alias("col")
    )
    return out(ordered.cell_rectangles(points, ["brand"]), "brand", "row_first", "row_last", "col_first", "col_last")


@register("e13_forward_fill", query("ev", (
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY brand ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ev")))
def e13(spark, sf):
    rows = T.event_places(spark, sf).select("brand", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return out(ordered.forward_fill(rows, ["value"], ["brand"], "event_id", chunk=4096), "event_id", "value")


@register("e13_running_count", query("ev", (
    "SELECT event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY brand ORDER BY event_id) AS block FROM ev")))
def e13_count(spark, sf):
    rows = T.event_places(spark, sf).select("brand", "event_id", "event_type")
    counted = ordered.running_count(rows, F.col("event_type") == "signup", "block", ["brand"], "event_id", chunk=4096)
    return out(counted, "event_id", "block")


# ---- from cells to figures ---------------------------------------------------------------

def _export_cells(obs, word, file):
    """Observations as sheets: one per subject and grain, labels in columns 1 to 3."""
    sheet = F.concat("subject", F.lit("by"), F.element_at(F.create_map(*[F.lit(x) for w, g in GRAINS.items() for x in (g, w)]), F.col("grain")))
    told = obs.select(F.concat(F.lit(file), F.lpad(F.col("source_order").cast("string"), 4, "0"), F.lit(word)).alias("file"), sheet.alias("sheet"), "period", "metric", "stat", "category", "value")
    at = ["file", "sheet"]
    rows = told.select(*at, "metric", "stat", "category").distinct().withColumn("row", F.row_number().over(Window.partitionBy(*at).orderBy("metric", "stat", "category")) + 1)
    columns = told.select(*at, "period").distinct().withColumn("col", F.row_number().over(Window.partitionBy(*at).orderBy("period")) + 3)
    body = told.join(rows, [*at, "metric", "stat", "category"]).join(columns, [*at, "period"])
    place = (F.col("file"), F.col("sheet"))
    return ordered.union_all([
        _cells(columns, *place, F.lit(1), F.col("col"), s=F.col("period")), _cells(body, *place, F.col("row"), F.col("col"), d=F.col("value")),
        *[_cells(rows, *place, F.col("row"), F.lit(i), s=F.col(c)) for i, c in enumerate(("metric", "stat", "category"), 1)],
    ])


# Exports prove their range by the first and last day that they show; a week is added up where its
# two exports end and begin next to each other.
_PROVEN = (
    "cov AS (SELECT f, min(day) AS a, max(day) AS b, min(day) FILTER (st = 'F') AS la, max(day) FILTER (st = 'F') AS lb FROM ex0 GROUP BY f), "
    "ok AS (SELECT f1, f2, b = cut AND a = cut + 1 AS ok, lb = cut AND la = cut + 1 AS lok FROM (SELECT e.f AS f1, n.f AS f2, e.b, e.lb, n.a, n.la, "
    "CASE WHEN e.f % 2 = 1 THEN make_date(2023 + e.f // 2, 12, 31) ELSE make_date(2023 + e.f // 2, 6, 30) END AS cut FROM cov e JOIN cov n ON n.f = e.f + 1)), "
    "wk AS (SELECT e.*, coalesce(ok, false) AS ok, coalesce(lok, false) AS lok FROM exl e LEFT JOIN ok USING (f1, f2)), "
    "sg AS (SELECT subject, seg, CAST(date_trunc('week', day) AS DATE) AS ps, f, CAST(count(*) AS DOUBLE) AS n FROM ex0 GROUP BY 1, 2, 3, 4), "
    "sgl AS (SELECT s.*, s.pieces > 1 AND s.l <> s.r AND w.ok AS added FROM (SELECT subject, seg, ps, count(*) AS pieces, arg_min(n, f) AS l, arg_max(n, f) AS r, arg_min(sh, f) AS share "
    "FROM (SELECT sg.*, n / sum(n) OVER (PARTITION BY subject, ps, f) AS sh FROM sg) GROUP BY 1, 2, 3) s JOIN wk w USING (subject, ps)), "
    "sgm AS (SELECT *, CASE WHEN added THEN l + r ELSE l END AS n FROM sgl), "
    "grown AS (SELECT subject, ps FROM sgl WHERE added UNION SELECT subject, ps FROM wk WHERE pieces > 1 AND ok AND (l <> r OR ll <> lr)), "
    "calm AS (SELECT subject, 'day' AS grain, " + dy("day") + " AS period, st FROM ex0 UNION ALL SELECT subject, 'month', " + mo("day") + ", st FROM ex0), "
    "ov AS (SELECT subject, grain, period, CAST(count(*) AS DOUBLE) AS orders, CAST(count(*) FILTER (st = 'F') AS DOUBLE) AS retained, CAST(count(*) FILTER (st = 'F') AS DOUBLE) AS locked FROM calm GROUP BY 1, 2, 3 UNION ALL "
    "SELECT subject, 'week', period, CASE WHEN pieces > 1 AND l <> r AND ok THEN l + r ELSE l END, CASE WHEN pieces > 1 AND ll <> lr AND ok THEN ll + lr ELSE ll END, "
    # The lock report has no cell without a locked order, so its range may end earlier.
    "CASE WHEN pieces = 1 OR lr = 0 THEN ll WHEN ll = 0 THEN lr WHEN ll <> lr AND lok THEN ll + lr ELSE ll END FROM wk)"
)


@register("p_end_to_end", query("ex0 exl", (
    "SELECT 'overview' AS section, subject, grain, period, x.label, x.value FROM ov, LATERAL (VALUES ('大定', orders), ('留存大定', retained), ('交车锁单', locked)) x(label, value) WHERE locked > 0 UNION ALL "
    "SELECT 'mix', subject, 'week', period, '动力 F', " + r6("CASE WHEN pieces > 1 AND l <> r AND ok THEN (ll + lr) / (l + r) ELSE ll / l END") + " FROM wk UNION ALL "
    "SELECT 'channel', s.subject, 'week', " + wk("s.ps") + ", s.seg || ' n', s.n FROM sgm s UNION ALL "
    "SELECT 'channel', s.subject, 'week', " + wk("s.ps") + ", s.seg || ' share', " + r6("CASE WHEN g.ps IS NOT NULL THEN s.n / sum(s.n) OVER (PARTITION BY s.subject, s.ps) ELSE s.share END") + " FROM sgm s LEFT JOIN grown g ON g.subject = s.subject AND g.ps = s.ps"
), _PROVEN))
def end_to_end(spark, sf):
    """Half-year exports as cells of order and lock reports, read, merged and analysed."""
    obs = cut_lineage(T.exports(spark, sf, ("day", "week", "month")))
    locked = obs.filter("metric = '净大定' and value > 0").withColumn("metric", F.lit(LOCKED))
    cells = cut_lineage(_export_cells(obs, "大定选配比例", "a").unionByName(_export_cells(locked, "锁单选配比例", "b")))
    read = dispatch.Dispatch(cells, _rules(spark, sf))
    kpis = overview.overview_kpis(read.overview).filter(F.col("label") != DELIVERED)
    orders = read.observations.filter("report = 'order_mix' and grain = 'week'")
    mix = structures.structures(orders.filter(F.col("metric") == POWER))
    values = channel.channel_values(orders).withColumn("x", F.explode(F.array(
        F.struct(F.concat("channel", F.lit(" n")).alias("label"), F.col("n").alias("value")), F.struct(F.concat("channel", F.lit(" share")).alias("label"), F.col("share").alias("value")))))
    page = ["subject", "grain", "period"]
    return out(ordered.union_all([
        kpis.select(F.lit("overview").alias("section"), *page, "label", "value"),
        mix.select(F.lit("mix").alias("section"), *page, F.concat_ws(" ", "metric", "category").alias("label"), F.col("share").alias("value")),
        values.filter("x.value is not null").select(F.lit("channel").alias("section"), *page, "x.label", "x.value"),
    ]), "section", *page, "label", "value")


# ---- layouts: sheets written as cells and read back -------------------------------------

def _cells(df, file, sheet, row, col, s=None, d=None, ts=None, fmt="General"):
    none = F.lit(None)
    kind = "n" if d is not None else ("d" if ts is not None else "s")
    return df.select(
        file.alias("file"), sheet.alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), F.lit(kind).alias("kind"),
        (s if s is not None else none).cast("string").alias("s"), (d if d is not None else none).cast("double").alias("d"),
        (ts if ts is not None else none).cast("timestamp_ntz").alias("ts"), F.lit(fmt).alias("fmt"), F.lit(False).alias("hidden"),
    )


def metric_cells(spark, sf):
    """The monthly mix report as sheets: labels in columns 1-3, periods from column 4.

    Metric and statistic are only written where they change, as in printed reports.
    """
    obs = cut_lineage(T.mix_observations(spark, sf).filter("value is not null"))
    labels = obs.select("subject", "metric", "stat", "category", "row_ord").distinct()
    w = Window.partitionBy("subject").orderBy("stat", "row_ord", "category")
    rows = labels.withColumn("row", F.row_number().over(w) + 1)
    rows = rows.withColumn("_m", F.lag("metric").over(w)).withColumn("_s", F.lag("stat").over(w))
    sheet, file = F.concat("subject", F.lit("by月")), F.lit("mix")
    changed = F.coalesce(F.col("_m") != F.col("metric"), F.lit(True)) | F.coalesce(F.col("_s") != F.col("stat"), F.lit(True))
    months = F.months_between("period_start", F.lit("1995-01-01").cast("date")).cast("int") + 4
    numbered = obs.join(rows.select("subject", "metric", "stat", "category", "row"), ["subject", "metric", "stat", "category"])
    return ordered.union_all([
        _cells(obs.select("subject", "period", "period_start").distinct(), file, sheet, F.lit(1), months, s=F.col("period")),
        _cells(rows.filter(changed), file, sheet, F.col("row"), F.lit(1), s=F.col("metric")),
        _cells(rows.filter(changed), file, sheet, F.col("row"), F.lit(2), s=F.col("stat")),
        _cells(rows, file, sheet, F.col("row"), F.lit(3), s=F.col("category")),
        _cells(numbered, file, sheet, F.col("row"), months, d=F.col("value"), fmt="0.00"),
    ])


@register("a04_tidy_metric_cells", query("mx", (
    "SELECT subject || 'by月' AS sheet, period, metric, '占比' AS stat, category, " + r6("share") + " AS value FROM mx UNION ALL "
    "SELECT subject || 'by月', period, metric, '数量', category, n FROM mx WHERE n IS NOT NULL")))
def a04(spark, sf):
    return out(layout.tidy_metric_cells(metric_cells(spark, sf)), "sheet", "period", "metric", "stat", "category", "value")


@register("a14_raw_tables", query("mx", (
    "SELECT sheet, sum(width) AS cells, count(*) AS rows FROM (SELECT subject || 'by月' AS sheet, metric || category || 'a' AS r, count(*) AS width FROM mx GROUP BY 1, 2 UNION ALL "
    "SELECT subject || 'by月', metric || category || 'b', count(n) FROM mx WHERE n IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT subject || 'by月', 'h', count(DISTINCT period) FROM mx GROUP BY 1) GROUP BY 1").replace("sum(width) AS cells", "CAST(sum(width) AS BIGINT) AS cells")))
def a14(spark, sf):
    raw = layout.raw_tables(metric_cells(spark, sf))
    # Cells of the period columns only: label columns are 1 to 3.
    body = F.size(F.filter(F.map_keys("values"), lambda c: c > 3)).cast("bigint")
    return out(raw.groupBy("sheet").agg(F.sum(body).alias("cells"), F.count(F.lit(1)).alias("rows")), "sheet", "cells", "rows")


@register("a19_preview", query("mx", (
    "SELECT 'mix' AS file, subject || 'by月' AS sheet, count(*) FILTER (rw <= 80 AND (year(ps) - 1995) * 12 + month(ps) + 3 <= 24) AS numeric_cells FROM ("
    "SELECT subject, ps, dense_rank() OVER (PARTITION BY subject ORDER BY st, ord, category) + 1 AS rw FROM (SELECT subject, ps, ord, category, '占比' AS st FROM mx UNION ALL "
    "SELECT subject, ps, ord, category, '数量' FROM mx WHERE n IS NOT NULL)) GROUP BY 1, 2")))
def a19(spark, sf):
    return out(layout.preview(metric_cells(spark, sf)), "file", "sheet", "numeric_cells")


@register("a05_tidy_chart_cells", query("exl", (
    "SELECT subject, subject || '周留存大定' AS headline, period, '' AS series, l AS value FROM exl UNION ALL SELECT subject, subject || '周留存大定', period, 'F', " + r6("ll / l") + " FROM exl")))
def a05(spark, sf):
    obs = cut_lineage(merge.merge_sources(_weekly(spark, sf)))
    total = obs.filter(_scalar() & (F.col("metric") == ORDERS))
    share = obs.filter(F.col("metric") == POWER)
    blocks = total.select("subject").distinct().withColumn("top", F.length("subject") * 10 + F.ascii("subject") * 1000 + F.ascii(F.substring("subject", 2, 1)) * 37)
    file, sheet = F.lit("chart"), F.lit("图表by周")
    week = F.floor(F.datediff(periods.iso_week(F.col("period"))["start"], F.lit("2022-12-26").cast("date")) / 7) + 3
    t, s = total.join(blocks, "subject"), share.join(blocks, "subject")
    cells = ordered.union_all([
        _cells(blocks, file, sheet, F.col("top"), F.lit(1), s=F.col("subject")),
        _cells(blocks, file, sheet, F.col("top") + 1, F.lit(2), s=F.concat("subject", F.lit("周留存大定"))),
        _cells(blocks, file, sheet, F.col("top") + 2, F.lit(2), s=F.lit("F")),
        _cells(blocks, file, sheet, F.col("top") + 3, F.lit(2), s=F.lit("总计")),
        _cells(t, file, sheet, F.col("top") + 1, week, s=F.col("period")),
        _cells(t, file, sheet, F.col("top") + 3, week, d=F.col("value")),
        _cells(s, file, sheet, F.col("top") + 2, week, d=F.col("value")),
    ])
    rows = layout.tidy_chart_cells(cells)
    return out(rows.withColumn("series", F.coalesce("series", F.lit(""))), "subject", "headline", "period", "series", "value")


@register("a06_header_records", query("rh", "SELECT subject AS sheet, strftime(day, '%Y-%m-%d') AS date, CAST(hour AS DOUBLE) AS hour, orders, cancel FROM rh"))
def a06(spark, sf):
    from ..labels import HOURLY_HEADERS

    rows = cut_lineage(T.retreat_hourly(spark, sf))
    w = Window.partitionBy("subject").orderBy("date", "hour")
    rows = rows.withColumn("row", F.row_number().over(w) + 3)
    heads = rows.select("subject").distinct()
    file, sheet = F.lit("cancel"), F.col("subject")
    titles = ((1, "总退订数"), (3, "下单日期"), (4, "小时"), (6, "小订 数量"))
    cells = ordered.union_all(
        [_cells(heads, file, sheet, F.lit(1), F.lit(1), s=F.lit("小订日期"))]
        + [_cells(heads, file, sheet, F.lit(3), F.lit(c), s=F.lit(t)) for c, t in titles]
        + [
            _cells(rows, file, sheet, F.col("row"), F.lit(1), d=F.col("cancel")),
            _cells(rows, file, sheet, F.col("row"), F.lit(3), ts=F.col("date").cast("timestamp_ntz")),
            _cells(rows, file, sheet, F.col("row"), F.lit(4), d=F.col("hour")),
            _cells(rows, file, sheet, F.col("row"), F.lit(6), d=F.col("orders")),
        ]
    )
    header = layout.resolve_header(cells, HOURLY_HEADERS, ["date", "hour", "orders", "cancel"])
    records = layout.header_records(cells, header, ["date"], ["hour", "orders", "cancel"])
    return out(records, "sheet", "date", "hour", "orders", "cancel")


@register("a07_tidy_cohort_cells", query("co", "SELECT subject AS sheet, period, " + ", ".join(f"s{i}" for i in range(1, 8)) + " FROM co WHERE grain = 'month'"))
def a07(spark, sf):
    from ..labels import STAGES

    rows = cut_lineage(T.cohorts(spark, sf).filter("grain = 'month'"))
    w = Window.partitionBy("subject").orderBy("period")
    rows = rows.withColumn("row", F.row_number().over(w) + 2)
    heads = rows.select("subject").distinct()
    file, sheet = F.lit("conversion"), F.col("subject")
    # Stages stand in reverse order, the period in the last column.
    at = {i: 9 - i for i in range(1, 8)}
    cells = ordered.union_all(
        [_cells(heads, file, sheet, F.lit(1), F.lit(at[i + 1]), s=F.lit(stage)) for i, stage in enumerate(STAGES)]
        + [_cells(heads, file, sheet, F.lit(2), F.lit(at[i]), s=F.lit("数量")) for i in at]
        + [_cells(heads, file, sheet, F.lit(1), F.lit(10), s=F.lit("月")), _cells(rows, file, sheet, F.col("row"), F.lit(10), s=F.col("period"))]
        + [_cells(rows.filter(f"s{i} is not null"), file, sheet, F.col("row"), F.lit(at[i]), d=F.col(f"s{i}")) for i in at]
    )
    return out(layout.tidy_cohort_cells(cells), "sheet", "period", *[f"s{i}" for i in range(1, 8)])


@register("a15_search_page", (
    "SELECT doc_id, lang, source FROM documents WHERE lower(text) LIKE '%license%' OR lower(lang) LIKE '%license%' OR lower(source) LIKE '%license%' ORDER BY doc_id LIMIT 50 OFFSET 5"))
def a15(spark, sf):
    docs = T.table(spark, sf, "documents")
    return out(reports.search_page(docs, "License", "doc_id", offset=5, limit=50, columns=["text", "lang", "source"]), "doc_id", "lang", "source")


@register("a15_search_total", "SELECT count(*) AS total FROM pages WHERE lower(url) LIKE '%example.com%' OR lower(html) LIKE '%example.com%'")
def a15_total(spark, sf):
    return out(reports.search_total(T.table(spark, sf, "pages"), "Example.com", columns=["url", "html"]), "total")


def _indexed(df, order, columns):
    return search.build_index(df, f"{shared_folder(df.sparkSession)}/search-{uuid.uuid4().hex}", order, columns)


@register("a15_indexed_page", (
    "SELECT doc_id, lang, source FROM documents WHERE lower(text) LIKE '%license%' OR lower(lang) LIKE '%license%' OR lower(source) LIKE '%license%' ORDER BY doc_id LIMIT 50 OFFSET 5"))
def a15_indexed(spark, sf):
    index = _indexed(T.table(spark, sf, "documents"), "doc_id", ["text", "lang", "source"])
    return out(index.page("License", offset=5, limit=50), "doc_id", "lang", "source")


@register("a15_indexed_search", "SELECT page_id FROM pages WHERE lower(url) LIKE '%example.net%' OR lower(html) LIKE '%example.net%'")
def a15_indexed_search(spark, sf):
    return out(_indexed(T.table(spark, sf, "pages"), "page_id", ["url", "html"]).search("Example.NET"), "page_id")


@register("a16_csv_values", (
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS l_quantity, l_returnflag FROM lineitem"))
def a16(spark, sf):
    return reports.csv_values(T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


# ---- subjects, lineage, quality ---------------------------------------------------------

def _rules(spark, sf):
    """Group and brands of the given tables; brands are a handful of names."""
    return names.NamingRules(group="ALL", brands=tuple(r["r_name"] for r in T.table(spark, sf, "region").select("r_name").collect()))


def _sheet_names(spark, sf):
    """Sheet names like 'ASIA BUILDING 2024款by月', one per brand, segment and order year."""
    orders = T.table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    customer = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(T.places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat("brand", F.lit(" "), "c_mktsegment", F.lit(" "), (F.col("y") + 25).cast("string"), F.lit("款by月"))
    return rows.groupBy(name.alias("name")).agg(F.min("y").cast("bigint").alias("ord"))


_NAMES = ("nm AS (SELECT DISTINCT brand, brand || ' ' || c_mktsegment || ' ' || CAST(year(o_orderdate) + 25 AS VARCHAR) || '款' AS name, brand || c_mktsegment AS model, year(o_orderdate) + 25 AS y "
          "FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey)")


def _discovered(spark, sf):
    none = spark.createDataFrame([], "name string, ord bigint")
    campaigns = spark.createDataFrame([], "generation string, sub_generation string")
    brands = T.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("ord"))
    return quality.discover_subjects(_sheet_names(spark, sf), none.unionByName(brands), campaigns, _rules(spark, sf))


@register("i01_discover_subjects", query("places", (
    "SELECT name, 'generation' AS type, replace(brand, ' ', '') AS parent FROM nm UNION ALL SELECT r_name, 'brand', 'ALL' FROM region UNION ALL SELECT 'ALL', 'group', NULL"), _NAMES))
def i01(spark, sf):
    return out(_discovered(spark, sf), "name", "type", "parent")


@register("b05_latest_generations", query("places", "SELECT arg_max(name, y) AS name FROM nm GROUP BY model", _NAMES))
def b05(spark, sf):
    return out(quality.latest_generations(_discovered(spark, sf).filter("type = 'generation'")), "name")


@register("b04_latest_model_year", query("places", "SELECT arg_max(name, y) AS subject FROM nm GROUP BY model", _NAMES))
def b04(spark, sf):
    found = _discovered(spark, sf).filter("type = 'generation'").select(F.col("name").alias("subject"))
    return out(overview.latest_model_year(found), "subject")


@register("h15_generation_names", query("places", (
    "SELECT name, lower(replace(model, ' ', '')) AS model_key, CAST(y AS BIGINT) AS year, trim(substr(name, length(brand) + 1, length(name) - length(brand) - 5)) || ' ' || substr(CAST(y AS VARCHAR), 3) AS short FROM nm"), _NAMES))
def h15(spark, sf):
    found = _discovered(spark, sf).filter("type = 'generation'")
    c = F.col("name")
    return out(found, "name", names.generation_model_key(c).alias("model_key"), names.generation_year(c).alias("year"), names.short_name(c, _rules(spark, sf)).alias("short"))


@register("f02_subject_order", query("subj", (
    "SELECT name, CASE type WHEN 'group' THEN 0 WHEN 'brand' THEN 1 ELSE 2 END AS type_order, coalesce(r_regionkey, 1000000) AS brand_order FROM subj LEFT JOIN region ON r_name = CASE WHEN type = 'brand' THEN name ELSE parent END").replace("coalesce(r_regionkey", "coalesce(CAST(r_regionkey AS BIGINT)")))
def f02(spark, sf):
    from ..operators.compare import subject_order

    brands = T.table(spark, sf, "region").select(F.col("r_name").alias("brand"), F.col("r_regionkey").alias("position"))
    return out(subject_order(T.subjects(spark, sf), brands), "name", "type_order", "brand_order")


def _sources(spark, sf):
    obs = T.observations(spark, sf, ("week", "month"))
    module = F.when(F.col("metric") == ORDERS, "order_mix").when(F.col("metric") == RETAINED, "overview").otherwise("lock_mix")
    return obs.select("subject", F.col("report").alias("file"), F.col("grain").alias("sheet"), module.alias("module")).distinct()


_SRC = ("src AS (SELECT DISTINCT subject, 'order_mix' AS file, grain AS sheet, m.module FROM oc, (VALUES ('order_mix'), ('overview')) m(module) WHERE grain <> 'day' "
        "UNION SELECT DISTINCT subject, 'lock_mix', grain, 'lock_mix' FROM ob WHERE grain <> 'day')")


@register("c13_consumers", query("oc ob", "SELECT subject, file, sheet, string_agg(module, ',' ORDER BY module) AS modules, count(*) AS n_modules FROM src GROUP BY 1, 2, 3", _SRC))
def c13(spark, sf):
    return out(quality.consumers(_sources(spark, sf)), "subject", "file", "sheet", "modules", "n_modules")


@register("c14_expand_lineage", query("oc ob", (
    "SELECT DISTINCT s.subject, s.module, coalesce(a.pf, s.file) AS file, s.sheet FROM src s LEFT JOIN (SELECT DISTINCT 'order_mix' AS file, 'orders_' || CAST(year(o_orderdate) + 28 AS VARCHAR) || CASE WHEN month(o_orderdate) > 6 THEN 'H2' ELSE 'H1' END AS pf FROM orders) a "
    "ON a.file = s.file AND s.sheet = 'week'"), _SRC))
def c14(spark, sf):
    aliases = T.export_ranges(spark, sf).select(
        F.lit("order_mix").alias("file"), F.lit("week").alias("sheet"), F.col("source_file").alias("physical_file"), F.lit("week").alias("physical_sheet")
    )
    return out(quality.expand_lineage(_sources(spark, sf), aliases), "subject", "module", "file", "sheet")


@register("c16_capabilities", query("oc ob", "SELECT subject, 'overview,order_mix,' || CASE WHEN bool_or(module = 'lock_mix') THEN 'lock_mix,' ELSE '' END || 'raw' AS modules FROM src GROUP BY 1", _SRC))
def c16(spark, sf):
    order = ["overview", "channel_analysis", "order_mix", "lock_mix"]
    return out(quality.capabilities(T.subjects(spark, sf), _sources(spark, sf), order), "subject", "modules")


def _sheet_list(spark, sf):
    """One sheet per (nation, segment) with its orders as rows; two segments have no module."""
    orders = T.table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    customer = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderstatus") == "P").alias("numeric")
    ).join(T.places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    known = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY")
    return joined.select(
        F.col("brand").alias("subject"), F.col("c_mktsegment").alias("file"), F.col("generation").alias("sheet"),
        F.when(known, F.lower("c_mktsegment")).alias("module"), "rows", "numeric",
    )


_SHEETS = ("sl AS (SELECT brand AS subject, c_mktsegment AS file, generation AS sheet, CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING','MACHINERY') THEN lower(c_mktsegment) END AS module, count(*) AS rows, "
           "count(*) FILTER (o_orderstatus = 'P') AS numeric FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, c_mktsegment), "
           "stt AS (SELECT *, CASE WHEN module IS NULL THEN 'unmatched' WHEN module = 'building' THEN 'consumed' WHEN numeric = 0 THEN 'check: no numbers' WHEN rows <= 2 THEN 'check: header only' ELSE 'check: not used' END AS status FROM sl)")


def _statuses(spark, sf):
    sheets = _sheet_list(spark, sf)
    used = quality.consumers(sheets.filter("module = 'building'").select("subject", "file", "sheet", F.lit("overview").alias("module")))
    return quality.import_status(sheets, used)


@register("i04_import_status", query("places", "SELECT subject, file, sheet, status FROM stt", _SHEETS))
def i04(spark, sf):
    return out(_statuses(spark, sf), "subject", "file", "sheet", "status")


@register("d35_import_health", query("places", (
    "SELECT subject, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status <> 'unmatched') AS recognised, count(*) FILTER (status LIKE 'check%') AS to_check, "
    "count(DISTINCT file) AS files, CAST(coalesce(sum(numeric) FILTER (status = 'unmatched'), 0) AS BIGINT) AS unmatched_numeric FROM stt GROUP BY 1"), _SHEETS))
def d35(spark, sf):
    return out(quality.import_health(_statuses(spark, sf)), "subject", "unmatched", "recognised", "to_check", "files", "unmatched_numeric")


@register("k_generic", query("places", (
    "SELECT 'generic' AS module, subject, 'week' AS grain, 'all' AS period, x.label, x.value FROM (SELECT subject, count(*) FILTER (status = 'unmatched') AS u, count(*) FILTER (status <> 'unmatched') AS r, "
    "count(*) FILTER (status LIKE 'check%') AS c, count(DISTINCT file) AS f, coalesce(sum(numeric) FILTER (status = 'unmatched'), 0) AS n FROM stt GROUP BY 1), "
    "LATERAL (VALUES ('unmatched', CAST(u AS DOUBLE)), ('recognised', CAST(r AS DOUBLE)), ('to_check', CAST(c AS DOUBLE)), ('files', CAST(f AS DOUBLE)), ('unmatched_numeric', CAST(n AS DOUBLE))) x(label, value)"), _SHEETS))
def k_generic(spark, sf):
    return out(analyses.generic_figures(_statuses(spark, sf)), *analyses.COLUMNS)


@register("k_raw", query("mx", (
    "SELECT 'raw' AS module, 'mix' AS subject, '' AS grain, subject || 'by月' AS period, x.label, x.value FROM (SELECT subject, max((year(ps) - 1995) * 12 + month(ps) + 3) AS columns, "
    "1 + count(DISTINCT metric || category) + count(DISTINCT metric || category) FILTER (n IS NOT NULL) AS rows FROM mx GROUP BY 1), "
    "LATERAL (VALUES ('rows', CAST(rows AS DOUBLE)), ('columns', CAST(columns AS DOUBLE))) x(label, value)")))
def k_raw(spark, sf):
    return out(analyses.raw_figures(metric_cells(spark, sf)), *analyses.COLUMNS)


@register("i02_validate", query("ob", (
    "SELECT 'overview' AS module, problem, count(*) AS rows, count(DISTINCT subject) AS subjects FROM (SELECT subject, 'unknown subject' AS problem FROM ob WHERE subject = 'ALL' UNION ALL "
    "SELECT subject, 'invalid number' FROM ob WHERE retained = 0 UNION ALL SELECT subject, 'source missing' FROM ob WHERE grain = 'week') GROUP BY 1, 2")))
def i02(spark, sf):
    base = overview.overview_base(T.observations(spark, sf))
    kpis = base.select(
        F.lit("overview").alias("module"), "subject", "grain", "period", F.lit("rate").alias("label"),
        F.when(F.col("retained") == 0, F.lit(float("nan"))).otherwise(F.col("orders")).alias("value"), F.lit("").alias("text"),
        F.lit("orders").alias("file"), F.when(F.col("grain") != "week", F.col("grain")).alias("sheet"),
    )
    return out(quality.validate(kpis, T.subjects(spark, sf).filter("type <> 'group'")), "module", "problem", "rows", "subjects")


@register("i06_module_order", query("oc ob", "SELECT module, 'missing' AS problem FROM (SELECT DISTINCT module FROM src WHERE module <> 'overview') UNION ALL SELECT 'forecast', 'unknown'", _SRC))
def i06(spark, sf):
    configured = spark.range(1).select(F.explode(F.array(F.lit("overview"), F.lit("forecast"))).alias("module"))
    return out(quality.check_module_order(configured, _sources(spark, sf).select("module").distinct()), "module", "problem")


@register("d_labels_without_document", "SELECT l.doc_id, l.quality FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id")
def d_labels(spark, sf):
    labels = T.table(spark, sf, "labels")
    return out(labels.join(T.table(spark, sf, "documents"), "doc_id", "left_anti"), "doc_id", "quality")


# ---- notes ------------------------------------------------------------------------------

@register("c11_annotations_for", query("nt subj", (
    "SELECT s.name, count(*) AS notes FROM subj s JOIN nt n ON n.target = s.name OR n.target = s.parent GROUP BY 1")))
def c11(spark, sf):
    subjects = T.subjects(spark, sf)
    shown = annotate.annotations_for(T.notes(spark, sf), subjects)
    named = shown.join(subjects.select(F.col("id").alias("subject_id"), "name"), "subject_id")
    return out(named.groupBy("name").agg(F.count(F.lit(1)).alias("notes")), "name", "notes")


@register("c12_annotate_periods", query("nt subj", (
    "SELECT v.name, v.period, arg_min(text, date || text) AS text, arg_min(date, date || text) AS date, count(*) - 1 AS more FROM (SELECT s.name, n.*, " + wk("n.day") + " AS period "
    "FROM subj s JOIN nt n ON n.target = s.name OR n.target = s.parent) v GROUP BY 1, 2")))
def c12(spark, sf):
    subjects = T.subjects(spark, sf)
    week = periods.week_label(F.col("ts").cast("date")).alias("period")
    active = T.by_level(T.event_places(spark, sf).select("brand", "generation", week).distinct()).select(F.col("subject").alias("name"), "period").distinct()
    pages = active.join(subjects.select(F.col("id").alias("subject_id"), "name"), "name")
    shown = annotate.annotate_subject_periods(T.notes(spark, sf), subjects, pages, "week")
    return out(shown, "name", "period", "text", "date", "more")


@register("c17_apply_changes", query("ev", (
    "SELECT status, action, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'update' WHEN event_type = 'signup' THEN 'delete' ELSE 'add' END AS action, "
    "CASE WHEN event_type = 'click' THEN CASE WHEN value > 20 THEN 422 ELSE 200 END WHEN event_type = 'view' THEN 404 WHEN event_type IN ('error', 'signup') AND value > 10 THEN 409 ELSE 200 END AS status FROM "
    "ev) GROUP BY 1, 2").replace("ELSE 'add' END AS action", "WHEN event_type = 'view' THEN 'update' ELSE 'add' END AS action")))
def c17(spark, sf):
    _, audit = _changed(spark, sf)
    return out(audit.groupBy("status", "action").agg(F.count(F.lit(1)).alias("n")), "status", "action", "n")


def _changed(spark, sf):
    e = T.event_places(spark, sf)
    kind = F.col("event_type")
    action = F.when(kind.isin("error", "view"), "update").when(kind == "signup", "delete").otherwise("add")
    changes = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ord"), action.alias("action"),
        F.when(F.col("value") > 10, 2).otherwise(1).alias("expected_version"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("brand_"), F.substring(F.sha1("brand"), 1, 10)).alias("subject"),
        F.when((kind == "click") & (F.col("value") > 20), F.lit("  ")).otherwise(F.col("event_type")).alias("text"),
    )
    return annotate.apply_changes(T.notes(spark, sf), changes, T.subjects(spark, sf))


@register("c17_new_state", query("ev nt", (
    "SELECT CAST(event_id AS VARCHAR) AS id, " + dy("day") + " AS date, event_type AS text, 1 AS version FROM ev WHERE event_type = 'purchase' OR (event_type = 'click' AND value <= 20) UNION ALL "
    "SELECT CAST(event_id AS VARCHAR), " + dy("day") + ", 'error', 2 FROM ev WHERE event_type = 'error' AND value <= 10 UNION ALL "
    "SELECT id, date, text, 1 FROM nt WHERE id IN (SELECT CAST(event_id AS VARCHAR) FROM ev WHERE event_type IN ('error', 'signup') AND value > 10)")))
def c17_state(spark, sf):
    return out(_changed(spark, sf)[0], "id", "date", "text", "version")


@register("c17_chained_changes", query("ev", (
    "SELECT generation AS id, event_id AS ord, CASE WHEN n = 1 OR event_type <> 'view' THEN 200 ELSE 409 END AS status, CASE WHEN n = 1 THEN 1 WHEN event_type <> 'view' THEN 1 + done END AS new_version FROM "
    "(SELECT *, row_number() OVER w AS n, count(*) FILTER (event_type <> 'view' AND NOT first) OVER w AS done FROM "
    "(SELECT *, event_id = min(event_id) OVER (PARTITION BY generation) AS first FROM ev) WINDOW w AS (PARTITION BY generation ORDER BY event_id ROWS UNBOUNDED PRECEDING))")))
def c17_chained(spark, sf):
    """One note per generation with all its events as updates, each of which expects what the one
    before made; views come with a stale version."""
    e = T.event_places(spark, sf).select("event_id", "generation", "event_type", "ts")
    first = e.groupBy("generation").agg(F.min("event_id").alias("first"))
    most = e.agg(F.max("event_id")).first()[0] + 1
    moved = (F.col("event_type") != "view") & (F.col("event_id") != F.col("first"))
    counted = ordered.running_count(e.join(first, "generation"), moved, "done", ["generation"], "event_id", most=most)
    changes = counted.select(
        F.col("generation").alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") == F.col("first"), "add").otherwise("update").alias("action"),
        F.when(moved, F.col("done")).otherwise(0).cast("int").alias("expected_version"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.lit("*").alias("subject"), F.col("event_type").alias("text"),
    )
    _, audit = annotate.apply_changes(T.notes(spark, sf), changes, T.subjects(spark, sf))
    return out(audit, "id", "ord", "status", "new_version")


@register("h22_note_problem", (
    "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN length(text) > 80 THEN 'length' WHEN regexp_matches(trim(text), '[\\x00-\\x1f\\x7f]') THEN 'control character' ELSE 'ok' END AS problem FROM conversations) GROUP BY 1"))
def h22(spark, sf):
    turns = T.table(spark, sf, "conversations")
    problem = annotate.note_problem(F.lit("2024-01-05"), F.lit("*"), F.col("text"))
    return out(turns.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n")), "problem", "n")


# ---- expressions ------------------------------------------------------------------------

@register("h04_norm_number", (
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN -o_totalprice WHEN 2 THEN round(o_totalprice / 100, 6) WHEN 4 THEN NULL ELSE o_totalprice END + 0.0 AS value FROM orders"))
def h04(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    shape, plain = F.pmod("o_orderkey", F.lit(5)), F.format_number("o_totalprice", 2)
    text = (
        F.when(shape == 0, F.concat(F.lit(" ¥"), plain, F.lit(" 元"))).when(shape == 1, F.concat(F.lit("("), plain, F.lit(")")))
        .when(shape == 2, F.concat(plain, F.lit("%"))).when(shape == 3, F.concat(F.lit("RMB"), plain)).otherwise(F.lit("n/a"))
    )
    return out(o.select("o_orderkey", numbers.norm_number(text).alias("value")), "o_orderkey", "value")


@register("h05_norm_rate", (
    "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS a, round(l_discount, 6) AS b, CASE WHEN l_discount * 100 > 1.5 THEN round(l_discount, 6) ELSE round(l_discount * 100, 6) END AS c FROM lineitem"))
def h05(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    d, none = F.col("l_discount"), F.lit(None).cast("string")
    whole = F.round(d * 100, 6)
    return out(
        li, "l_orderkey", "l_linenumber", numbers.norm_rate(F.concat(F.format_number(d * 100, 4), F.lit("%"))).alias("a"),
        numbers.norm_rate(none, d, F.lit("0.0%")).alias("b"), numbers.norm_rate(none, whole, F.lit("General")).alias("c"),
    )


@register("h06_iso_week", (
    "SELECT DISTINCT " + wk("d") + " AS label, strftime(s, '%Y-%m-%d') AS first_day, strftime(s + 6, '%Y-%m-%d') AS last_day, CASE WHEN year(s) <> year(s + 6) THEN 'year' WHEN s <= make_date(year(s), 6, 30) AND s + 6 > make_date(year(s), 6, 30) THEN 'half' END AS boundary FROM "
    "(SELECT CAST(l_shipdate + INTERVAL 28 YEAR AS DATE) AS d, CAST(date_trunc('week', CAST(l_shipdate + INTERVAL 28 YEAR AS DATE)) AS DATE) AS s FROM lineitem)"))
def h06(spark, sf):
    d = F.add_months(F.col("l_shipdate").cast("date"), 336)
    weeks = T.table(spark, sf, "lineitem").select(periods.week_label(d).alias("label")).distinct()
    w = periods.iso_week(F.col("label"))
    rows = weeks.select(w.alias("w")).select("w.*")
    return out(rows, "label", F.col("start").alias("first_day"), F.col("end").alias("last_day"), "boundary")


@register("h07_day_key", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders")
def h07(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    shape = F.pmod("o_orderkey", F.lit(4))
    text = (
        F.when(shape == 0, F.date_format("d", "yyyy/M/d")).when(shape == 1, F.concat(F.date_format("d", "yyyy"), F.lit("年"), F.date_format("d", "MM"), F.lit("月"), F.date_format("d", "dd"), F.lit("日")))
        .when(shape == 2, F.concat(F.date_format("d", "yyyy.MM.dd"), F.lit(" 00:00:00")))
    )
    serial = F.when(shape == 3, F.datediff("d", F.lit("1899-12-30").cast("date")).cast("double"))
    return out(o.select("o_orderkey", periods.day_key(text, serial).alias("day")), "o_orderkey", "day")


@register("h01_clean_text", "SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(8209), '-'), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) AS cleaned FROM documents")
def h01(spark, sf):
    from ..functions.text import clean_text

    return out(T.table(spark, sf, "documents"), "doc_id", F.md5(clean_text(F.col("text"))).alias("cleaned"))


@register("h13_subject_id", query("subj", "SELECT name, type || '_' || substr(sha1(replace(name, ' ', '')), 1, 10) AS id FROM subj"))
def h13(spark, sf):
    return out(T.subjects(spark, sf), "name", names.subject_id(F.col("name"), F.col("type")).alias("id"))


@register("h19_parse_rank_item", query("fr", f"SELECT generation, label, {r6('rate')} AS rate, {dbl('amount')} AS amount FROM fr"))
def h19(spark, sf):
    ranked = T.fee_rank(T.fee_observations(spark, sf))
    item = names.parse_rank_item(F.col("item_text"))
    return out(ranked.select("generation", item.alias("i")).select("generation", "i.*"), "generation", "label", "rate", "amount")


@register("h20_normalize_band", (
    "SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 THEN '免费' WHEN a < 5000 THEN '0-5000' WHEN a < 10000 THEN '5000-10000' ELSE '10000-以上' END AS band FROM (SELECT *, l_extendedprice * l_discount AS a FROM lineitem)"))
def h20(spark, sf):
    li = T.table(spark, sf, "lineitem")
    a = F.col("l_extendedprice") * F.col("l_discount")
    text = F.when(a == 0, "免费选配").when(a < 5000, "5000元以下").when(a < 10000, "5000~10000元").otherwise("10000 元以上")
    return out(li.select("l_orderkey", "l_linenumber", names.normalize_band(text).alias("band")), "l_orderkey", "l_linenumber", "band")


@register("h21_annotation_key", query("ev", (
    "SELECT event_id, strftime(day, '%Y-%m-%d') AS d, CAST(isoyear(day) AS VARCHAR) || '-WK' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS w, strftime(day, '%Y-%m') AS m FROM ev")))
def h21(spark, sf):
    date = F.date_format("ts", "yyyy-MM-dd")
    return out(T.event_places(spark, sf), "event_id", *[periods.annotation_key(date, g).alias(k) for g, k in (("day", "d"), ("week", "w"), ("month", "m"))])


@register("f01_period_order", query("ob", (
    "SELECT subject, period, row_number() OVER (PARTITION BY subject ORDER BY CAST(substr(period, 1, 2) AS INTEGER), CAST(substr(period, 5) AS INTEGER)) AS position FROM ob WHERE grain = 'week'")))
def f01(spark, sf):
    weeks = overview.overview_base(T.observations(spark, sf, ("week",)))
    key = periods.period_order(F.col("period"))
    w = Window.partitionBy("subject").orderBy(key["summary"], key["natural"])
    return out(weeks.select("subject", "period", F.row_number().over(w).alias("position")), "subject", "period", "position")


@register("h08_strict_numbers", (
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) END AS number, CASE o_orderkey % 4 WHEN 2 THEN round(round(o_totalprice % 100, 2) / 100, 6) END AS rate FROM orders"))
def h08(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    shape, plain = F.pmod("o_orderkey", F.lit(4)), F.format_number("o_totalprice", 2)
    percent = F.concat(F.format_number(F.col("o_totalprice") % 100, 2), F.lit("%"))
    text = F.when(shape == 0, plain).when(shape == 1, F.concat(F.lit("-"), plain)).when(shape == 2, percent).otherwise("n/a")
    rate = F.when(shape != 0, numbers.strict_rate(text))
    return out(o.select("o_orderkey", numbers.strict_number(text).alias("number"), rate.alias("rate")), "o_orderkey", "number", "rate")


@register("h12_sheet_grain_and_phase", (
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'week' ELSE 'month' END AS grain, c_custkey AS phase FROM customer"))
def h12(spark, sf):
    """Grain and phase number (H12, H16) of one sheet name per customer."""
    customer = T.table(spark, sf, "customer").select("c_custkey", "c_name")
    word = F.element_at(F.array(*[F.lit(w) for w in "时天周月"]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    name = F.concat("c_name", F.lit("by"), word, F.lit("第 "), F.col("c_custkey").cast("string"), F.lit(" 期"))
    return out(customer.select("c_custkey", names.grain_from_name(name).alias("grain"), names.phase_number(name).alias("phase")), "c_custkey", "grain", "phase")


@register("h14_model_key_and_stage", query("places", "SELECT generation, lower(replace(replace(brand || generation, ' ', ''), '_', '')) AS model_key, generation || ' pre' AS stage FROM places"))
def h14(spark, sf):
    p = T.places(spark, sf)
    rules = _rules(spark, sf)
    model = names.model_key(F.concat_ws(" ", "brand", "generation", F.lit("总计")), rules)
    stage = names.stage_label(F.concat("brand", F.lit("  "), "generation", F.lit(" pre")), F.col("brand"))
    return out(p.select("generation", model.alias("model_key"), stage.alias("stage")), "generation", "model_key", "stage")


@register("h17_hour_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def h17(spark, sf):
    text = F.date_format("ts", "yyyy年M月d日 H：mm")
    return out(T.table(spark, sf, "events").select("event_id", F.date_format(names.hour_timestamp(text), "yyyy-MM-dd HH:mm").alias("minute")), "event_id", "minute")


@register("a18_manifest_diff", (
    "SELECT CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'added' ELSE 'changed' END AS change FROM orders "
    "WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 5 = 0) AND (o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)"))
def a18(spark, sf):
    """Two lists of files that differ in added, changed and deleted ones."""
    o, key = T.table(spark, sf, "orders"), F.col("o_orderkey")
    files = o.select("o_orderkey", key.cast("string").alias("name"), F.length("o_orderstatus").alias("size"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    now = files.filter(key % 11 != 0)
    before = files.filter(key % 5 != 0).withColumn("size", F.when(key % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return out(reports.diff_manifest(now, before), "name", "change")
