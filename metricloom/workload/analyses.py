"""Registered queries: the analyses."""

from pyspark.sql import functions as F

from ..labels import LOCKED, RETAINED
from ..operators import compare
from ..operators.lineage import cut_lineage
from ..plans import cancellation, channel, conversion, fee, launch, overview, registry, sku, structures
from . import tables as T
from .registry import out, register
from .sql import dbl, query, r6

_PAGE = ("subject", "grain", "period")


def _change(m, w):
    return (
        f"CASE WHEN lag({m}) OVER {w} <> 0 THEN {r6(f'({m} - lag({m}) OVER {w}) / abs(lag({m}) OVER {w})')} END AS {m}_change"
    )


# ---- overview ---------------------------------------------------------------------------

@register("c01_overview_base", query("ob", "SELECT subject, grain, period, orders, retained, locked, delivered FROM ob"))
def c01(spark, sf):
    return out(overview.overview_base(T.observations(spark, sf)), *_PAGE, "orders", "retained", "locked", "delivered")


_W = "(PARTITION BY subject, grain ORDER BY period_start)"


@register("e01_history", query("ob", "SELECT subject, grain, period, orders, retained, locked, delivered, "
          + ", ".join(_change(m, _W) for m in overview.METRICS) + " FROM ob"))
def e01(spark, sf):
    base = overview.overview_base(T.observations(spark, sf))
    return out(overview.overview_history(base), *_PAGE, *overview.METRICS, *[f"{m}_change" for m in overview.METRICS])


_KPI = ("k AS (SELECT subject, grain, period, period_start, '大定' AS label, orders AS value FROM ob UNION ALL "
        "SELECT subject, grain, period, period_start, '留存大定', retained FROM ob UNION ALL "
        "SELECT subject, grain, period, period_start, '交车锁单', locked FROM ob UNION ALL "
        "SELECT subject, grain, period, period_start, '已交付', delivered FROM ob)")


@register("e02_kpi_comparison", query("ob", (
    "SELECT subject, grain, period, label, value, CASE WHEN p IS NULL THEN 'unavailable' ELSE 'available' END AS status, "
    f"p AS previous, value - p AS delta, CASE WHEN p <> 0 THEN {r6('(value - p) / abs(p)')} END AS rate, "
    "CASE WHEN value > p THEN 'up' WHEN value < p THEN 'down' WHEN value = p THEN 'flat' END AS direction "
    "FROM (SELECT *, lag(value) OVER (PARTITION BY subject, grain, label ORDER BY period_start) AS p FROM k)"), _KPI))
def e02(spark, sf):
    kpis = overview.overview_kpis(overview.overview_base(T.observations(spark, sf)))
    compared = compare.kpi_comparison(kpis)
    return out(compared.select(*_PAGE, "label", "value", "comparison.*"), *_PAGE, "label", "value", "status", "previous", "delta", "rate", "direction")


@register("c02_chart_override", query("ob chart", (
    "SELECT o.subject, o.period, CASE WHEN c.value IS NOT NULL AND o.subject = 'ALL' THEN c.value ELSE orders END AS orders, "
    "CASE WHEN c.value IS NOT NULL AND o.subject <> 'ALL' AND o.subject NOT LIKE 'NATION%' THEN c.value ELSE retained END AS retained, "
    "CASE WHEN c.value IS NOT NULL AND o.subject LIKE 'NATION%' THEN c.value ELSE locked END AS locked, delivered "
    "FROM ob o LEFT JOIN chart c ON c.subject = o.subject AND c.period = o.period WHERE o.grain = 'month'")))
def c02(spark, sf):
    base = overview.overview_base(T.observations(spark, sf, ("month",)))
    return out(overview.override_from_chart(base, T.charts(spark, sf)), "subject", "period", "orders", "retained", "locked", "delivered")


_PAIRS = (
    "m AS (SELECT subject, grain, period, period_start, 'retained' AS metric, retained AS v FROM oc UNION ALL "
    "SELECT subject, grain, period, period_start, 'locked', locked FROM ob), "
    "pp AS (SELECT grain, period, lag(period) OVER (PARTITION BY grain ORDER BY period_start) AS prev FROM (SELECT DISTINCT grain, period, period_start FROM m)), "
    "pr AS (SELECT a.subject, a.grain, a.period, a.metric, a.v AS now, b.v AS before FROM m a JOIN pp USING (grain, period) "
    "LEFT JOIN m b ON b.subject = a.subject AND b.grain = a.grain AND b.metric = a.metric AND b.period = pp.prev "
    "WHERE a.subject LIKE 'NATION%' AND pp.prev IS NOT NULL)"
)


def _rank_sql(sign, test):
    return query("oc ob", (
        f"SELECT grain, period, metric, subject, {r6('rate')} AS rate, rank FROM (SELECT *, row_number() OVER "
        "(PARTITION BY grain, period, metric ORDER BY rate DESC, subject) AS rank FROM "
        f"(SELECT *, {sign} * (now - before) / before AS rate FROM pr WHERE before > 0 AND now {test} before)) WHERE rank <= 10"), _PAIRS)


def _pairs(spark, sf):
    obs = T.observations(spark, sf).filter(F.col("subject").startswith("NATION"))
    pairs = overview.ranking_input(obs)
    name = F.when(F.col("metric") == RETAINED, "retained").otherwise("locked")
    return pairs.withColumn("metric", name)


@register("e08_rise_rank", _rank_sql("1", ">"))
def e08_rise(spark, sf):
    return out(overview.change_rankings(_pairs(spark, sf), "rise"), "grain", "period", "metric", "subject", "rate", "rank")


@register("e08_drop_rank", _rank_sql("-1", "<"))
def e08_drop(spark, sf):
    return out(overview.change_rankings(_pairs(spark, sf), "drop"), "grain", "period", "metric", "subject", "rate", "rank")


@register("e08_covered_drop_rank", query("oc subj", (
    "SELECT period, metric, subject, " + r6("(before - now) / before") + " AS rate, row_number() OVER (PARTITION BY period, metric ORDER BY (before - now) / before DESC, subject) AS rank FROM cz "
    "WHERE before > 0 AND now < before QUALIFY rank <= 10"),
    "dv AS (SELECT subject, CAST(period_start AS DATE) AS day, period, m.metric, m.value FROM oc, LATERAL (VALUES ('留存大定', retained), ('交车锁单', locked)) m(metric, value) "
    "WHERE grain = 'day' AND subject IN (SELECT name FROM subj WHERE type = 'generation') AND (m.metric = '留存大定' OR m.value > 0)), "
    "sp AS (SELECT *, lag(period) OVER (ORDER BY day) AS prev FROM (SELECT DISTINCT day, period FROM dv)), "
    # Exports by month and, overlapping them, by quarter; a report has ranges of its own.
    "cv AS (SELECT subject, metric, min(day) AS a, max(day) AS b FROM dv GROUP BY subject, metric, date_trunc('month', day) UNION ALL "
    "SELECT subject, metric, min(day), max(day) FROM dv GROUP BY subject, metric, date_trunc('quarter', day)), "
    "cd AS (SELECT subject FROM dv GROUP BY 1 HAVING count(DISTINCT metric) = 2), "
    "cz AS (SELECT b.subject, sp.period, b.metric, b.value AS before, coalesce(n.value, 0) AS now FROM dv b JOIN sp ON sp.prev = b.period JOIN cd ON cd.subject = b.subject "
    "LEFT JOIN dv n ON n.subject = b.subject AND n.metric = b.metric AND n.period = sp.period "
    "WHERE n.value IS NOT NULL OR EXISTS (SELECT 1 FROM cv WHERE cv.subject = b.subject AND cv.metric = b.metric AND sp.day BETWEEN cv.a AND cv.b))"))
def e08_covered(spark, sf):
    """Daily drops of generations; a day inside an export of the metric's report without a row is a 0."""
    obs = T.observations(spark, sf, ("day",)).filter(F.col("metric").isin(RETAINED, LOCKED))
    ranges = [
        obs.groupBy("subject", "metric", F.trunc("period_start", unit).alias("export")).agg(F.min("period_start").alias("start"), F.max("period_start").alias("end"))
        for unit in ("month", "quarter")
    ]
    pairs = overview.ranking_input(obs, ranges[0].unionByName(ranges[1]))
    pairs = overview.rank_candidates(pairs, T.subjects(spark, sf), obs)
    return out(overview.change_rankings(pairs, "drop"), "period", "metric", "subject", "rate", "rank")


@register("e08_empty_rise_reason", query("oc ob", (
    "SELECT grain, period, metric, CASE WHEN bool_or(before > 0) THEN 'no riser' ELSE 'no comparable data' END AS reason "
    "FROM pr GROUP BY 1, 2, 3 HAVING NOT bool_or(coalesce(before > 0 AND now > before, false))"), _PAIRS))
def e08_reason(spark, sf):
    return out(compare.empty_rise_reason(_pairs(spark, sf), ["grain", "period", "metric"]), "grain", "period", "metric", "reason")


@register("e09_previous_detail", query("oc", (
    "SELECT subject, grain, period, lag(period) OVER (PARTITION BY subject, grain ORDER BY period_start) AS prev_period FROM oc")))
def e09(spark, sf):
    return out(compare.previous_detail(T.observations(spark, sf)), *_PAGE, "prev_period")


@register("b08_default_period", query("oc", "SELECT subject, grain, arg_max(period, period_start) AS default_period FROM oc GROUP BY 1, 2"))
def b08(spark, sf):
    return out(compare.default_period(T.observations(spark, sf), order="period_start"), "subject", "grain", "default_period")


# The child list also names segment lines that have no lock report of their own.
_WANT = ("kids AS (SELECT brand AS parent, generation AS child FROM places UNION ALL SELECT 'ALL', r_name FROM region), "
         "lk AS (SELECT subject, grain, period, locked FROM ob)")
_SHARES = ("sh AS (SELECT p.subject AS parent, p.grain, p.period, k.child, coalesce(v.locked, 0) AS n FROM lk p JOIN kids k ON k.parent = p.subject "
           "LEFT JOIN lk v ON v.subject = k.child AND v.grain = p.grain AND v.period = p.period), "
           "ss AS (SELECT *, n / sum(n) OVER (PARTITION BY parent, grain, period) AS share, sum(n) OVER (PARTITION BY parent, grain, period) AS total FROM sh)")


def _lock(spark, sf, grains=("day", "week", "month")):
    return T.observations(spark, sf, grains).filter("report = 'lock_mix'")


@register("d05_lock_share", query("ob", f"SELECT parent, grain, period, child, n, {r6('share')} AS share FROM ss WHERE total > 0", _WANT + ", " + _SHARES))
def d05(spark, sf):
    shares = overview.lock_share(_lock(spark, sf), T.subjects(spark, sf))
    return out(shares, "parent", "grain", "period", "child", "n", "share")


@register("d06_apportion", query("ob", (
    "SELECT parent, grain, period, child, CAST(base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END AS DOUBLE) AS n FROM (SELECT *, "
    "target - sum(base) OVER (PARTITION BY parent, grain, period) AS left_over, row_number() OVER (PARTITION BY parent, grain, period ORDER BY ex - base DESC, child) AS rk "
    "FROM (SELECT s.*, o.delivered AS target, share * o.delivered AS ex, floor(share * o.delivered) AS base FROM ss s JOIN ob o "
    "ON o.subject = s.parent AND o.grain = s.grain AND o.period = s.period WHERE total > 0 AND s.parent = 'ALL'))"), _WANT + ", " + _SHARES))
def d06(spark, sf):
    obs = T.observations(spark, sf)
    shares = overview.lock_share(obs.filter("report = 'lock_mix'"), T.subjects(spark, sf)).filter(F.col("parent") == T.GROUP)
    target = obs.filter((F.col("metric") == "已交付") & (F.col("subject") == T.GROUP)).select(
        F.col("subject").alias("parent"), "grain", "period", F.col("value").alias("target")
    )
    return out(overview.apportion(shares, target), "parent", "grain", "period", "child", "n")


def _wide_subjects(spark, sf):
    """Subjects plus one line per brand and market segment (segments have no lock report)."""
    base = T.subjects(spark, sf)
    segment = T.table(spark, sf, "customer").join(T.places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(" ", "brand", "c_mktsegment").alias("name"), F.lit("generation").alias("type"), F.col("brand").alias("parent")
    ).distinct()
    return base.unionByName(segment.withColumn("id", F.col("name")))


@register("c15_missing_children", query("places", (
    "SELECT DISTINCT brand AS parent, g.grain, brand || ' ' || c_mktsegment AS child FROM customer JOIN places ON c_nationkey = n_nationkey, "
    "(VALUES ('day'), ('week'), ('month')) g(grain)")))
def c15(spark, sf):
    return out(overview.missing_children(_wide_subjects(spark, sf), _lock(spark, sf)), "parent", "grain", "child")


@register("i03_lock_share_issues", query("ob", (
    "SELECT p.subject, p.grain, 'child' AS issue, k.child AS detail, p.first || '–' || p.last AS ranges FROM (SELECT subject, grain, "
    "arg_min(period, period_start) AS first, arg_max(period, period_start) AS last FROM ob WHERE grain = 'month' GROUP BY 1, 2) p JOIN "
    "(SELECT DISTINCT brand AS parent, brand || ' ' || c_mktsegment AS child FROM customer JOIN places ON c_nationkey = n_nationkey) k ON k.parent = p.subject "
    "UNION ALL SELECT subject, grain, 'version', '', arg_min(period, period_start) || '–' || arg_max(period, period_start) FROM ob "
    "WHERE grain = 'month' AND subject LIKE 'NATION%' GROUP BY 1, 2")))
def i03(spark, sf):
    st = structures.structures(T.mix_observations(spark, sf))
    issues = overview.lock_share_issues(_wide_subjects(spark, sf), _lock(spark, sf, ("month",)), st)
    return out(issues, "subject", "grain", "issue", "detail", "ranges")


@register("d37_lock_trend", query("ob mx", (
    f"SELECT o.subject, o.period, l.category AS series, {r6('coalesce(m.share, 0)')} AS value, o.locked AS total FROM ob o JOIN "
    "(SELECT DISTINCT subject, category FROM mx WHERE metric = '动力') l USING (subject) LEFT JOIN mx m ON m.subject = o.subject AND m.period = o.period "
    "AND m.metric = '动力' AND m.category = l.category WHERE o.grain = 'month' UNION ALL "
    "SELECT subject, period, '交车锁单', CASE WHEN locked <> 0 THEN 1.0 ELSE 0.0 END, locked FROM ob WHERE grain = 'month' AND subject LIKE 'NATION%'")))
def d37(spark, sf):
    st = structures.structures(T.mix_observations(spark, sf))
    return out(overview.lock_trend(_lock(spark, sf, ("month",)), st), "subject", "period", "series", "value", "total")


@register("k_overview", query("ob", (
    "SELECT subject, grain, period, label, value, CASE WHEN p <> 0 THEN " + r6("(value - p) / abs(p)") + " END AS rate FROM "
    "(SELECT *, lag(value) OVER (PARTITION BY subject, grain, label ORDER BY period_start) AS p FROM k)"), _KPI))
def k_overview(spark, sf):
    base = overview.overview_base(T.observations(spark, sf))
    compared = compare.kpi_comparison(overview.overview_kpis(base))
    return out(compared.select(*_PAGE, "label", "value", "comparison.rate"), *_PAGE, "label", "value", "rate")


# ---- configuration mix ------------------------------------------------------------------

def _structures(spark, sf):
    return structures.structures(T.mix_observations(spark, sf))


@register("c03_structures", query("mx", f"SELECT subject, period, metric, category, {r6('share')} AS share, n FROM mx"))
def c03(spark, sf):
    return out(_structures(spark, sf), "subject", "period", "metric", "category", "share", "n")


@register("e04_structure_change", query("mxc", (
    f"SELECT subject, period, metric, category, {r6('share')} AS share, {r6('previous')} AS previous, {r6('change')} AS change FROM mxc")))
def e04(spark, sf):
    return out(compare.structure_change(_structures(spark, sf)), "subject", "period", "metric", "category", "share", "previous", "change")


@register("e06_structure_rank", query("mx", (
    "SELECT subject, period, metric, category, row_number() OVER (PARTITION BY subject, period, metric ORDER BY "
    "CASE WHEN metric = '电池包' THEN CAST(regexp_extract(category, '(\\d+)', 1) AS DOUBLE) ELSE -share END, ord) AS rank FROM mx") .replace("CAST(regexp_extract(category, '(\\d+)', 1) AS DOUBLE)", "TRY_CAST(regexp_extract(category, '(\\d+)', 1) AS DOUBLE)")))
def e06(spark, sf):
    return out(compare.structure_rank(_structures(spark, sf)), "subject", "period", "metric", "category", "rank")


@register("d20_dimension_leaders", query("mx", (
    f"SELECT subject, period, metric, category, {r6('share')} AS share FROM (SELECT *, row_number() OVER (PARTITION BY subject, period, metric ORDER BY share DESC, ord) AS rn FROM mx) WHERE rn = 1")))
def d20(spark, sf):
    return out(structures.dimension_leaders(_structures(spark, sf)), "subject", "period", "metric", "category", "share")


@register("d19_mix_kpis", query("mxc", (
    "SELECT subject, period, count(*) AS dimensions, CAST(sum(options) AS BIGINT) AS options, " + r6("max(top)") + " AS leading_share, "
    "count(*) FILTER (top >= 0.5) AS focused, " + r6("max(moved)") + " AS max_change FROM (SELECT subject, period, metric, max(share) AS top, count(*) AS options, "
    "max(abs(change)) AS moved FROM mxc GROUP BY 1, 2, 3) GROUP BY 1, 2")))
def d19(spark, sf):
    return out(structures.mix_kpis(compare.structure_change(_structures(spark, sf))), "subject", "period", "dimensions", "options", "leading_share", "focused", "max_change")


@register("f04_change_top", query("mxc", (
    "SELECT subject, period, position, " + r6("abs(change)") + " AS moved FROM (SELECT *, row_number() OVER (PARTITION BY subject, period ORDER BY abs(change) DESC, ord) AS position FROM mxc) WHERE position <= 18")))
def f04(spark, sf):
    top = compare.change_top(compare.structure_change(_structures(spark, sf)))
    return out(top.withColumn("moved", F.abs("change")), "subject", "period", "position", "moved")


@register("e05_battery_history", query("mx", (
    "SELECT subject, period, category, degree, " + r6("share") + " AS share, CASE WHEN p <> 0 THEN " + r6("(share - p) / abs(p)") + " END AS change FROM "
    "(SELECT *, lag(share) OVER (PARTITION BY subject, category ORDER BY ps) AS p FROM (SELECT d.subject, d.period, d.ps, l.category, "
    "CAST(regexp_extract(l.category, '(\\d+)', 1) AS BIGINT) AS degree, coalesce(m.share, 0) AS share FROM (SELECT DISTINCT subject, period, ps FROM mx) d JOIN "
    "(SELECT DISTINCT subject, category FROM mx WHERE metric = '电池包') l USING (subject) LEFT JOIN mx m ON m.subject = d.subject AND m.period = d.period "
    "AND m.metric = '电池包' AND m.category = l.category))")))
def e05(spark, sf):
    return out(compare.battery_history(_structures(spark, sf)), "subject", "period", "category", "degree", "share", "change")


@register("d39_normalise_parts", query("mx", (
    "SELECT subject, period, metric, category, " + r6("n / sum(n) OVER w") + " AS part, sum(n) OVER w AS total_count FROM mx WHERE n > 0 "
    "WINDOW w AS (PARTITION BY subject, period, metric)")))
def d39(spark, sf):
    parts = structures.normalise_parts(_structures(spark, sf).withColumn("value", F.col("n")), ["subject", "period", "metric"])
    return out(parts, "subject", "period", "metric", "category", "part", "total_count")


@register("k_mix", query("mxc", (
    "SELECT subject, period, metric, category, " + r6("share") + " AS share, " + r6("change") + " AS change, n, row_number() OVER (PARTITION BY subject, period, metric ORDER BY "
    "CASE WHEN metric = '电池包' THEN TRY_CAST(regexp_extract(category, '(\\d+)', 1) AS DOUBLE) ELSE -share END, ord) AS rank FROM mxc")))
def k_mix(spark, sf):
    ranked = compare.structure_rank(compare.structure_change(_structures(spark, sf)))
    return out(ranked, "subject", "period", "metric", "category", "share", "change", "n", "rank")


# ---- channels ---------------------------------------------------------------------------

def _stores(spark, sf):
    counts, overrides = T.store_tables(spark, sf)
    return channel.effective_store_counts(T.subjects(spark, sf), counts, overrides, T.GROUP)


def _ratios(spark, sf):
    return channel.channel_ratios(channel.channel_values(T.channel_observations(spark, sf)), _stores(spark, sf))


@register("c06_effective_stores", query("st", "SELECT subject, channel, stores FROM st"))
def c06(spark, sf):
    return out(_stores(spark, sf), "subject", "channel", "stores")


@register("b11_channel_universe", query("ch2", "SELECT DISTINCT subject, channel, length(channel) * 100 + ascii(channel) AS ord FROM ch2"))
def b11(spark, sf):
    return out(channel.channel_universe(T.channel_observations(spark, sf)), "subject", "channel", "ord")


@register("g14_active_store_priority", query("ch2", (
    "SELECT subject, period, channel, active, layout FROM (SELECT subject, strftime(ps, '%y-%m') AS period, channel, active, CASE WHEN ps < DATE '1998-01-01' THEN 1 ELSE 2 END AS layout FROM ch2)")))
def g14(spark, sf):
    from ..operators.merge import active_store_priority

    rows = active_store_priority(T.channel_observations(spark, sf))
    return out(rows.select("subject", "period", F.col("category").alias("channel"), F.col("value").alias("active"), "layout"), "subject", "period", "channel", "active", "layout")


_CH = ("n", "share", "active_rate", "productivity")


@register("d03_channel_ratios", query("chr", (
    f"SELECT subject, period, channel, n, {r6('share')} AS share, active, stores, bad AS inconsistent, {r6('active_rate')} AS active_rate, {r6('productivity')} AS productivity FROM chr")))
def d03(spark, sf):
    return out(_ratios(spark, sf), "subject", "period", "channel", "n", "share", "active", "stores", "inconsistent", "active_rate", "productivity")


@register("e03_channel_change", query("chr", "SELECT subject, period, channel, " + ", ".join(
    r6(f"{c} - lag({c}) OVER (PARTITION BY subject, channel ORDER BY ps)") + f" AS {c}_change" for c in _CH) + " FROM chr"))
def e03(spark, sf):
    return out(channel.channel_change(_ratios(spark, sf)), "subject", "period", "channel", *[f"{c}_change" for c in _CH])


_TOT = ("SELECT subject, period, n, active, stores, CASE WHEN NOT wrong AND stores > 0 THEN " + r6("active / stores") + " END AS active_rate, "
        "CASE WHEN stores > 0 THEN " + r6("n / stores") + " END AS productivity FROM cht")


@register("d02_channel_totals", query("cht", _TOT))
def d02(spark, sf):
    return out(channel.channel_totals(_ratios(spark, sf), _stores(spark, sf)), "subject", "period", "n", "active", "stores", "active_rate", "productivity")


@register("d04_channel_kpis", query("cht", (
    "SELECT subject, period, label, value FROM (SELECT subject, period, 'channel_orders' AS label, n AS value FROM t UNION ALL SELECT subject, period, 'active_stores', active FROM t "
    "UNION ALL SELECT subject, period, 'active_rate', " + r6("active_rate * 100") + " FROM t UNION ALL SELECT subject, period, 'productivity', productivity FROM t)"),
    "t AS (SELECT subject, period, n, active, CASE WHEN NOT wrong AND stores > 0 THEN active / stores END AS active_rate, CASE WHEN stores > 0 THEN " + r6("n / stores") + " END AS productivity FROM cht)"))
def d04(spark, sf):
    kpis = channel.channel_kpis(channel.channel_totals(_ratios(spark, sf), _stores(spark, sf)))
    return out(kpis, "subject", "period", "label", "value")


@register("b09_visible_channels", query("chr", "SELECT subject, period, channel, stores FROM chr WHERE stores IS DISTINCT FROM 0"))
def b09(spark, sf):
    return out(channel.visible_channels(_ratios(spark, sf)), "subject", "period", "channel", "stores")


@register("b10_history_until", query("ob", "SELECT subject, grain, period, orders FROM ob WHERE period_start <= DATE '1998-06-01'"))
def b10(spark, sf):
    base = overview.overview_base(T.observations(spark, sf))
    return out(channel.history_until(base, F.lit("1998-06-01").cast("date")), *_PAGE, "orders")


@register("d36_store_inconsistencies", query("chr", (
    "SELECT subject, channel, count(*) AS cells, min(period) AS first_period, max(period) AS last_period FROM chr WHERE bad GROUP BY 1, 2")))
def d36(spark, sf):
    ratios = _ratios(spark, sf)
    report = channel.store_inconsistencies(ratios)
    span = ratios.filter("inconsistent").groupBy("subject", "channel").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    return out(report.join(span, ["subject", "channel"]), "subject", "channel", "cells", "first_period", "last_period")


@register("k_channel", query("chr", (
    "SELECT subject, period, channel, n, active, " + r6("productivity") + " AS productivity, "
    + r6("productivity - lag(productivity) OVER (PARTITION BY subject, channel ORDER BY ps)") + " AS productivity_change FROM chr")))
def k_channel(spark, sf):
    rows, _ = channel.channel_panel(T.channel_observations(spark, sf), _stores(spark, sf))
    return out(rows, "subject", "period", "channel", "n", "active", "productivity", "productivity_change")


# ---- conversion -------------------------------------------------------------------------

def _stage_sql(i):
    before = max(i - 1, 1)
    names = ("大定", "留存大定", "销售锁单", "交车锁单", "已发运", "已到店", "已交付")
    loss = f"CASE WHEN s{i} IS NOT NULL THEN 0.0 END" if i == 1 else f"CASE WHEN s{before} - s{i} > 0 THEN s{before} - s{i} WHEN s{before} - s{i} <= 0 THEN 0.0 END"
    return (
        f"SELECT subject, grain, period, {i} AS stage_no, '{names[i - 1]}' AS stage, s{i} AS value, {r6(f's{i} / CASE WHEN s1 > 0 THEN s1 END')} AS total_rate, "
        f"{r6(f's{i} / CASE WHEN s{before} > 0 THEN s{before} END')} AS stage_rate, {loss} AS loss FROM co"
    )


_STAGES = " UNION ALL ".join(_stage_sql(i) for i in range(1, 8))


@register("e07_stage_rates", query("co", _STAGES))
def e07(spark, sf):
    return out(conversion.stage_rates(T.cohorts(spark, sf)), *_PAGE, "stage_no", "stage", "value", "total_rate", "stage_rate", "loss")


@register("d17_funnel", query("co", (
    f"SELECT c.subject, c.grain, c.period, {r6('s7 / CASE WHEN s1 > 0 THEN s1 END')} AS total_rate, s1 AS orders, s7 AS delivered, "
    "CASE WHEN m.known = 6 THEN m.best END AS largest_loss, CASE WHEN m.known = 6 AND m.best > 0 THEN m.stage END AS largest_loss_stage FROM co c JOIN "
    "(SELECT subject, grain, period, count(loss) AS known, max(loss) AS best, arg_max(stage, loss * 100 - stage_no) AS stage FROM sr WHERE stage_no > 1 GROUP BY 1, 2, 3) m "
    "USING (subject, grain, period)"), f"sr AS ({_STAGES})"))
def d17(spark, sf):
    return out(conversion.funnel(T.cohorts(spark, sf)), *_PAGE, "total_rate", "orders", "delivered", "largest_loss", "largest_loss_stage")


@register("d17_loss_bars", query("co", (
    f"SELECT s.subject, s.grain, s.period, s.stage, s.loss, {r6('s.loss / c.s1')} AS share FROM sr s JOIN co c USING (subject, grain, period) WHERE s.stage_no > 1 AND s.loss > 0 AND c.s1 > 0"), f"sr AS ({_STAGES})"))
def d17_bars(spark, sf):
    return out(conversion.loss_bars(T.cohorts(spark, sf)), *_PAGE, "stage", "loss", "share")


@register("d18_cohort_matrix", query("co", "SELECT subject, grain, period, " + ", ".join(
    r6(f"s{i} / CASE WHEN s1 > 0 THEN s1 END") + f" AS rate_s{i}" for i in range(2, 8)) + f", {r6('days1')} AS order_to_lock_days, {r6('days2')} AS lock_to_delivery_days FROM co"))
def d18(spark, sf):
    return out(conversion.cohort_matrix(T.cohorts(spark, sf)), *_PAGE, *[f"rate_s{i}" for i in range(2, 8)], "order_to_lock_days", "lock_to_delivery_days")


# ---- small orders and cancellation ------------------------------------------------------

def _campaign_days(spark, sf):
    return cancellation.assign_campaign(T.retreat_days(spark, sf), T.campaigns(spark, sf))


@register("c05_assign_campaign", query("cday", "SELECT subject, strftime(day, '%Y-%m-%d') AS day, campaign FROM cday"))
def c05(spark, sf):
    return out(_campaign_days(spark, sf), "subject", "day", "campaign")


@register("d08_hourly_to_day", query("rhd", "SELECT subject, strftime(day, '%Y-%m-%d') AS day, orders, cancel FROM rhd"))
def d08(spark, sf):
    return out(cancellation.hourly_to_day(T.retreat_hourly(spark, sf)), "subject", "day", "orders", "cancel")


def _rhythm(spark, sf):
    days = _campaign_days(spark, sf)
    hourly = cancellation.hourly_to_day(T.retreat_hourly(spark, sf, "2024-01-15"))
    rhythm = cancellation.small_order_rhythm(days.select("subject", "day", "orders"), hourly, T.retreat_days(spark, sf).select("subject", "day", "cancel"))
    return rhythm.join(days.select("subject", "day", "campaign"), ["subject", "day"])


@register("c04_small_order_rhythm", query("rhy", "SELECT subject, strftime(day, '%Y-%m-%d') AS day, orders, cancel FROM rhy"))
def c04(spark, sf):
    return out(_rhythm(spark, sf), "subject", "day", "orders", "cancel")


@register("d09_rhythm_rates", query("rhyr", (
    f"SELECT subject, strftime(day, '%Y-%m-%d') AS day, retained, {r6('coalesce(retained / nullif(orders, 0), 0)')} AS retention_rate, {r6('coalesce(cancel / nullif(orders, 0), 0)')} AS cancel_rate FROM rhyr")))
def d09(spark, sf):
    return out(cancellation.rhythm_rates(_rhythm(spark, sf)), "subject", "day", "retained", "retention_rate", "cancel_rate")


_CT = "SELECT subject, campaign, count(*) AS days, sum(orders) AS orders, sum(retained) AS retained, sum(cancel) AS cancel FROM rhyr GROUP BY 1, 2"


@register("d10_campaign_totals", query("rhyr", f"SELECT *, {r6('coalesce(retained / nullif(orders, 0), 0)')} AS retention_rate FROM ({_CT})"))
def d10(spark, sf):
    totals = cancellation.campaign_totals(cancellation.rhythm_rates(_rhythm(spark, sf)))
    return out(totals, "subject", "campaign", "days", "orders", "retained", "cancel", "retention_rate")


@register("d10_combined_totals", query("rhyr", (
    f"SELECT subject, count(*) AS campaigns, sum(orders) AS orders, sum(retained) AS retained, sum(cancel) AS cancel, {r6('coalesce(sum(retained) / nullif(sum(orders), 0), 0)')} AS retention_rate FROM ({_CT}) GROUP BY 1")))
def d10_all(spark, sf):
    totals = cancellation.campaign_totals(cancellation.rhythm_rates(_rhythm(spark, sf)))
    return out(cancellation.combined_totals(totals), "subject", "campaigns", "orders", "retained", "cancel", "retention_rate")


@register("d11_hour_profile", query("rh", (
    "SELECT s.subject, CAST(h.hour AS BIGINT) AS hour, coalesce(sum(r.orders), 0) AS orders, coalesce(sum(r.cancel), 0) AS cancel, "
    "greatest(coalesce(sum(r.orders), 0) - coalesce(sum(r.cancel), 0), 0) AS kept FROM (SELECT DISTINCT subject FROM rh) s, range(24) h(hour) "
    "LEFT JOIN rh r ON r.subject = s.subject AND r.hour = h.hour GROUP BY 1, 2")))
def d11(spark, sf):
    profile = cancellation.hour_profile(T.retreat_hourly(spark, sf), ["orders", "cancel"])
    return out(cancellation.kept_orders(profile), "subject", "hour", "orders", "cancel", "kept")


@register("d16_daily_cancel", query("rd", (
    "SELECT subject, strftime(day, '%Y-%m-%d') AS date, cancel AS small, big_cancel AS big, cancel + big_cancel AS total, "
    f"{r6('sum(cancel) OVER w / CASE WHEN sum(orders) OVER w > 0 THEN sum(orders) OVER w END')} AS small_rate FROM rd "
    "WINDOW w AS (PARTITION BY subject ORDER BY day)")))
def d16(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    daily = T.retreat_days(spark, sf).select(
        "subject", F.col("day").alias("date"), F.col("cancel").alias("small_cancel"), "big_cancel",
        F.lit(None).cast("double").alias("convert_rate"),
        F.when(F.sum("orders").over(w) > 0, F.sum("cancel").over(w) / F.sum("orders").over(w)).alias("small_rate"),
        F.lit(None).cast("double").alias("big_rate"),
    )
    return out(cancellation.daily_cancel(daily), "subject", "date", "small", "big", "total", "small_rate")


@register("f03_retreat_top", query("ro", (
    f"SELECT subject, label, {r6('share')} AS share, cancel, position FROM (SELECT subject, dimension || ' · ' || label AS label, cancel / orders AS share, cancel, "
    "row_number() OVER (PARTITION BY subject ORDER BY cancel / orders DESC, dimension || '|' || label) AS position FROM ro) WHERE position <= 15")))
def f03(spark, sf):
    return out(cancellation.retreat_top(T.retreat_options(spark, sf)), "subject", "label", "share", "cancel", "position")


# ---- launch -----------------------------------------------------------------------------

def _steps(spark, sf):
    return launch.launch_steps(T.launch_observations(spark, sf))


@register("d13_direct_share", query("ls", (
    "SELECT subject, campaign, step AS step_ord, " + r6("vdirect / CASE WHEN orders > 0 THEN orders END") + " AS day_share, "
    + r6("cd / CASE WHEN gross > 0 THEN gross END") + " AS cum_share FROM ls")))
def d13(spark, sf):
    return out(launch.direct_share(_steps(spark, sf)), "subject", "campaign", "step_ord", "day_share", "cum_share")


@register("d14_launch_sources", query("ls", (
    "SELECT subject, campaign, step AS step_ord, small, coalesce(vdirect, orders - small) AS direct, small + coalesce(vdirect, orders - small) AS total FROM ls")))
def d14(spark, sf):
    return out(launch.launch_sources(_steps(spark, sf)), "subject", "campaign", "step_ord", "small", "direct", "total")


@register("d12_launch_cumulative", query("lph", f"SELECT subject, campaign, orders, {r6('coalesce(retained, 0)')} AS retained FROM lph"))
def d12(spark, sf):
    return out(launch.launch_cumulative(_steps(spark, sf)), "subject", "campaign", "orders", "retained")


@register("e10_last_known", query("ls", (
    "SELECT subject, campaign, arg_max(coalesce(cs, 0), step) AS value FROM ls GROUP BY 1, 2")))
def e10(spark, sf):
    names = ("累计小订转大定数量", "累计小订转大数量")
    return out(compare.last_known(T.launch_observations(spark, sf), names, ["subject", "campaign"]), "subject", "campaign", "value")


@register("e16_phase_gaps", query("lph", (
    "SELECT subject, campaign, row_number() OVER w AS phase_no, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, steps, "
    "greatest(start_date - lag(end_date) OVER w - 1, CASE WHEN lag(end_date) OVER w IS NOT NULL THEN 0 END) AS gap_days, lead(phase) OVER w IS NULL AS is_default FROM lph "
    "WINDOW w AS (PARTITION BY subject ORDER BY start_date, phase)")))
def e16(spark, sf):
    gaps = launch.phase_gaps(launch.phase_summary(_steps(spark, sf)))
    return out(gaps, "subject", "campaign", "phase_no", "start_date", "end_date", "steps", "gap_days", "is_default")


@register("d15_launch_combined", query("lph", (
    "SELECT subject, count(*) AS phases, sum(orders) AS orders, CASE WHEN count(locked) = count(*) THEN sum(locked) END AS locked, "
    + r6("coalesce(sum(small) FILTER (srate > 0 AND small / srate > 0) / nullif(sum(small / srate) FILTER (srate > 0 AND small / srate > 0), 0), 0)") + " AS small_rate, "
    "CASE WHEN count(num) = count(*) AND count(den) = count(*) THEN " + r6("sum(num) / CASE WHEN sum(den) > 0 THEN sum(den) END") + " END AS direct_share FROM lph GROUP BY 1")))
def d15(spark, sf):
    return out(launch.launch_combined(launch.phase_summary(_steps(spark, sf))), "subject", "phases", "orders", "locked", "small_rate", "direct_share")


@register("d38_metric_matrix", query("ls", (
    "SELECT subject, campaign, step AS step_ord, metric, " + r6("value") + " AS value FROM (SELECT ls.*, x.* FROM ls, LATERAL (VALUES ('当日大定数量', orders), ('当日净大定数量', orders - lock / 10), "
    "('当日小订转大定数量', small), ('当日直接大定数量', vdirect), ('累计直接大定数量', cd), ('累计小订转大定数量', cs), ('累计大定数量', co), "
    "('累计小订转化率', srate), ('累计交车锁单数量', vlock), ('每日直接大定占比', vdirect / CASE WHEN orders > 0 THEN orders END), "
    "('累计直接大定占比', cd / CASE WHEN gross > 0 THEN gross END)) x(metric, value))")))
def d38(spark, sf):
    obs = T.launch_observations(spark, sf)
    return out(launch.metric_matrix(obs, launch.launch_steps(obs)), "subject", "campaign", "step_ord", "metric", "value")


@register("c08_pair_hourly", query("camp", "SELECT subject, campaign, phase, campaign || ' 时' AS hourly_sheet FROM camp"))
def c08(spark, sf):
    c = T.campaigns(spark, sf)
    phases = c.select("subject", "campaign", "phase", F.concat("campaign", F.lit(" 天")).alias("sheet"))
    hourly = c.select("subject", "campaign", "phase", F.concat("campaign", F.lit(" 时")).alias("sheet"), F.col("phase").alias("ord"))
    return out(launch.pair_hourly(phases, hourly), "subject", "campaign", "phase", "hourly_sheet")


@register("d11_launch_hour_profile", query("ev", (
    "SELECT s.subject, CAST(h.hour AS BIGINT) AS hour, CAST(count(e.ts) AS DOUBLE) AS orders FROM (SELECT DISTINCT brand AS subject FROM ev WHERE event_type = 'purchase') s, range(24) h(hour) "
    "LEFT JOIN ev e ON e.brand = s.subject AND hour(e.ts) = h.hour AND e.event_type = 'purchase' GROUP BY 1, 2")))
def d11_launch(spark, sf):
    rows = launch.hourly_profile_input(T.launch_hourly(spark, sf))
    return out(cancellation.hour_profile(rows, ["orders"]), "subject", "hour", "orders")


# ---- SKU --------------------------------------------------------------------------------

def _sku(spark, sf):
    share = cut_lineage(T.sku_shares(spark, sf))
    # Nine places, so that a cumulative share of exactly 80 % is 80 % whatever the summing order.
    return share, sku.cumulative_topk(share).withColumn("share", F.round("share", 9))


@register("d40_topk_matrix", query("tk", (
    "SELECT g.subject, g.period, g.rank, " + r6("t.cum") + " AS share FROM (SELECT * FROM (SELECT DISTINCT subject, period FROM tk) JOIN (SELECT DISTINCT subject, rank FROM tk) USING (subject)) g "
    "LEFT JOIN tk t ON t.subject = g.subject AND t.period = g.period AND t.rank = g.rank")))
def d40(spark, sf):
    return out(sku.topk_matrix(_sku(spark, sf)[1]), "subject", "period", "rank", "share")


#: A share as the whole number of its 10^12ths: at six places some shares are exact ties, which the
#: two engines round to different sides.
_EXACT = "CAST(round(share * 1000000000000) AS BIGINT)"


def _exact_share(df):
    return df.withColumn("share", F.round(F.col("share") * 1000000000000).cast("bigint"))


# A code counts as known at a period only when it has a share there.
_AL = "al AS (SELECT g.*, s.share FROM (SELECT * FROM (SELECT DISTINCT subject, period FROM sk) JOIN (SELECT DISTINCT subject, code FROM sk) USING (subject)) g LEFT JOIN sk s USING (subject, period, code))"


@register("c09_align_sku", query("sk", f"SELECT subject, period, code, {_EXACT} AS share, share IS NOT NULL AS in_block FROM al", _AL))
def c09(spark, sf):
    aligned = sku.align_sku(*_sku(spark, sf))
    return _exact_share(aligned.select("subject", "period", "code", "share", "in_block"))


@register("d21_active_sku", query("sk", "SELECT subject, period, CASE WHEN count(share) = count(*) THEN count(*) FILTER (share > 0) END AS active FROM al GROUP BY 1, 2", _AL))
def d21(spark, sf):
    return out(sku.complete_counts(*_sku(spark, sf)), "subject", "period", "active")


def _dense_sku(spark, sf):
    """SKU shares with the unsold combinations as true zeros, so that pages are complete."""
    share, topk = _sku(spark, sf)
    full = sku.align_sku(share, topk).select("subject", "period", "code", "ord", F.coalesce("share", F.lit(0.0)).alias("share"))
    return full, topk


@register("d22_long_tail", query("sk", "SELECT subject, period, count(*) FILTER (share > 0 AND share <= 0.05) AS tail FROM sk GROUP BY 1, 2"))
def d22(spark, sf):
    full, topk = _dense_sku(spark, sf)
    return out(sku.long_tail(sku.align_sku(full, topk)), "subject", "period", "tail")


_T35 = ("SELECT subject, period, max(cum) FILTER (rank = 3) AS top3, CASE WHEN count(*) FILTER (rank = 5) > 0 THEN max(cum) FILTER (rank = 5) ELSE max(cum) FILTER (rank = 3) END AS top5, "
        "min(rank) FILTER (cum >= 0.8) AS needed FROM tk GROUP BY 1, 2")


@register("d23_topk_share", query("tk", f"SELECT subject, period, {r6('top3')} AS top3, {r6('top5')} AS top5 FROM ({_T35})"))
def d23(spark, sf):
    return out(sku.topk_share(_sku(spark, sf)[1]), "subject", "period", "top3", "top5")


@register("d24_coverage_80", query("tk", f"SELECT subject, period, CAST(needed AS BIGINT) AS needed FROM ({_T35})"))
def d24(spark, sf):
    return out(sku.coverage_rank(_sku(spark, sf)[1]), "subject", "period", "needed")


@register("e14_sku_rank", query("sk", (
    f"SELECT subject, period, code, {_EXACT} AS share, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject, period ORDER BY coalesce(share, 0) DESC, code) AS rank FROM al) WHERE share IS NOT NULL"), _AL))
def e14(spark, sf):
    ranked = sku.sku_rank(sku.align_sku(*_sku(spark, sf)))
    return _exact_share(ranked.select("subject", "period", "code", "share", F.col("rank").cast("bigint").alias("rank")))


@register("e15_sku_comparison", query("sk tk", (
    "SELECT subject, period, label, " + r6("value") + " AS value, CASE WHEN value IS NULL OR p IS NULL THEN 'unavailable' ELSE 'available' END AS status, " + r6("value - p") + " AS delta FROM "
    "(SELECT *, lag(value) OVER (PARTITION BY subject, label ORDER BY ps) AS p FROM (SELECT t.subject, t.period, w.ps, x.label, x.value FROM "
    f"({_T35}) t JOIN (SELECT subject, period, CASE WHEN count(share) = count(*) THEN CAST(count(*) FILTER (share > 0) AS DOUBLE) END AS active FROM al GROUP BY 1, 2) a USING (subject, period) JOIN (SELECT DISTINCT subject, period, ps FROM sk) w USING (subject, period), "
    "LATERAL (VALUES ('active', a.active), ('top3', t.top3), ('top5', t.top5), ('needed', CAST(t.needed AS DOUBLE))) x(label, value)))"), _AL))
def e15(spark, sf):
    compared = sku.sku_comparison(sku.sku_kpis(*_sku(spark, sf)))
    return out(compared.select("subject", "period", "label", "value", "comparison.status", "comparison.delta"), "subject", "period", "label", "value", "status", "delta")


@register("g13_period_union", query("sk ob", "SELECT period FROM sk UNION SELECT period FROM ob WHERE grain = 'week'"))
def g13(spark, sf):
    from ..operators.merge import period_union

    share = T.sku_shares(spark, sf).select("period")
    weeks = overview.overview_base(T.observations(spark, sf, ("week",))).select("period")
    return out(period_union(share, weeks), "period")


# ---- option amounts ---------------------------------------------------------------------

def _fee(spark, sf):
    return T.fee_table(T.fee_observations(spark, sf))


def _band_totals(spark, sf):
    return fee.fee_band_totals(fee.fee_orders(_fee(spark, sf)))


_BT = ("bo AS (SELECT brand, band, row_number() OVER (PARTITION BY brand ORDER BY CASE band WHEN '免费' THEN 0 WHEN '0-5000' THEN 1 WHEN '5000-10000' THEN 2 ELSE 99 END) AS position FROM (SELECT DISTINCT brand, band FROM fb)), "
       "bt AS (SELECT g.brand, g.generation, o.band, o.position, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT brand, generation FROM fb) g JOIN bo o USING (brand) "
       "LEFT JOIN (SELECT generation, band, sum(n) AS n FROM fb GROUP BY 1, 2) s ON s.generation = g.generation AND s.band = o.band)")


@register("f06_band_order", query("fb", "SELECT brand, band, position FROM bo", _BT))
def f06(spark, sf):
    return out(fee.band_order(fee.fee_orders(_fee(spark, sf))), "brand", "band", "position")


@register("d25_fee_band_totals", query("fb", "SELECT brand, generation, band, position, n FROM bt", _BT))
def d25(spark, sf):
    return out(_band_totals(spark, sf), "brand", "generation", "band", "position", "n")


@register("d26_fee_band_share", query("fb", f"SELECT generation, band, {r6('coalesce(n / nullif(sum(n) OVER (PARTITION BY generation), 0), 0)')} AS share FROM bt", _BT))
def d26(spark, sf):
    return out(fee.fee_band_share(_band_totals(spark, sf)), "generation", "band", "share")


@register("d26_fee_month_share", query("fb", f"SELECT generation, period, band, {r6('n / sum(n) OVER (PARTITION BY generation, period)')} AS share FROM fb"))
def d26_month(spark, sf):
    return out(fee.fee_band_share(fee.fee_orders(_fee(spark, sf)), ("generation", "period")), "generation", "period", "band", "share")


@register("d27_paid_share", query("fb", "SELECT brand, round_even(sum(n) FILTER (band <> '免费') / sum(n) * 100, 0) AS paid_percent FROM bt GROUP BY 1", _BT))
def d27(spark, sf):
    return out(fee.paid_share(_band_totals(spark, sf)), "brand", "paid_percent")


@register("d28_brand_avg_option", query("fc", (
    "SELECT brand, round_even(avg(v), 0) AS avg_option FROM (SELECT brand, generation, flag, sum(amt) / count(*) AS v FROM fc GROUP BY 1, 2, 3) GROUP BY 1")))
def d28(spark, sf):
    return out(fee.brand_avg_option(_fee(spark, sf)), "brand", "avg_option")


@register("d29_weighted_penetration", query("fc", (
    f"SELECT generation, period, p_type AS label, {r6('count(*) / sum(count(*)) OVER (PARTITION BY generation, period)')} AS rate FROM fc GROUP BY 1, 2, 3")))
def d29(spark, sf):
    return out(fee.weighted_penetration(_fee(spark, sf)), "generation", "period", "label", "rate")


_PAID = ("paid AS (SELECT x.generation, x.period, x.label, x.k / t.n AS rate FROM (SELECT generation, period, p_type AS label, CAST(count(*) AS DOUBLE) AS k FROM fc WHERE band <> '免费' GROUP BY 1, 2, 3) x "
         "JOIN (SELECT generation, period, count(*) AS n FROM fc GROUP BY 1, 2) t USING (generation, period))")


@register("d29_weighted_paid", query("fc", f"SELECT generation, period, label, {r6('rate')} AS rate FROM paid", _PAID))
def d29_paid(spark, sf):
    return out(fee.weighted_penetration(_fee(spark, sf), "paid"), "generation", "period", "label", "rate")


@register("d30_fee_month_totals", query("fc", "SELECT generation, period, round(sum(amt), 6) AS option_sum, round(sum(act), 6) AS actual_sum, count(*) AS orders FROM fc GROUP BY 1, 2"))
def d30(spark, sf):
    """Averages compared as sums: times the number of orders they stand for."""
    cube = T.fee_observations(spark, sf)
    orders = cube.groupBy("generation", "period").agg(F.sum("n").cast("bigint").alias("orders"))
    totals = fee.fee_month_totals(T.fee_table(cube)).join(orders, ["generation", "period"])
    sums = [F.round(F.col(f"{c}_total") * F.col("orders"), 6).alias(f"{c}_sum") for c in ("option", "actual")]
    return out(totals.select("generation", "period", *sums, "orders"), "generation", "period", "option_sum", "actual_sum", "orders")


@register("d31_version_amounts", query("fc", (
    f"SELECT generation, period, flag AS label, round(sum(amt), 6) AS option_sum, round(sum(act), 6) AS actual_sum, count(*) AS orders, "
    f"{r6('coalesce((sum(amt) / count(*) - sum(act) / count(*)) / nullif(sum(amt) / count(*), 0), 0)')} AS deduction FROM fc GROUP BY 1, 2, 3")))
def d31(spark, sf):
    cube = T.fee_observations(spark, sf)
    orders = cube.groupBy("generation", "period", F.col("l_returnflag").alias("label")).agg(F.sum("n").cast("bigint").alias("orders"))
    rows = fee.version_amounts(T.fee_table(cube)).join(orders, ["generation", "period", "label"])
    sums = [F.round(F.col(f"{c}_amount") * F.col("orders"), 6).alias(f"{c}_sum") for c in ("option", "actual")]
    return out(rows.select("generation", "period", "label", *sums, "orders", "deduction"), "generation", "period", "label", "option_sum", "actual_sum", "orders", "deduction")


@register("f08_rank_cards", query("fr", f"SELECT brand, generation, rank, label, {r6('rate')} AS rate, {dbl('amount')} AS amount FROM fr"))
def f08(spark, sf):
    return out(fee.rank_cards(T.fee_rank(T.fee_observations(spark, sf))), "brand", "generation", "rank", "label", "rate", "amount")


@register("f08_covered_generations", query("fr", "SELECT brand, count(DISTINCT generation) AS generations FROM fr GROUP BY 1"))
def f08_count(spark, sf):
    return out(fee.covered_generations(fee.rank_cards(T.fee_rank(T.fee_observations(spark, sf)))), "brand", "generations")


@register("d32_top_penetration", query("fr", "SELECT brand, round_even(max(rate) * 100, 0) AS percent FROM fr WHERE rank = 1 GROUP BY 1"))
def d32(spark, sf):
    cards = fee.rank_cards(T.fee_rank(T.fee_observations(spark, sf))).withColumn("ord", F.col("rank"))
    return out(fee.top_penetration(cards), "brand", "percent")


@register("d32_top_paid", query("fc", (
    f"SELECT generation, period, label, {r6('rate')} AS rate FROM (SELECT p.*, row_number() OVER (PARTITION BY p.generation ORDER BY p.rate DESC, p.label) AS rn FROM paid p JOIN "
    "(SELECT generation, arg_max(period, m) AS period FROM fc WHERE band <> '免费' GROUP BY 1) l ON l.generation = p.generation AND l.period = p.period) WHERE rn = 1"), _PAID))
def d32_paid(spark, sf):
    return out(fee.top_paid(fee.weighted_penetration(_fee(spark, sf), "paid")), "generation", "period", "label", "rate")


@register("i05_fee_free_only", query("fb", (
    "SELECT generation, sum(n) FILTER (band = '免费') AS free_orders FROM fb GROUP BY 1 HAVING coalesce(sum(n) FILTER (band = '免费'), 0) > 0 AND coalesce(sum(n) FILTER (band <> '免费'), 0) = 0")))
def i05(spark, sf):
    return out(fee.fee_free_only(_band_totals(spark, sf)), "generation", "free_orders")


@register("i05_fee_free_only_months", query("fb", (
    "SELECT generation, period, sum(n) FILTER (band = '免费') AS free_orders FROM fb GROUP BY 1, 2 HAVING coalesce(sum(n) FILTER (band = '免费'), 0) > 0 AND coalesce(sum(n) FILTER (band <> '免费'), 0) = 0")))
def i05_months(spark, sf):
    monthly = fee.fee_orders(_fee(spark, sf)).withColumn("generation", F.concat_ws("|", "generation", "period"))
    found = fee.fee_free_only(monthly).withColumn("_s", F.split("generation", r"\|"))
    return out(found.select(F.col("_s")[0].alias("generation"), F.col("_s")[1].alias("period"), "free_orders"), "generation", "period", "free_orders")


@register("d33_rights", query("fc", f"SELECT generation, round(sum(amt) / count(*), 2) AS amount, generation || ' rights' AS content FROM fc GROUP BY 1"))
def d33(spark, sf):
    cube = T.fee_observations(spark, sf).groupBy("generation").agg(F.sum("option").alias("o"), F.sum("n").alias("n"))
    text = F.concat(F.lit("¥"), F.format_number(F.col("o") / F.col("n"), 2), F.lit("元"))
    sheet = cube.select("generation", F.lit("权益金额").alias("label"), text.alias("value_text"), F.concat("generation", F.lit(" rights")).alias("content"))
    return out(fee.rights(sheet), "generation", "amount", "content")


@register("f07_fee_column_order", query("fc", (
    "SELECT generation, period, band, row_number() OVER (PARTITION BY generation ORDER BY period = '总计', m, band = '总计', pos) AS position FROM ("
    "SELECT DISTINCT generation, period, m, band, CASE band WHEN '免费' THEN 1 WHEN '0-5000' THEN 2 WHEN '5000-10000' THEN 3 ELSE 4 END AS pos FROM fc "
    "UNION ALL SELECT DISTINCT generation, period, m, '总计', 9 FROM fc UNION ALL SELECT DISTINCT generation, '总计', CAST(NULL AS DATE), '总计', 9 FROM fc)")))
def f07(spark, sf):
    return out(fee.fee_column_order(_fee(spark, sf)), "generation", "period", "band", "position")




# ---- key figures of whole analyses ------------------------------------------------------

def _figure_rows(source, module, subject, grain, period, values):
    return " UNION ALL ".join(
        f"SELECT '{module}' AS module, {subject} AS subject, {grain} AS grain, {period} AS period, '{label}' AS label, {r6(expr)} AS value FROM {source}"
        for label, expr in values.items()
    )


@register("k_conversion", query("co", _figure_rows("fn", "conversion", "subject", "grain", "period", {
    "total_rate": "s7 / CASE WHEN s1 > 0 THEN s1 END * 100", "orders": "s1", "delivered": "s7",
    "largest_loss": "CASE WHEN s3 IS NOT NULL THEN greatest(s1 - s2, s2 - s3, s3 - s4, s4 - s5, s5 - s6, s6 - s7, 0) END"}), "fn AS (SELECT * FROM co)"))
def k_conversion(spark, sf):
    return out(registry.conversion_figures(T.cohorts(spark, sf)), *registry.COLUMNS)


@register("k_cancellation", query("rhyr", _figure_rows("ca", "cancellation", "subject", "'day'", "period", {
    "orders": "orders", "retained": "retained", "cancel": "cancel", "retention": "coalesce(retained / nullif(orders, 0), 0) * 100"}),
    f"ca AS (SELECT subject, campaign AS period, orders, retained, cancel FROM ({_CT}) UNION ALL SELECT subject, 'all', sum(orders), sum(retained), sum(cancel) FROM ({_CT}) GROUP BY 1)"))
def k_cancellation(spark, sf):
    return out(registry.cancellation_figures(_rhythm(spark, sf)), *registry.COLUMNS)


@register("k_launch", query("lph", _figure_rows("la", "launch_rhythm", "subject", "'day'", "'all'", {
    "orders": "orders", "locked": "locked", "small_rate": "small_rate * 100", "direct_share": "direct_share * 100"}),
    "la AS (SELECT subject, sum(orders) AS orders, CASE WHEN count(locked) = count(*) THEN sum(locked) END AS locked, "
    "coalesce(sum(small) FILTER (srate > 0 AND small / srate > 0) / nullif(sum(small / srate) FILTER (srate > 0 AND small / srate > 0), 0), 0) AS small_rate, "
    "CASE WHEN count(num) = count(*) AND count(den) = count(*) THEN sum(num) / CASE WHEN sum(den) > 0 THEN sum(den) END END AS direct_share FROM lph GROUP BY 1)"))
def k_launch(spark, sf):
    return out(registry.launch_figures(T.launch_observations(spark, sf)), *registry.COLUMNS)


@register("k_option_fee_brand", query("fb fr", _figure_rows("fg", "option_fee", "brand", "'month'", "'all'", {
    "generations": "generations", "avg_option": "avg_option", "paid_percent": "paid", "top_percent": "top"}),
    "fg AS (SELECT * FROM (SELECT brand, count(DISTINCT generation) AS generations, round_even(max(rate) FILTER (rank = 1) * 100, 0) AS top FROM fr GROUP BY 1) "
    "JOIN (SELECT brand, round_even(avg(v), 0) AS avg_option FROM (SELECT brand, generation, flag, sum(amt) / count(*) AS v FROM fc GROUP BY 1, 2, 3) GROUP BY 1) USING (brand) "
    "JOIN (SELECT brand, round_even(sum(n) FILTER (band <> '免费') / sum(n) * 100, 0) AS paid FROM fb GROUP BY 1) USING (brand))"))
def k_fee_brand(spark, sf):
    cube = T.fee_observations(spark, sf)
    ranks = T.fee_rank(cube).withColumn("ord", F.col("rank"))
    return out(registry.fee_brand_figures(T.fee_table(cube), ranks), *registry.COLUMNS)


@register("k_option_fee_generation", query("fc", _figure_rows("gg", "option_fee", "generation", "'month'", "period", {
    "option_total": "option_total", "actual_total": "actual_total", "best_paid": "best"}),
    _PAID + ", gg AS (SELECT l.generation, l.period, best, option_total, actual_total FROM (SELECT generation, arg_max(period, m) AS period FROM fc WHERE band <> '免费' GROUP BY 1) l "
    "JOIN (SELECT generation, period, round_even(max(rate) * 100, 0) AS best FROM paid GROUP BY 1, 2) b USING (generation, period) "
    "JOIN (SELECT generation, period, round_even(sum(amt) / count(*), 0) AS option_total, round_even(sum(act) / count(*), 0) AS actual_total FROM fc GROUP BY 1, 2) t USING (generation, period))"))
def k_fee_generation(spark, sf):
    return out(registry.fee_generation_figures(_fee(spark, sf)), *registry.COLUMNS)


@register("k_sku", query("sk tk", _figure_rows("sf", "sku", "subject", "'week'", "period", {
    "active": "active", "top3": "top3 * 100", "top5": "top5 * 100", "needed": "needed"}),
    _AL + f", sf AS (SELECT * FROM ({_T35}) JOIN (SELECT subject, period, CASE WHEN count(share) = count(*) THEN count(*) FILTER (share > 0) END AS active FROM al GROUP BY 1, 2) USING (subject, period))"))
def k_sku(spark, sf):
    return out(registry.sku_figures(*_sku(spark, sf)), *registry.COLUMNS)


@register("k_order_mix", query("mxc", _figure_rows("mk", "order_mix", "subject", "'month'", "period", {
    "dimensions": "dimensions", "options": "options", "leading_share": "top * 100", "focused": "focused", "max_change": "moved * 100"}),
    "mk AS (SELECT subject, period, count(*) AS dimensions, sum(options) AS options, max(top) AS top, count(*) FILTER (top >= 0.5) AS focused, max(moved) AS moved FROM "
    "(SELECT subject, period, metric, max(share) AS top, count(*) AS options, max(abs(change)) AS moved FROM mxc GROUP BY 1, 2, 3) GROUP BY 1, 2)"))
def k_order_mix(spark, sf):
    return out(registry.mix_figures(T.mix_observations(spark, sf)), *registry.COLUMNS)


@register("k_mix_modules", query("lp", _figure_rows("mk", "' || report || '", "subject", "'month'", "period", {
    "dimensions": "dimensions", "options": "options", "leading_share": "top * 100", "focused": "focused", "max_change": "moved * 100"}), (
    "mr AS (SELECT report, subject, ps, metric, category, CAST(count(*) AS DOUBLE) AS n FROM (SELECT r.report, s.subject, b.ps, d.metric, d.category FROM ("
    "SELECT brand, CAST(date_trunc('month', sday) AS DATE) AS ps, p_type, p_brand, p_size, l_linestatus, l_returnflag FROM lp JOIN part ON l_partkey = p_partkey) b, "
    "LATERAL (SELECT 'order_mix' AS report UNION ALL SELECT 'lock_mix' WHERE b.l_linestatus = 'F' UNION ALL SELECT 'small_order_mix' WHERE b.l_returnflag = 'R') r, "
    "LATERAL (SELECT 'ALL' AS subject UNION ALL SELECT b.brand) s, "
    "LATERAL (SELECT '动力' AS metric, b.p_type AS category UNION ALL SELECT '版本', b.p_brand UNION ALL SELECT '电池包', CAST(b.p_size AS VARCHAR) || 'kWh') d) GROUP BY ALL), "
    "ms AS (SELECT *, n / sum(n) OVER (PARTITION BY report, subject, ps, metric) AS share FROM mr), "
    "mb AS (SELECT report, subject, ps, lag(ps) OVER (PARTITION BY report, subject ORDER BY ps) AS prev FROM (SELECT DISTINCT report, subject, ps FROM ms)), "
    "mc AS (SELECT m.*, abs(m.share - coalesce(p.share, m.share)) AS moved FROM ms m JOIN mb USING (report, subject, ps) LEFT JOIN ms p "
    "ON p.report = m.report AND p.subject = m.subject AND p.ps = mb.prev AND p.metric = m.metric AND p.category = m.category), "
    "mk AS (SELECT report, subject, strftime(ps, '%y-%m') AS period, count(*) AS dimensions, sum(options) AS options, max(top) AS top, count(*) FILTER (top >= 0.5) AS focused, max(moved) AS moved FROM "
    "(SELECT report, subject, ps, metric, max(share) AS top, count(*) AS options, max(moved) AS moved FROM mc GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)")))
def k_mix_modules(spark, sf):
    """All lines are orders, shipped ones the locked, returned ones the small orders."""
    reports = F.array_compact(F.array(
        F.lit("order_mix"), F.when(F.col("l_linestatus") == "F", "lock_mix"), F.when(F.col("l_returnflag") == "R", "small_order_mix")
    ))
    return out(registry.mix_figures(T.mix_observations(spark, sf, reports)), *registry.COLUMNS)
