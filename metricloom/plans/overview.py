"""Group, brand and generation overview: four order metrics, shares, rankings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import generation_model_key, generation_year, is_combined_generation
from ..functions.periods import is_summary_period
from ..labels import CHANNEL, DELIVERED, LOCKED, ORDERS, POWER, QTY, RETAINED, RETAINED_OLD, VERSION
from ..operators.compare import change_rank, history_table, previous_detail
from ..operators.coverage import interval_days
from ..operators.ordered import islands, range_text

METRICS = ("orders", "retained", "locked", "delivered")
_KEYS = ["subject", "grain", "period", "period_start"]


def _scalar(metric):
    return F.max(F.when((F.col("metric") == metric) & (F.col("stat") == QTY) & (F.col("category") == QTY), F.col("value")))


def overview_base(obs: DataFrame) -> DataFrame:
    """Periods that both the order and the lock report show, missing metrics as 0.

    The intersection is one grouped aggregate with presence flags, not a join.
    """
    detail = obs.filter(F.col("report").isin("order_mix", "lock_mix")).filter(~is_summary_period(F.col("period")))
    wide = detail.groupBy(*_KEYS).agg(
        F.max(F.col("report") == "order_mix").alias("has_order"),
        F.max(F.col("report") == "lock_mix").alias("has_lock"),
        _scalar(ORDERS).alias("orders"),
        F.coalesce(_scalar(RETAINED), _scalar(RETAINED_OLD)).alias("retained"),
        _scalar(LOCKED).alias("locked"),
        _scalar(DELIVERED).alias("delivered"),
    )
    return wide.filter("has_order and has_lock").select(
        *_KEYS, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS]
    )


def override_from_chart(base: DataFrame, chart: DataFrame) -> DataFrame:
    """Chart totals replace the metric their headline names, only where the chart has the period."""
    head = F.coalesce(F.col("headline"), F.lit(""))
    order = F.col("report") == "order_mix"
    target = (
        F.when(order & (head.contains(RETAINED) | head.contains(RETAINED_OLD)), "retained")
        .when(order & head.contains(ORDERS), "orders")
        .when(~order & head.contains(LOCKED), "locked")
        .when(~order & head.contains(DELIVERED), "delivered")
    )
    totals = chart.filter("series is null and value is not null").withColumn("target", target).filter("target is not null")
    wide = totals.groupBy("subject", "grain", "period").agg(
        *[F.max(F.when(F.col("target") == m, F.col("value"))).alias(f"_{m}") for m in METRICS]
    )
    joined = base.join(wide, ["subject", "grain", "period"], "left")
    return joined.select(*_KEYS, *[F.coalesce(f"_{m}", m).alias(m) for m in METRICS])


def overview_history(base: DataFrame) -> DataFrame:
    return history_table(base, METRICS)


def overview_kpis(base: DataFrame) -> DataFrame:
    labels = dict(zip(METRICS, (ORDERS, RETAINED, LOCKED, DELIVERED)))
    rows = F.array(*[F.struct(F.lit(labels[m]).alias("label"), F.col(m).alias("value")) for m in METRICS])
    return base.select(F.lit("overview").alias("module"), *_KEYS, F.explode(rows).alias("x")).select(
        "module", *_KEYS, "x.label", "x.value"
    )


def _children(subjects: DataFrame) -> DataFrame:
    return subjects.filter(F.col("type").isin("brand", "generation") & ~is_combined_generation(F.col("name"))).select(
        F.col("name").alias("child"), "parent"
    )


def missing_children(subjects: DataFrame, lock: DataFrame) -> DataFrame:
    """Child subjects without any lock report of a grain that a sibling has.

    ``subjects`` lists the child set the parent is made of.
    """
    have = lock.select("grain", F.col("subject").alias("child")).distinct()
    wanted = _children(subjects)
    grains = have.join(wanted, "child").select("parent", "grain").distinct()
    return wanted.join(grains, "parent").join(have, ["grain", "child"], "left_anti").select("parent", "grain", "child")


def lock_share(lock: DataFrame, subjects: DataFrame) -> DataFrame:
    """Share of each child in its parent's lock orders at every period of the parent.

    A period missing in an existing child counts as 0; a parent with a missing child or a
    total of 0 has no result. Result: parent, grain, period, period_start, child, n, share.
    """
    scalar = lock.filter((F.col("metric") == LOCKED) & (F.col("stat") == QTY) & (F.col("category") == QTY))
    values = scalar.select(F.col("subject").alias("child"), "grain", "period", F.coalesce("value", F.lit(0.0)).alias("n"))
    gone = missing_children(subjects, lock).select("parent", "grain").distinct()
    pages = lock.select(F.col("subject").alias("parent"), "grain", "period", "period_start").distinct()
    have = lock.select(F.col("subject").alias("child"), "grain").distinct()
    grid = (
        pages.join(_children(subjects), "parent")
        .join(have, ["child", "grain"], "left_semi")
        .join(gone, ["parent", "grain"], "left_anti")
        .join(values, ["child", "grain", "period"], "left")
        .fillna(0.0, subset=["n"])
    )
    total = F.sum("n").over(Window.partitionBy("parent", "grain", "period"))
    return grid.withColumn("total", total).filter("total > 0").select(
        "parent", "grain", "period", "period_start", "child", "n", (F.col("n") / F.col("total")).alias("share")
    )


def version_share(lock: DataFrame) -> DataFrame:
    """Generations: the version structure of the same period, passed through."""
    return lock.filter(F.col("metric") == VERSION)


def apportion(shares: DataFrame, targets: DataFrame, order: str = "child") -> DataFrame:
    """Whole numbers that add up to the (half-even rounded) target: largest remainder first.

    shares: parent, grain, period, child, share. targets: parent, grain, period, target.
    """
    keys = ["parent", "grain", "period"]
    goal = F.bround("target", 0)
    exact = shares.join(targets.filter("target >= 0"), keys).withColumn("_exact", F.col("share") * goal)
    exact = exact.withColumn("_base", F.floor("_exact").cast("double"))
    page = Window.partitionBy(*keys)
    ranked = exact.withColumn("_left", goal - F.sum("_base").over(page)).withColumn(
        "_rank", F.row_number().over(page.orderBy(F.desc(F.col("_exact") - F.col("_base")), order))
    )
    return ranked.select(
        *keys, "child", "share",
        (F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1.0).otherwise(0.0)).alias("n"),
    )


def channel_lock_bars(structures: DataFrame) -> DataFrame:
    return structures.filter(F.col("metric") == CHANNEL)


def lock_trend(lock: DataFrame, structures: DataFrame) -> DataFrame:
    """Stacked trend without a chart block: power shares at every period, or one 0/1 series."""
    totals = lock.filter(F.col("metric") == LOCKED).groupBy("subject", "grain", "period", "period_start").agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("total")
    )
    power = structures.filter(F.col("metric") == POWER)
    labels = power.select("subject", "grain", F.col("category").alias("series")).distinct()
    shares = power.select("subject", "grain", "period", F.col("category").alias("series"), "share")
    stacked = totals.join(labels, ["subject", "grain"]).join(shares, ["subject", "grain", "period", "series"], "left").select(
        "subject", "grain", "period", "period_start", "series", F.coalesce("share", F.lit(0.0)).alias("value"), "total"
    )
    single = totals.join(labels, ["subject", "grain"], "left_anti").select(
        "subject", "grain", "period", "period_start", F.lit(LOCKED).alias("series"),
        F.when(F.col("total") != 0, 1.0).otherwise(0.0).alias("value"), "total",
    )
    return stacked.unionByName(single)


def latest_model_year(names: DataFrame, name: str = "subject", also=()) -> DataFrame:
    """Newest model year per model (and the columns ``also``); names without a year stay."""
    year, key = generation_year(F.col(name)), generation_model_key(F.col(name))
    tagged = names.withColumn("_year", year).withColumn("_key", key)
    newest = tagged.groupBy("_key", *also).agg(F.max("_year").alias("_newest"))
    return tagged.join(newest, ["_key", *also]).filter("_year = 0 or _year = _newest").select(*names.columns)


def ranking_input(obs: DataFrame, coverage: DataFrame = None) -> DataFrame:
    """Values of a period next to those of the previous detail period of the grain.

    An absent value stays unknown. With ``coverage`` (subject, start, end of its exports; with a column
    ``metric`` only for that metric) a day that an export covers without a row is a true 0, on either side.
    """
    rows = obs.filter(F.col("metric").isin(RETAINED, LOCKED) & (F.col("stat") == QTY) & (F.col("category") == QTY))
    steps = previous_detail(rows, ["grain"]).select("grain", "period", "prev_period").filter("prev_period is not null")
    keys = ["subject", "grain", "metric"]
    values = rows.select(*keys, "period", "value")
    page = [*keys, "period", "prev_period"]
    # A value stands on the page of its period and on that of the next one; a page has one or two rows.
    now = values.join(steps, ["grain", "period"]).select(*page, F.lit("now").alias("side"), "value")
    before = values.withColumnRenamed("period", "prev_period").join(steps, ["grain", "prev_period"]).select(*page, F.lit("before").alias("side"), "value")
    sides = ("now", "before")
    shown = now.unionByName(before).groupBy(*page).agg(
        *[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in sides],
        *[F.count_if(F.col("side") == s).alias(f"_{s}") for s in sides],
    )
    if coverage is None:
        return shown.filter("_now > 0").drop("_now", "_before")
    scope = [c for c in ("subject", "metric") if c in coverage.columns]
    days = interval_days(coverage, scope).withColumn("_covered", F.lit(True))
    # At most one side of a page is absent, so the covered days are met once.
    absent = F.when(F.col("_now") == 0, F.col("period")).when(F.col("_before") == 0, F.col("prev_period"))
    met = shown.withColumn("day", F.when(F.col("grain") == "day", F.try_to_date(absent, "yyyy-MM-dd"))).join(days, [*scope, "day"], "left")
    zero = [F.when((F.col(f"_{s}") == 0) & F.col("_covered"), F.lit(0.0)).otherwise(F.col(s)).alias(s) for s in sides]
    return met.select(*page, *zero)


def rank_candidates(pairs: DataFrame, subjects: DataFrame, obs: DataFrame = None) -> DataFrame:
    """Generations that take part in the rankings of a grain: with ``obs`` those that have an order and a
    lock report in it; of each model the newest year among them."""
    names = subjects.filter("type = 'generation'").select(F.col("name").alias("subject"))
    if obs is None:
        return pairs.join(latest_model_year(names), "subject", "left_semi")
    reports = [F.max(F.col("report") == r) for r in ("order_mix", "lock_mix")]
    both = obs.groupBy("subject", "grain").agg(reports[0].alias("_order"), reports[1].alias("_lock")).filter("_order and _lock")
    candidates = both.join(names, "subject", "left_semi").select("subject", "grain")
    return pairs.join(latest_model_year(candidates, also=["grain"]), ["subject", "grain"], "left_semi")


def change_rankings(pairs: DataFrame, direction: str) -> DataFrame:
    return change_rank(pairs, direction, ["grain", "period", "metric"], "subject")


def lock_share_issues(subjects: DataFrame, lock: DataFrame, structures: DataFrame) -> DataFrame:
    """Withheld share charts: missing children over the whole range, versions per run of periods."""
    pages = lock.select("subject", "grain", "period", "period_start").distinct()
    w = Window.partitionBy("subject", "grain").orderBy("period_start", "period")
    numbered = pages.withColumn("position", F.row_number().over(w).cast("bigint"))
    children = missing_children(subjects, lock)
    hit = numbered.join(children.withColumnRenamed("parent", "subject"), ["subject", "grain"]).select(
        "subject", "grain", F.lit("child").alias("issue"), F.col("child").alias("detail"), "position", "period"
    )
    generations = subjects.filter("type = 'generation'").select(F.col("name").alias("subject"))
    versions = structures.filter(F.col("metric") == VERSION).select("subject", "grain", "period").distinct()
    bare = numbered.join(generations, "subject", "left_semi").join(versions, ["subject", "grain", "period"], "left_anti").select(
        "subject", "grain", F.lit("version").alias("issue"), F.lit("").alias("detail"), "position", "period"
    )
    keys = ["subject", "grain", "issue", "detail"]
    return range_text(islands(hit.unionByName(bare), keys, "position", "period"), keys, joiner="–")

