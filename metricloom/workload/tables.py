"""The given tables as the input tables of the analyses.

Every builder reads whole tables and aggregates to (subject, day) or coarser before
anything else happens, so what follows works on calendar-sized data.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import label_for, start_for
from ..labels import (
    ACTIVE_STORES_OLD, BATTERY, CHANNEL, DELIVERED, LAUNCH_CUM_DIRECT, LAUNCH_CUM_LOCK, LOCKED, ORDERS, POWER, QTY,
    RETAINED, SHARE, STORES, VERSION,
)
from ..operators.lineage import cut_lineage
from ..operators.ordered import union_all

GROUP = "ALL"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def places(spark, folder) -> DataFrame:
    """nation key -> brand (region name) and generation (nation name)."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("brand"), F.col("n_name").alias("generation")
    )


def subjects(spark, folder) -> DataFrame:
    """Group, brands and generations with ids."""
    p = places(spark, folder)
    rows = union_all([
        p.select(F.lit(GROUP).alias("name"), F.lit("group").alias("type"), F.lit(None).cast("string").alias("parent")),
        p.select(F.col("brand").alias("name"), F.lit("brand").alias("type"), F.lit(GROUP).alias("parent")),
        p.select(F.col("generation").alias("name"), F.lit("generation").alias("type"), F.col("brand").alias("parent")),
    ]).distinct()
    return rows.select(F.concat("type", F.lit("_"), F.substring(F.sha1("name"), 1, 10)).alias("id"), "name", "type", "parent")


def order_days(spark, folder) -> DataFrame:
    """Daily order counts per brand and generation."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day")
    )
    finished = table(spark, folder, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey").distinct()
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(finished, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    status = F.col("o_orderstatus")
    days = joined.groupBy("c_nationkey", "day").agg(
        F.count(F.lit(1)).cast("double").alias("orders"),
        F.count_if(status.isin("F", "O")).cast("double").alias("retained"),
        F.count_if(status == "F").cast("double").alias("locked"),
        F.count_if((status == "F") & F.col("l_orderkey").isNotNull()).cast("double").alias("delivered"),
    )
    return days.join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def by_level(df: DataFrame) -> DataFrame:
    """Each row for its group, its brand and its generation."""
    level = F.explode(F.array(F.lit(GROUP), F.col("brand"), F.col("generation"))).alias("subject")
    return df.select("*", level).drop("brand", "generation")


def by_grain(df: DataFrame, grains=("day", "week", "month"), day: str = "day") -> DataFrame:
    """Each row once per grain, with the first day of its period; labels are added after the
    aggregation by ``with_label``, on far fewer rows."""
    rows = [F.struct(F.lit(g).alias("grain"), start_for(F.col(day), g).alias("period_start")) for g in grains]
    return df.select("*", F.explode(F.array(*rows)).alias("_g")).select(*df.columns, "_g.*")


def with_label(df: DataFrame) -> DataFrame:
    start = F.col("period_start")
    label = F.when(F.col("grain") == "day", label_for(start, "day")).when(
        F.col("grain") == "week", label_for(start, "week")
    ).otherwise(label_for(start, "month"))
    return df.withColumn("period", label)


def order_counts(spark, folder, grains=("day", "week", "month")) -> DataFrame:
    """The four order figures per subject, grain and period."""
    names = ("orders", "retained", "locked", "delivered")
    days = by_level(order_days(spark, folder)).groupBy("subject", "day").agg(*[F.sum(n).alias(n) for n in names])
    rows = by_grain(days, grains).groupBy("subject", "grain", "period_start").agg(*[F.sum(n).alias(n) for n in names])
    return with_label(rows)


def observations(spark, folder, grains=("day", "week", "month")) -> DataFrame:
    """Long observations; the lock report only has periods with locked orders."""
    wide = order_counts(spark, folder, grains)
    spec = (("order_mix", ORDERS, "orders"), ("order_mix", RETAINED, "retained"), ("lock_mix", LOCKED, "locked"), ("lock_mix", DELIVERED, "delivered"))
    rows = [
        F.struct(F.lit(r).alias("report"), F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(i).alias("row_ord"))
        for i, (r, m, c) in enumerate(spec)
    ]
    long = wide.select("subject", "grain", "period", "period_start", "locked", F.explode(F.array(*rows)).alias("x"))
    return long.filter("x.report = 'order_mix' or locked > 0").select(
        "x.report", "subject", "grain", "period", "period_start", "x.metric",
        F.lit(QTY).alias("stat"), F.lit(QTY).alias("category"), "x.value", "x.row_ord",
    )


def charts(spark, folder) -> DataFrame:
    """Monthly chart totals: ordering customers, shown where fewer than orders."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    month = F.trunc("day", "month")
    per_customer = orders.groupBy("o_custkey", month.alias("period_start")).agg(F.count(F.lit(1)).alias("n"))
    placed = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")
    )
    # A customer has one nation, so distinct customers add up over the levels.
    totals = by_level(
        placed.groupBy("brand", "generation", "period_start").agg(F.count(F.lit(1)).alias("buyers"), F.sum("n").alias("n"))
    ).groupBy("subject", "period_start").agg(F.sum("buyers").cast("double").alias("value"), F.sum("n").alias("n")).filter("value < n")
    kind = F.when(F.col("subject") == GROUP, ORDERS).when(F.col("subject").startswith("NATION"), LOCKED).otherwise("净大定")
    return totals.select(
        F.when(kind == LOCKED, "lock_mix").otherwise("order_mix").alias("report"), "subject", F.lit("month").alias("grain"),
        F.date_format("period_start", "yy-MM").alias("period"), F.concat("subject", F.lit(" "), kind).alias("headline"),
        F.lit(None).cast("string").alias("series"), "value",
    )


def line_places(spark, folder) -> DataFrame:
    """Line items with the supplier's place."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, folder, "lineitem")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        places(spark, folder), F.col("s_nationkey") == F.col("n_nationkey")
    )


def part_counts(spark, folder, reports=None) -> DataFrame:
    """Lines per brand, month and configuration value; three dimensions from one pass. ``reports``: names
    of the reports that a line counts in, as an array; a further key where given."""
    split = [] if reports is None else ["report"]
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    told = [] if reports is None else [F.explode(reports).alias("report")]
    lines = line_places(spark, folder).select("l_partkey", "brand", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("period_start"), *told)
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    dims = F.array(
        F.struct(F.lit(POWER).alias("metric"), F.col("p_type").alias("category"), F.lit(100).alias("base")),
        F.struct(F.lit(VERSION).alias("metric"), F.col("p_brand").alias("category"), F.lit(200).alias("base")),
        F.struct(F.lit(BATTERY).alias("metric"), F.concat(F.col("p_size").cast("string"), F.lit("kWh")).alias("category"), F.lit(300).alias("base")),
    )
    counted = joined.select("brand", *split, "period_start", F.explode(dims).alias("x")).groupBy(
        "brand", *split, "period_start", "x.metric", "x.category", "x.base"
    ).agg(F.count(F.lit(1)).cast("double").alias("n"))
    level = F.explode(F.array(F.lit(GROUP), F.col("brand"))).alias("subject")
    return counted.select(level, *split, "period_start", "metric", "category", "base", "n").groupBy(
        "subject", *split, "period_start", "metric", "category", "base"
    ).agg(F.sum("n").alias("n"))


def mix_observations(spark, folder, reports=None) -> DataFrame:
    """Share and count rows of the configuration dimensions, of the order report or of those named."""
    counts = part_counts(spark, folder, reports)
    counts = counts.withColumn("report", F.lit("order_mix")) if reports is None else counts
    total = F.sum("n").over(Window.partitionBy("report", "subject", "period_start", "metric"))
    # Labels are ordered by the number in them, then by name.
    rows = F.array(
        F.struct(F.lit(SHARE).alias("stat"), (F.col("n") / total).alias("value")),
        F.struct(F.lit(QTY).alias("stat"), F.col("n").alias("value")),
    )
    ord_ = (F.col("base") + F.coalesce(F.regexp_extract("category", r"(\d+)", 1).try_cast("int"), F.length("category"))) * 256 + F.ascii("category")
    return counts.select("report", "subject", "period_start", "metric", "category", ord_.alias("row_ord"), rows.alias("r")).select(
        "report", "subject", F.lit("month").alias("grain"),
        F.date_format("period_start", "yy-MM").alias("period"), "period_start", "metric", "category", "row_ord", F.explode("r").alias("x"),
    ).select("report", "subject", "grain", "period", "period_start", "metric", "x.stat", "category", "x.value", "row_ord")


def channel_observations(spark, folder) -> DataFrame:
    """Orders, share and active customers per market segment and month."""
    orders = table(spark, folder, "orders").select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period_start"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    per_customer = orders.groupBy("o_custkey", "period_start").agg(F.count(F.lit(1)).alias("n"))
    joined = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    nation = joined.groupBy("c_nationkey", "c_mktsegment", "period_start").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("active")
    ).join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = by_level(nation.select("brand", "generation", "c_mktsegment", "period_start", "n", "active")).groupBy(
        "subject", "c_mktsegment", "period_start"
    ).agg(F.sum("n").cast("double").alias("n"), F.sum("active").cast("double").alias("active"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("subject", "period_start"))
    # Half of the history still uses the old active-store row.
    old = F.col("period_start") < F.lit("1998-01-01").cast("date")
    rows = F.array(
        F.struct(F.lit(CHANNEL).alias("metric"), F.lit(QTY).alias("stat"), F.col("n").alias("value")),
        F.struct(F.lit(CHANNEL).alias("metric"), F.lit(SHARE).alias("stat"), share.alias("value")),
        F.struct(F.when(old, ACTIVE_STORES_OLD).otherwise(CHANNEL).alias("metric"), F.when(old, QTY).otherwise(STORES).alias("stat"), F.col("active").alias("value")),
    )
    # Short names first, then alphabetically: any fixed order serves as source order.
    ord_ = F.length("c_mktsegment") * 100 + F.ascii("c_mktsegment")
    return levels.select("subject", "period_start", "c_mktsegment", ord_.alias("row_ord"), rows.alias("r")).select(
        F.lit("order_mix").alias("report"), "subject", F.lit("month").alias("grain"),
        F.date_format("period_start", "yy-MM").alias("period"), "period_start",
        F.col("c_mktsegment").alias("category"), "row_ord", F.explode("r").alias("x"),
    ).select(
        "report", "subject", "grain", "period", "period_start", "x.metric", "x.stat", "category", "x.value",
        "row_ord", F.lit(0).alias("source_order"),
    )


def store_tables(spark, folder):
    """(brand store counts, subject overrides): customers per segment as stores.

    A generation overrides a channel with its customers in credit.
    """
    customer = cut_lineage(table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("rich")
    ).join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")))
    counts = customer.groupBy("brand", F.col("c_mktsegment").alias("channel")).agg(F.sum("n").cast("double").alias("n"))
    overrides = customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("generation").alias("subject"), F.col("c_mktsegment").alias("channel"), F.col("rich").cast("double").alias("n")
    )
    return counts, overrides


def cohorts(spark, folder) -> DataFrame:
    """Weekly and monthly order cohorts with seven nested stages."""
    flags = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(F.col("l_linestatus") == "F").alias("any_f"),
        F.max(F.col("l_returnflag") != "R").alias("any_kept"),
        F.max(F.col("l_returnflag") == "N").alias("any_n"),
        F.min(F.col("l_shipdate").cast("date")).alias("first_ship"),
        F.max(F.col("l_shipdate").cast("date")).alias("last_ship"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    s2 = F.col("o_orderstatus").isin("F", "O")
    s3 = s2 & (F.col("lines") > 0)
    s4 = s3 & F.col("any_f")
    s5 = s4 & F.col("any_kept")
    s6 = s5 & F.col("any_n")
    s7 = s6 & (F.col("o_orderstatus") == "F")
    stages = [F.lit(True), s2, s3, s4, s5, s6, s7]
    daily = joined.groupBy("c_nationkey", "day").agg(
        *[F.count_if(c).alias(f"s{i}") for i, c in enumerate(stages, 1)],
        F.sum(F.abs(F.datediff("first_ship", "day"))).alias("wait"), F.count("first_ship").alias("shipped"),
        F.sum(F.datediff("last_ship", "first_ship")).alias("spread"),
    ).join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")
    rows = with_label(by_grain(by_level(daily), ("week", "month")).groupBy("subject", "grain", "period_start").agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(1, 8)], *[F.sum(c).alias(c) for c in ("wait", "shipped", "spread")]
    ))
    return rows.select(
        "subject", "grain", "period",
        *[F.col(f"s{i}").cast("double").alias(f"s{i}") for i in range(1, 8)],
        F.try_divide("wait", "shipped").alias("order_to_lock_days"), F.try_divide("spread", "shipped").alias("lock_to_delivery_days"),
    )


def event_places(spark, folder) -> DataFrame:
    """Events with the user's place."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.join(places(spark, folder), F.pmod("user_id", F.lit(25)) == F.col("n_nationkey"))


def retreat_hourly(spark, folder, until: str = None) -> DataFrame:
    """Orders and cancels per brand, day and hour; ``until`` ends the export with a day, so that
    later days fall back on the daily rows."""
    e = event_places(spark, folder).groupBy(
        F.col("brand").alias("subject"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")
    ).agg(
        F.count_if(F.col("event_type") == "purchase").cast("double").alias("orders"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("cancel"),
    )
    known = e.filter("orders > 0 or cancel > 0")
    return known if until is None else known.filter(F.col("date") <= F.lit(until).cast("date"))


def retreat_days(spark, folder) -> DataFrame:
    """Daily cancels and small orders (sign-ups) per brand."""
    e = event_places(spark, folder)
    kind = F.col("event_type")
    return e.groupBy(F.col("brand").alias("subject"), F.to_date("ts").alias("day")).agg(
        F.count_if(kind == "signup").cast("double").alias("orders"),
        F.count_if(kind == "error").cast("double").alias("cancel"),
        F.count_if(kind == "click").cast("double").alias("big_cancel"),
    )


def campaigns(spark, folder) -> DataFrame:
    """Three order windows per brand; the first two share January 10."""
    windows = F.array(*[
        F.struct(F.lit(n).alias("campaign"), F.lit(i).alias("phase"), F.lit(a).cast("date").alias("small_start"), F.lit(b).cast("date").alias("small_end"))
        for i, (n, a, b) in enumerate((("spring", "2024-01-03", "2024-01-10"), ("summer", "2024-01-10", "2024-01-17"), ("autumn", "2024-01-20", "2024-01-26")), 1)
    ])
    brands = table(spark, folder, "region").select(F.col("r_name").alias("subject"))
    return brands.select("subject", F.explode(windows).alias("w")).select("subject", "w.*")


def retreat_options(spark, folder) -> DataFrame:
    """Orders and cancels per configuration value of a supplier brand."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    lines = line_places(spark, folder).select("l_partkey", F.col("brand").alias("subject"), "l_returnflag", "l_linestatus")
    dims = F.array(
        F.struct(F.lit("type").alias("dimension"), F.col("p_type").alias("label")),
        F.struct(F.lit("brand").alias("dimension"), F.col("p_brand").alias("label")),
    )
    back = F.col("l_returnflag") == "R"
    counted = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("subject", "l_returnflag", "l_linestatus", F.explode(dims).alias("x")).groupBy(
        "subject", "x.dimension", "x.label"
    ).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.count_if(back).cast("double").alias("cancel"),
        F.count_if(back & (F.col("l_linestatus") == "O")).cast("double").alias("early"),
    )
    return counted.select(
        "subject", "dimension", "label", "orders", "cancel",
        (F.col("early") / F.col("orders")).alias("pre_share"), ((F.col("cancel") - F.col("early")) / F.col("orders")).alias("post_share"),
        (F.col("cancel") / F.col("orders")).alias("share"), F.concat_ws("|", "dimension", "label").alias("ord"),
    )


def launch_observations(spark, folder) -> DataFrame:
    """Launch steps per brand and campaign: purchases with or without an earlier sign-up."""
    e = event_places(spark, folder)
    first = e.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("_u")).agg(F.min("ts").alias("first_signup"))
    marked = e.join(first, F.col("user_id") == F.col("_u"), "left")
    early = F.coalesce(F.col("first_signup") < F.col("ts"), F.lit(False))
    kind = F.col("event_type")
    buy = kind == "purchase"
    days = marked.groupBy(F.col("brand").alias("subject"), F.to_date("ts").alias("day")).agg(
        F.count_if(buy).cast("double").alias("orders"), F.count_if(buy & early).cast("double").alias("small"),
        F.count_if(buy & ~early).cast("double").alias("direct"), F.count_if(kind == "click").cast("double").alias("lock"),
        F.count_if(kind == "signup").cast("double").alias("signups"),
    )
    opened = campaigns(spark, folder).select(
        "subject", "campaign", "phase", "small_start", F.explode(F.sequence("small_start", "small_end")).alias("day")
    )
    steps = opened.join(days, ["subject", "day"]).withColumn("step_ord", F.datediff("day", "small_start") + 1)
    w = Window.partitionBy("subject", "campaign").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = steps.select(
        "*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in ("orders", "small", "direct", "lock", "signups")]
    )
    spec = (
        ("当日大定数量", F.col("orders")), ("当日净大定数量", F.col("orders") - F.col("lock") / 10),
        ("当日小订转大定数量", F.col("small")), ("当日直接大定数量", F.col("direct")),
        (LAUNCH_CUM_DIRECT, F.col("cum_direct")), ("累计小订转大定数量", F.col("cum_small")),
        ("累计大定数量", F.col("cum_orders")),
        ("累计小订转化率", F.try_divide("cum_small", "cum_signups")), (LAUNCH_CUM_LOCK, F.col("cum_lock")),
    )
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in spec])
    return total.select(
        "subject", "campaign", "phase", F.lit("day").alias("grain"), F.concat(F.lit("D"), F.col("step_ord").cast("string")).alias("step"),
        "step_ord", F.col("day").alias("step_date"), F.explode(rows).alias("x"),
    ).select("subject", "campaign", "phase", "grain", "step", "step_ord", "step_date", "x.metric", "x.value")


def launch_hourly(spark, folder) -> DataFrame:
    e = event_places(spark, folder).filter("event_type = 'purchase'")
    rows = e.groupBy(F.col("brand").alias("subject"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.withColumn("metric", F.lit("当日大定数量"))


def sku_shares(spark, folder) -> DataFrame:
    """Quantity share of each configuration per supplier brand and ship week."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    day = F.col("l_shipdate").cast("date")
    lines = line_places(spark, folder).select("l_partkey", F.col("brand").alias("subject"), F.date_trunc("week", day).cast("date").alias("period_start"), "l_quantity")
    sold = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("subject", "period_start", "p_brand", "p_type").agg(F.sum("l_quantity").alias("q"))
    total = F.sum("q").over(Window.partitionBy("subject", "period_start"))
    code = F.concat_ws("|", "p_brand", "p_type")
    return sold.select(
        "subject", label_for(F.col("period_start"), "week").alias("period"), "period_start", code.alias("code"), code.alias("ord"),
        (F.col("q") / total).alias("share"),
    )


def fee_observations(spark, folder) -> DataFrame:
    """Order counts per amount band and month, item penetration, version amounts.

    The option amount of a line is its discount, the actual amount that less tax.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    lines = line_places(spark, folder).select(
        "l_partkey", "brand", "generation", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("m"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("amount"), "l_tax", "l_returnflag",
    )
    amount = F.col("amount")
    edges = F.array(
        F.struct(F.lit("免费").alias("band"), F.lit(1).alias("pos")), F.struct(F.lit("0-5000").alias("band"), F.lit(2).alias("pos")),
        F.struct(F.lit("5000-10000").alias("band"), F.lit(3).alias("pos")), F.struct(F.lit("10000-以上").alias("band"), F.lit(4).alias("pos")),
    )
    at = F.when(amount == 0, 1).when(amount < 5000, 2).when(amount < 10000, 3).otherwise(4)
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("e", F.element_at(edges, at))
    keys = ["brand", "generation", "m", "e", "p_type", "l_returnflag"]
    # One pass over the lines; everything below works on this small cube.
    cube = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("option"),
        F.sum(amount * (1 - F.col("l_tax"))).alias("actual"),
    ).select(*[k for k in keys if k != "e"], "e.band", "e.pos", "n", "option", "actual")
    return cut_lineage(cube.withColumn("period", F.date_format("m", "yy-MM")))


def fee_table(cube: DataFrame) -> DataFrame:
    """The fee cube as long fee rows."""
    def rows(df, kind, grp, label, value, band="band", pos="pos", period="period"):
        return df.select(
            "brand", "generation", F.col(period).alias("period") if period == "period" else F.lit(period).alias("period"),
            F.col(band).alias("band") if band == "band" else F.lit(band).alias("band"), F.lit(kind).alias("row_kind"),
            grp.alias("grp"), label.alias("label"), value.cast("double").alias("value"),
            (F.col(pos) if isinstance(pos, str) else F.lit(pos)).alias("col_ord"), F.lit(1).alias("row_ord"),
        )

    none = F.lit(None).cast("string")
    bands = cube.groupBy("brand", "generation", "period", "band", "pos").agg(F.sum("n").alias("n"))
    items = cube.groupBy("brand", "generation", "period", "band", "pos", "p_type").agg(F.sum("n").alias("k"))
    rated = items.join(bands, ["brand", "generation", "period", "band", "pos"])
    paid = rated.filter("pos > 1")
    versions = cube.groupBy("brand", "generation", "period", "l_returnflag").agg(
        F.sum("n").alias("n"), F.sum("option").alias("o"), F.sum("actual").alias("a")
    )
    whole = cube.groupBy("brand", "generation", "l_returnflag").agg(F.sum("n").alias("n"), F.sum("option").alias("o"))
    months = cube.groupBy("brand", "generation", "period").agg(F.sum("n").alias("n"), F.sum("option").alias("o"), F.sum("actual").alias("a"))
    flag = F.col("l_returnflag")
    return union_all([
        rows(bands, "orders", none, F.lit("订单数量"), F.col("n")),
        rows(rated, "penetration", F.lit("type"), F.col("p_type"), F.col("k") / F.col("n")),
        rows(paid, "paid", F.lit("type"), F.col("p_type"), F.col("k") / F.col("n")),
        rows(versions, "option_amount", flag, flag, F.col("o") / F.col("n"), band="总计", pos=9),
        rows(versions, "actual_amount", flag, flag, F.col("a") / F.col("n"), band="总计", pos=9),
        rows(whole, "option_amount", flag, flag, F.col("o") / F.col("n"), band="总计", pos=9, period="总计"),
        rows(months, "option_total", F.lit("合计"), F.lit("合计"), F.col("o") / F.col("n"), band="总计", pos=9),
        rows(months, "actual_total", F.lit("合计"), F.lit("合计"), F.col("a") / F.col("n"), band="总计", pos=9),
    ])


def fee_rank(cube: DataFrame) -> DataFrame:
    """Ranked items of a generation as printed texts 'label 12.5% (3000)'."""
    items = cube.groupBy("brand", "generation", "p_type").agg(F.sum("n").alias("k"), F.sum("option").alias("o"))
    total = F.sum("k").over(Window.partitionBy("generation"))
    w = Window.partitionBy("generation").orderBy(F.desc("k"), "p_type")
    text = F.concat(
        F.col("p_type"), F.lit(" "), F.format_string("%.1f", F.col("k") / total * 100), F.lit("% ("),
        F.bround(F.col("o") / F.col("k"), 0).cast("bigint").cast("string"), F.lit(")"),
    )
    return items.select("brand", "generation", F.row_number().over(w).alias("rank"), text.alias("item_text")).withColumn(
        "ord", F.concat_ws("|", "generation", F.lpad(F.col("rank").cast("string"), 4, "0"))
    )


def export_day():
    """Order date moved by one 28-year calendar cycle (same weekdays, same ISO weeks), because
    two-digit years of period labels always mean this century."""
    return F.add_months(F.col("o_orderdate").cast("date"), 336)


def half_year(day):
    """Number of the half-year export a day belongs to; its range is the half year."""
    return (F.year(day) - 2023) * 2 + F.when(F.month(day) > 6, 1).otherwise(0)


def export_ranges(spark, folder) -> DataFrame:
    """Declared range of every half-year export that has orders."""
    day = export_day()
    files = table(spark, folder, "orders").select(half_year(day).alias("source_order")).distinct()
    year = F.floor(F.col("source_order") / 2).cast("int") + 2023
    second = F.pmod("source_order", F.lit(2)) == 1
    return files.select(
        F.concat(F.lit("orders_"), year.cast("string"), F.when(second, "H2").otherwise("H1")).alias("source_file"), "source_order",
        F.when(second, F.make_date(year, F.lit(7), F.lit(1))).otherwise(F.make_date(year, F.lit(1), F.lit(1))).alias("start"),
        F.when(second, F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.make_date(year, F.lit(6), F.lit(30))).alias("end"),
    )


def exports(spark, folder, grains=("week", "day")) -> DataFrame:
    """Orders split into half-year exports, as observations with source columns.

    Per nation of a region (metric rows), weekly and daily; plus segment counts and shares
    and active customers per segment, weekly.
    """
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", export_day().alias("day"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    facts = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("brand").alias("subject"), "day", half_year(F.col("day")).alias("source_order"), "o_custkey", "o_orderstatus", F.col("c_mktsegment").alias("segment"))
    daily = facts.groupBy("subject", "day", "source_order", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")
    )
    timed = with_label(
        by_grain(daily, grains).groupBy("subject", "grain", "period_start", "source_order", "segment").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    )
    keys = ["subject", "grain", "period", "source_order"]
    totals = timed.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum("f").cast("double").alias("f"))
    rows = F.array(
        F.struct(F.lit(ORDERS).alias("metric"), F.col("n").alias("value"), F.lit(1).alias("row_ord")),
        F.struct(F.lit("净大定").alias("metric"), F.col("f").alias("value"), F.lit(2).alias("row_ord")),
    )
    scalar = totals.select(*keys, F.explode(rows).alias("x")).select(
        *keys, "x.metric", F.lit(QTY).alias("stat"), F.lit(QTY).alias("category"), "x.value", "x.row_ord"
    )
    weekly = timed.filter("grain = 'week'").groupBy(*keys, "segment").agg(F.sum("n").cast("double").alias("n"))
    weekly = weekly.join(totals.select(*keys, F.col("n").alias("t")), keys)
    parts = F.array(
        F.struct(F.lit(QTY).alias("stat"), F.col("n").alias("value"), F.lit(10).alias("base")),
        F.struct(F.lit(SHARE).alias("stat"), (F.col("n") / F.col("t")).alias("value"), F.lit(20).alias("base")),
    )
    channel = weekly.select(*keys, F.col("segment").alias("category"), F.explode(parts).alias("x")).select(
        *keys, F.lit(CHANNEL).alias("metric"), "x.stat", "category", "x.value", (F.col("x.base") + F.length("category")).alias("row_ord")
    )
    # Power shares come without counts and are weighted by the order pieces.
    power = totals.filter("grain = 'week'").select(
        *keys, F.lit(POWER).alias("metric"), F.lit(SHARE).alias("stat"), F.lit("F").alias("category"),
        (F.col("f") / F.col("n")).alias("value"), F.lit(40).alias("row_ord"),
    )
    buyers = facts.withColumn("period_start", F.date_trunc("week", "day").cast("date")).groupBy(
        "subject", "period_start", "source_order", "segment"
    ).agg(F.countDistinct("o_custkey").cast("double").alias("value")).select(
        "subject", F.lit("week").alias("grain"), label_for(F.col("period_start"), "week").alias("period"), "source_order",
        F.lit(CHANNEL).alias("metric"), F.lit(STORES).alias("stat"), F.col("segment").alias("category"), "value",
        (F.length("segment") + 30).alias("row_ord"),
    )
    return union_all([scalar, channel, power, buyers]).select(
        F.lit("大定选配比例").alias("report"), "subject", "grain", "period", "metric", "stat", "category", "value",
        F.lit(None).cast("string").alias("raw"), F.lit("0").alias("fmt"), "source_order", "row_ord",
    )


def notes(spark, folder) -> DataFrame:
    """Dated notes from error events on generations, and from sign-ups on brands."""
    e = event_places(spark, folder)
    s = subjects(spark, folder).select(F.col("id").alias("_sid"), F.col("name").alias("_sn"))
    target = F.when(F.col("event_type") == "error", F.col("generation")).otherwise(F.col("brand"))
    rows = e.filter("event_type in ('error', 'signup')").withColumn("_sn", target).join(s, "_sn")
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("_sid").alias("subject"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("text"), F.lit(1).alias("version"),
    )
