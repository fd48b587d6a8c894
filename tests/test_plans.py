import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from helpers import make, observations
from metricloom import schemas
from metricloom.operators import annotate, compare, quality
from metricloom.plans import cancellation, channel, conversion, fee, launch, overview, registry, sku


def day(s):
    return dt.date.fromisoformat(s)


def with_start(df):
    return df.withColumn("period_start", F.to_date("period"))


def channel_rows(spark, values, shares, active):
    rows = []
    for i, d in enumerate(("2026-01-01", "2026-01-02")):
        for j, c in enumerate("AB"):
            for stat, table in (("数量", values), ("占比", shares), ("贡献门店数", active)):
                rows.append({"metric": "门店类型", "stat": stat, "category": c, "period": d, "value": table[c][i], "row_ord": j})
    return with_start(observations(spark, rows, grain="day", subject="甲"))


def test_channel_numbers(spark):
    obs = channel_rows(spark, {"A": (20.0, 40.0), "B": (0.0, 10.0)}, {"A": (0.10, 0.123), "B": (0.9, 0.877)}, {"A": (2.0, 4.0), "B": (0.0, 1.0)})
    stores = spark.createDataFrame([("甲", "A", 20.0), ("甲", "B", 10.0)], "subject string, channel string, stores double")
    rows, totals = channel.channel_panel(obs, stores)
    a = rows.filter("channel = 'A' and period = '2026-01-02'").first()
    assert a["share"] == pytest.approx(0.123) and a["active_rate"] == pytest.approx(0.2) and a["productivity"] == pytest.approx(2.0)
    assert a["n_change"] == 20.0 and a["share_change"] == pytest.approx(0.023)
    assert a["active_rate_change"] == pytest.approx(0.1) and a["productivity_change"] == pytest.approx(1.0)
    t = totals.filter("period = '2026-01-02'").first()
    assert (t["n"], t["active"], t["stores"]) == (50.0, 5.0, 30.0)
    assert t["active_rate"] == pytest.approx(5 / 30) and t["productivity"] == pytest.approx(50 / 30)


def test_channel_unknown_is_not_zero(spark):
    obs = channel_rows(spark, {"A": (0.0, None), "B": (-2.0, 10.0)}, {"A": (None, None), "B": (None, None)}, {"A": (30.0, None), "B": (None, None)})
    stores = spark.createDataFrame([("甲", "A", 20.0), ("甲", "B", 10.0)], "subject string, channel string, stores double")
    rows, totals = channel.channel_panel(obs, stores)
    got = {(r["period"][-1], r["channel"]): r for r in rows.collect()}
    assert got["1", "A"]["n"] == 0.0 and got["1", "B"]["n"] is None
    assert got["1", "A"]["inconsistent"] and got["1", "A"]["active_rate"] is None
    assert got["2", "A"]["n_change"] is None
    assert all(r["n"] is None for r in totals.collect())


def test_store_counts_inherit(spark):
    subjects = spark.createDataFrame(
        [("集团", "group", None), ("甲", "brand", "集团"), ("乙", "brand", "集团"), ("甲1", "generation", "甲")], "name string, type string, parent string")
    counts = make(spark, schemas.STORE_COUNTS, [{"brand": "甲", "channel": "A", "n": 20.0}, {"brand": "甲", "channel": "B", "n": 5.0}, {"brand": "乙", "channel": "A", "n": 7.0}, {"brand": "乙", "channel": "B", "n": -1.0}])
    overrides = make(spark, schemas.STORE_OVERRIDES, [{"subject": "甲", "channel": "A", "n": 18.0}, {"subject": "甲1", "channel": "B", "n": 2.0}])
    got = {(r["subject"], r["channel"]): r["stores"] for r in channel.effective_store_counts(subjects, counts, overrides, "集团").collect()}
    assert got["甲", "A"] == 18.0 and got["甲1", "A"] == 18.0 and got["甲1", "B"] == 2.0
    assert got["集团", "A"] == 25.0 and got["集团", "B"] is None


@pytest.mark.parametrize("values, loss, total", [
    ((100.0, 90.0, None, 80.0, 75.0, 70.0, 60.0), [10.0, None, None, 5.0, 5.0, 10.0], 0.6),
    ((None, 90.0, 85.0, 80.0, 75.0, 70.0, 60.0), [None, 5.0, 5.0, 5.0, 5.0, 10.0], None),
])
def test_conversion(spark, values, loss, total):
    row = {"subject": "M", "grain": "week", "period": "26WK40", **{f"s{i}": v for i, v in enumerate(values, 1)}}
    df = make(spark, schemas.COHORTS, [row])
    rows = conversion.stage_rates(df).orderBy("stage_no").collect()
    assert [r["loss"] for r in rows[1:]] == loss
    assert rows[6]["total_rate"] == total and rows[6]["stage_rate"] == pytest.approx(60 / 70)
    f = conversion.funnel(df).first()
    assert f["total_rate"] == total and f["largest_loss"] is None
    bars = [r["loss"] for r in conversion.loss_bars(df).orderBy("stage_no").collect()]
    assert bars == ([10.0, 5.0, 5.0, 10.0] if total else [])


def test_small_order_rhythm_prefers_hourly(spark):
    mix = spark.createDataFrame([("M", day("2026-08-05"), 100.0), ("M", day("2026-08-06"), 50.0)], "subject string, day date, orders double")
    hourly = make(spark, schemas.RETREAT_HOURLY, [{"subject": "M", "date": day("2026-08-05"), "hour": 10, "orders": 20.0, "cancel": 2.0}])
    daily = spark.createDataFrame([("M", day("2026-08-05"), 10.0)], "subject string, day date, cancel double")
    rows = cancellation.rhythm_rates(cancellation.small_order_rhythm(mix, cancellation.hourly_to_day(hourly), daily)).orderBy("day").collect()
    assert [(r["orders"], r["cancel"], r["retained"]) for r in rows] == [(20.0, 2.0, 18.0), (50.0, 0.0, 50.0)]


def test_campaign_totals(spark):
    df = spark.createDataFrame([("M", "a", 100.0, 90.0, 10.0), ("M", "b", 300.0, 150.0, 150.0)], "subject string, campaign string, orders double, retained double, cancel double")
    row = cancellation.combined_totals(cancellation.campaign_totals(df)).first()
    assert (row["orders"], row["retained"], row["cancel"], row["retention_rate"]) == (400.0, 240.0, 160.0, pytest.approx(0.6))


def launch_rows(spark, table, subject="M", phase=1, start="2026-10-01"):
    rows = []
    for metric, values in table.items():
        for i, v in enumerate(values):
            rows.append({"subject": subject, "campaign": "", "phase": phase, "grain": "day", "step": f"D{i + 1}", "step_ord": i + 1,
                         "step_date": day(start) + dt.timedelta(days=i), "metric": metric, "value": v})
    return make(spark, schemas.LAUNCH_OBS, rows)


LAUNCH = {
    "当日大定数量": (80.0, 120.0, 100.0), "当日直接大定数量": (60.0, 100.0, 80.0), "当日小订转大定数量": (20.0, 20.0, 20.0),
    "累计小订转大定数量": (20.0, 40.0, 60.0), "累计直接大定数量": (60.0, 160.0, 240.0), "累计交车锁单数量": (30.0, 80.0, 150.0), "累计小订转化率": (0.1, 0.2, 0.3),
}


def test_launch_shares(spark):
    rows = launch.direct_share(launch.launch_steps(launch_rows(spark, LAUNCH))).orderBy("step_ord").collect()
    assert [r["day_share"] for r in rows] == pytest.approx([0.75, 100 / 120, 0.8])
    assert [r["cum_share"] for r in rows] == pytest.approx([60 / 80, 160 / 200, 240 / 300])


def test_launch_explicit_zero_gross_is_kept(spark):
    steps = launch.launch_steps(launch_rows(spark, {**LAUNCH, "累计大定数量": (0.0, 0.0, 0.0)}))
    assert all(r["cum_share"] is None for r in launch.direct_share(steps).collect())


def test_launch_phases(spark):
    obs = launch_rows(spark, LAUNCH).unionByName(launch_rows(spark, {**LAUNCH, "累计交车锁单数量": (None, None, None)}, phase=2, start="2026-10-10"))
    summary = launch.phase_summary(launch.launch_steps(obs))
    gaps = launch.phase_gaps(summary).orderBy("phase").collect()
    assert [r["gap_days"] for r in gaps] == [None, 6] and [r["is_default"] for r in gaps] == [False, True]
    both = launch.launch_combined(summary).first()
    assert both["orders"] == 600.0 and both["locked"] is None
    assert both["small_rate"] == pytest.approx(0.3) and both["direct_share"] == pytest.approx(0.8)


def test_sku(spark):
    share = make(spark, schemas.SKU_SHARE, [
        {"subject": "M", "period": p, "code": c, "share": v, "ord": i}
        for i, (c, vs) in enumerate((("SKU1", (0.0, 0.6, 1.0)), ("SKU2", (1.0, 0.4, 0.0)))) for p, v in zip(("26WK01", "26WK02", "26WK03"), vs)])
    topk = make(spark, schemas.SKU_TOPK, [
        {"subject": "M", "period": p, "label": f"TOP{r}", "rank": r, "share": v}
        for r, vs in ((3, (0.5, 0.6, 0.9)), (5, (0.8, 0.85, 1.0))) for p, v in zip(("26WK01", "26WK02", "26WK04"), vs)])
    rows = {r["period"]: r for r in sku.sku_kpis(share, topk).collect()}
    assert rows["26WK02"]["active"] == 2 and rows["26WK01"]["active"] == 1
    assert rows["26WK04"]["active"] is None and rows["26WK04"]["needed"] == 3
    assert rows["26WK01"]["needed"] == 5 and rows["26WK03"]["top3"] is None


def test_sku_unknown_rank_blocks_coverage(spark):
    topk = make(spark, schemas.SKU_TOPK, [{"subject": "M", "period": "p", "label": f"TOP{r}", "rank": r, "share": v} for r, v in ((1, 0.5), (2, None), (3, 0.9))])
    assert sku.coverage_rank(topk).first()["needed"] is None


def fee_rows(rows):
    base = {"brand": "甲", "generation": "甲1", "grp": None, "label": None}
    return [{**base, "col_ord": i, **r} for i, r in enumerate(rows)]


def test_fee(spark):
    orders = [("26-07", "免费", 100.0), ("26-07", "0-10000", 200.0), ("26-08", "免费", 100.0), ("26-08", "0-5000", 200.0), ("26-08", "5000-10000", 300.0), ("汇总", "免费", 999.0)]
    obs = make(spark, schemas.FEE_OBS, fee_rows([{"period": p, "band": b, "row_kind": "orders", "value": v} for p, b, v in orders]))
    totals = fee.fee_band_totals(fee.fee_orders(obs))
    got = {r["band"]: (r["position"], r["n"]) for r in totals.collect()}
    assert got == {"免费": (1, 200.0), "0-5000": (2, 200.0), "5000-10000": (3, 300.0), "0-10000": (4, 200.0)}
    assert fee.paid_share(totals).first()["paid_percent"] == 78.0


def test_fee_total_column_first_and_true_zero_wins(spark):
    rows = [{"period": "26-07", "band": b, "row_kind": k, "grp": "合计", "value": v, "row_ord": 1}
            for k, b, v in (("option_total", "免费", 5.0), ("option_total", "总计", 0.0), ("actual_total", "免费", None), ("actual_total", "0-5000", 7.0))]
    row = fee.fee_month_totals(make(spark, schemas.FEE_OBS, fee_rows(rows))).first()
    assert (row["option_total"], row["actual_total"]) == (0.0, 7.0)


@pytest.mark.parametrize("now, before, rise, drop", [
    (0.0, 100.0, None, 1.0), (None, 100.0, None, None), (150.0, 100.0, 0.5, None), (10.0, 0.0, None, None), (float("nan"), 5.0, None, None), (-1.0, 5.0, None, None),
])
def test_rankings(spark, now, before, rise, drop):
    df = spark.createDataFrame([("m", "x", now, before)], "metric string, subject string, now double, before double")
    for direction, expected in (("rise", rise), ("drop", drop)):
        rows = compare.change_rank(df, direction, ["metric"], "subject").collect()
        assert ([r["rate"] for r in rows] or [None])[0] == expected


def test_kpi_comparison_skips_summaries(spark):
    rows = [("m", "s", "day", p, st, "k", v) for p, st, v in (("2026-01-01", "2026-01-01", 10.0), ("总计", "2026-01-02", 99.0), ("2026-01-03", "2026-01-03", 5.0))]
    df = spark.createDataFrame(rows, "module string, subject string, grain string, period string, period_start string, label string, value double")
    got = {r["period"]: r["comparison"] for r in compare.kpi_comparison(df).collect()}
    assert got["2026-01-03"]["previous"] == 10.0 and got["2026-01-03"]["rate"] == -0.5 and got["2026-01-03"]["direction"] == "down"
    assert got["总计"]["status"] == "unavailable"


def test_structure_change_new_label_is_no_change(spark):
    rows = [("order_mix", "M", "week", p, "外观", c, s, i) for i, (p, c, s) in enumerate((("26WK01", "黑", 1.0), ("26WK02", "黑", 0.7), ("26WK02", "白", 0.3)))]
    rows += [("lock_mix", *r[1:6], 1 - r[6] / 2, r[7]) for r in rows]
    df = spark.createDataFrame(rows, "report string, subject string, grain string, period string, metric string, category string, share double, ord int").withColumn("period_start", F.col("period"))
    changed = compare.structure_change(df).collect()
    assert len(changed) == len(rows)
    got = {(r["period"], r["category"]): r["change"] for r in changed if r["report"] == "order_mix"}
    assert got["26WK02", "黑"] == pytest.approx(-0.3) and got["26WK02", "白"] == 0.0


def test_apportion_is_exact(spark):
    shares = spark.createDataFrame([("G", "day", "p", c, s) for c, s in (("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3))], "parent string, grain string, period string, child string, share double")
    target = spark.createDataFrame([("G", "day", "p", 100.0)], "parent string, grain string, period string, target double")
    got = {r["child"]: r["n"] for r in overview.apportion(shares, target).collect()}
    assert got == {"a": 34.0, "b": 33.0, "c": 33.0}


def test_lock_share_withheld_when_a_child_is_missing(spark):
    rows = [{"metric": "交车锁单", "period": "2026-01-01", "subject": s, "value": v} for s, v in (("甲", 3.0), ("甲1", 3.0))]
    lock = with_start(observations(spark, rows, grain="day"))
    subjects = spark.createDataFrame([("甲", "brand", "集团"), ("甲1", "generation", "甲"), ("甲2", "generation", "甲")], "name string, type string, parent string")
    assert overview.lock_share(lock, subjects).count() == 0
    assert overview.lock_share(lock, subjects.filter("name <> '甲2'")).first()["share"] == 1.0


def test_annotations(spark):
    subjects = spark.createDataFrame([("g", "集团", "group", None), ("b", "甲", "brand", "集团"), ("c", "甲1", "generation", "b"), ("d", "乙1", "generation", "d")], "id string, name string, type string, parent string")
    notes = make(spark, schemas.NOTES, [{"id": f"n{i}", "date": "2026-01-0" + str(i), "subject": s, "text": "t", "version": 1} for i, s in enumerate(("*", "g", "b", "c"), 1)])
    seen = {}
    for r in annotate.annotations_for(notes, subjects).collect():
        seen.setdefault(r["subject_id"], set()).add(r["note_id"])
    assert seen == {"g": {"n1", "n2"}, "b": {"n1", "n2", "n3"}, "c": {"n1", "n2", "n3", "n4"}, "d": {"n1", "n2"}}


def test_note_changes(spark):
    subjects = spark.createDataFrame([("g", "集团", "group", None)], "id string, name string, type string, parent string")
    current = make(spark, schemas.NOTES, [{"id": i, "date": "2026-01-01", "subject": "g", "text": "old", "version": 1} for i in "abc"])
    def change(i, o, action, version=None, text="new", subject="g"):
        return {"id": i, "ord": o, "action": action, "expected_version": version, "date": "2026-01-02", "subject": subject, "text": text}
    changes = make(spark, schemas.NOTE_CHANGES, [
        change("a", 1, "update", 1), change("a", 2, "update", 1), change("b", 3, "delete", 1), change("c", 4, "update", 2),
        change("x", 5, "delete", 1), change("n", 6, "add"), change("m", 7, "add", text=" "), change("k", 8, "add", subject="nobody")])
    state, audit = annotate.apply_changes(current, changes, subjects)
    assert {r["ord"]: r["status"] for r in audit.collect()} == {1: 200, 2: 409, 3: 200, 4: 409, 5: 404, 6: 200, 7: 422, 8: 422}
    assert {r["id"]: (r["text"], r["version"]) for r in state.collect()} == {"a": ("new", 2), "c": ("old", 1), "n": ("new", 1)}


def test_sub_generations_map_to_parents(spark):
    campaigns = spark.createDataFrame([("甲界 M9 2026款", "甲界 M9 2026款 预售")], "generation string, sub_generation string")
    df = spark.createDataFrame([("甲界M9 2026款预售",), ("甲界 M7",)], "name string")
    assert {r["name"] for r in quality.to_parent(df, campaigns).collect()} == {"甲界 M9 2026款", "甲界 M7"}


def test_every_rank_of_a_large_catalogue(spark):
    rows = [("M", p, start, f"c{i:03d}", f"c{i:03d}", 1 / 250) for p, start in (("99WK52", "1999-12-27"), ("00WK01", "2000-01-03")) for i in range(250)]
    share = spark.createDataFrame(rows, "subject string, period string, period_start string, code string, ord string, share double")
    share = share.withColumn("period_start", F.col("period_start").cast("date"))
    topk = sku.cumulative_topk(share).withColumn("share", F.round("share", 9))
    assert topk.filter("rank = 250 and share = 1").count() == 2
    kpis = {r["period"]: r for r in sku.sku_kpis(share, topk).collect()}
    assert kpis["99WK52"]["active"] == 250 and kpis["00WK01"]["needed"] == 200
    compared = {(r["period"], r["label"]): r["comparison"]["status"] for r in sku.sku_comparison(sku.sku_kpis(share, topk)).collect()}
    assert compared["99WK52", "active"] == "unavailable" and compared["00WK01", "active"] == "available"


def test_notes_of_all_ancestors(spark):
    chain = [(f"s{i}", f"n{i}", "brand", f"s{i - 1}" if i else None) for i in range(6)] + [("x", "x", "brand", "y"), ("y", "y", "brand", "x")]
    subjects = spark.createDataFrame(chain, "id string, name string, type string, parent string")
    got = {(r["id"], r["ancestor"]) for r in annotate.ancestors(subjects).collect()}
    assert {a for i, a in got if i == "s5"} == {f"s{i}" for i in range(6)} and {a for i, a in got if i == "x"} == {"x", "y"}


def test_later_changes_of_a_note(spark):
    subjects = spark.createDataFrame([("g", "集团", "group", None)], "id string, name string, type string, parent string")
    current = make(spark, schemas.NOTES, [{"id": "a", "date": "2026-01-01", "subject": "g", "text": "old", "version": 1}])
    steps = [("update", 1, " "), ("update", 1, "one"), ("update", 2, "two"), ("update", 2, "late"), ("delete", 3, "x"), ("update", 3, "gone"), ("add", None, "again")]
    changes = make(spark, schemas.NOTE_CHANGES, [{"id": "a", "ord": i, "action": a, "expected_version": v, "date": "2026-01-02", "subject": "g", "text": t} for i, (a, v, t) in enumerate(steps)])
    state, audit = annotate.apply_changes(current, changes, subjects)
    assert [r["status"] for r in audit.orderBy("ord").collect()] == [422, 200, 200, 409, 200, 404, 200]
    assert [(r["text"], r["version"]) for r in state.collect()] == [("again", 1)]


def test_hourly_sheets_are_paired_by_equality(spark):
    phases = spark.createDataFrame([("M", "spring", 1, "a"), ("M", "", 2, "b"), ("N", "", None, "c"), ("O", "", None, "d"), ("O", "", None, "e")], "subject string, campaign string, phase int, sheet string")
    hourly = spark.createDataFrame([("M", "spring", None, "h1", 2), ("M", "spring", None, "h0", 1), ("M", "", 2, "h2", 3), ("N", "", None, "h3", 4), ("O", "", None, "h4", 5)], "subject string, campaign string, phase int, sheet string, ord int")
    assert {(r["sheet"], r["hourly_sheet"]) for r in launch.pair_hourly(phases, hourly).collect()} == {("a", "h0"), ("b", "h2"), ("c", "h3")}


def test_batch_never_compares_with_all(spark):
    rows = [("M", c, d, o, 0.0) for c, d, o in (("spring", "2024-01-03", 20.0), ("autumn", "2024-01-20", 10.0))]
    rhythm = spark.createDataFrame(rows, "subject string, campaign string, day string, orders double, cancel double")
    got = {(r["period"], r["label"]): r["comparison"] for r in compare.kpi_comparison(registry.build_all({"rhythm": rhythm})).collect()}
    assert got["autumn", "orders"]["previous"] == 20.0 and got["spring", "orders"]["status"] == "unavailable" and got["all", "orders"]["status"] == "unavailable"


def test_covered_days_are_zeros_in_rankings(spark):
    rows = [{"metric": "交车锁单", "period": p, "subject": s, "value": v} for s, p, v in (("甲", "2026-01-01", 5.0), ("乙", "2026-01-01", 5.0), ("丙", "2026-01-02", 1.0))]
    obs = with_start(observations(spark, rows, grain="day"))
    coverage = spark.createDataFrame([("甲", day("2026-01-01"), day("2026-01-02"))], "subject string, start date, end date")
    got = {r["subject"]: (r["now"], r["before"]) for r in overview.ranking_input(obs, coverage).collect()}
    assert got == {"甲": (0.0, 5.0), "乙": (None, 5.0), "丙": (1.0, None)}
    assert {r["subject"] for r in overview.ranking_input(obs).collect()} == {"丙"}
    subjects = spark.createDataFrame([("甲", "generation"), ("丙", "brand")], "name string, type string")
    assert {r["subject"] for r in overview.rank_candidates(overview.ranking_input(obs, coverage), subjects).collect()} == {"甲"}


def test_ranges_of_exports_become_intervals(spark):
    """Overlapping, adjoining, repeated and nested ranges merge; a gap of a day and empty ranges don't."""
    from metricloom.operators.coverage import interval_days, merged_intervals

    rows = [("a", 1, 5), ("a", 4, 9), ("a", 10, 11), ("a", 2, 3), ("a", 4, 9), ("a", 13, 13), ("a", 20, 18), ("a", None, 30), ("b", 1, 1), (None, 1, 2), (None, 2, 3)]
    ranges = spark.createDataFrame([(k, s and day(f"2026-01-{s:02d}"), day(f"2026-01-{e:02d}")) for k, s, e in rows], "k string, start date, end date")
    got = {(r["k"], r["start"].day, r["end"].day) for r in merged_intervals(ranges, ["k"]).collect()}
    assert got == {("a", 1, 11), ("a", 13, 13), ("b", 1, 1), (None, 1, 3)}
    days = interval_days(ranges, ["k"])
    assert days.count() == days.distinct().count() == 16


def test_coverage_and_candidates_by_metric_and_grain(spark):
    rows = [{"report": r, "metric": m, "period": p, "subject": s, "value": v} for r, m, p, s, v in (
        ("lock_mix", "交车锁单", "2026-01-01", "M7 2025款", 5.0), ("order_mix", "留存大定", "2026-01-01", "M7 2025款", 3.0), ("lock_mix", "交车锁单", "2026-01-02", "M9", 1.0),
        ("order_mix", "留存大定", "2026-01-02", "M7 2026款", 4.0),
    )]
    obs = with_start(observations(spark, rows, grain="day"))
    coverage = spark.createDataFrame([("M7 2025款", "交车锁单", day("2026-01-01"), day("2026-01-02"))], "subject string, metric string, start date, end date")
    pairs = overview.ranking_input(obs, coverage)
    got = {(r["subject"], r["metric"]): (r["now"], r["before"]) for r in pairs.collect()}
    assert got["M7 2025款", "交车锁单"] == (0.0, 5.0) and got["M7 2025款", "留存大定"] == (None, 3.0) and got["M9", "交车锁单"] == (1.0, None)
    # 2026 has no lock report, so 2025 is the newest year that takes part; M9 has no orders.
    subjects = spark.createDataFrame([(n, "generation") for n in ("M7 2025款", "M7 2026款", "M9")], "name string, type string")
    assert {r["subject"] for r in overview.rank_candidates(pairs, subjects, obs).collect()} == {"M7 2025款"}


def test_ratio_weights_know_module_names(spark):
    from metricloom.operators.merge import primary_metric

    df = spark.createDataFrame([(n,) for n in ("order_mix", "small_order_mix", "lock_mix", "大定选配比例", "else")], "report string")
    assert [r["m"] for r in df.select(primary_metric().alias("m")).collect()] == ["大定", "小订", "交车锁单", "大定", None]


def changed_one_by_one(current, changes):
    notes, audit = dict(current), {}
    for key, n, action, expected, text in sorted(changes, key=lambda c: c[1]):
        version, wrong = notes.get(key, (None, None))[0], text == ""
        if action == "add":
            status = 409 if version is not None else 422 if wrong else 200
        else:
            status = 404 if version is None else 409 if expected != version else 422 if wrong and action != "delete" else 200
        audit[n] = (status, (version or 0) + 1 if status == 200 else None)
        if status == 200:
            notes[key] = ((version or 0) + 1, text)
            if action == "delete":
                del notes[key]
    return notes, audit


def test_long_chains_of_changes_equal_one_by_one(spark):
    rng = random.Random(6)
    version, changes = 3, []
    for n in range(6000):
        key = "hot" if rng.random() < 0.8 else f"k{rng.randrange(40)}"
        action = rng.choices(["update", "add", "delete"], [90, 5, 1])[0]
        expected = version + rng.choice([0, 0, 0, 0, 1, -1]) if key == "hot" else rng.randint(1, 3)
        changes.append((key, n * 7, action, rng.choice([None, expected]) if rng.random() < 0.05 else expected, rng.choice(["", "text", "more"])))
        if key == "hot" and action == "update" and rng.random() < 0.7:
            version += 1
        if key == "hot" and action == "delete":
            version = 1
    current = {"hot": (3, "old"), "k1": (1, "old"), "k99": (4, "kept")}
    notes = spark.createDataFrame([(k, "2026-01-01", "*", t, v) for k, (v, t) in current.items()], annotate_schema("id date subject text version"))
    rows = spark.createDataFrame([(k, n, a, e, "2026-01-02", "*", t) for k, n, a, e, t in changes], annotate_schema("id ord action expected_version date subject text")).repartition(3)
    subjects = spark.createDataFrame([("g", "G", "group", None)], "id string, name string, type string, parent string")
    jobs = []
    for part in (rows.filter("ord < 70"), rows):
        spark.sparkContext.setJobGroup(f"changes-{len(jobs)}", "")
        state, audit = annotate.apply_changes(notes, part, subjects)
        got = {r["ord"]: (r["status"], r["new_version"]) for r in audit.collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"changes-{len(jobs)}")))
    want_notes, want = changed_one_by_one(current, changes)
    assert got == want and sum(s == 200 for s, _ in want.values()) > 100
    assert {r["id"]: (r["version"], r["text"]) for r in state.collect()} == want_notes
    # As many rounds for 6,000 changes as for 10.
    assert abs(jobs[0] - jobs[1]) <= 2


def annotate_schema(names):
    kinds = {"version": "int", "ord": "long", "expected_version": "int"}
    return ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names.split())
