import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from helpers import sheet
from metricloom.labels import DAILY_HEADERS, HOURLY_HEADERS, STAGES
from metricloom.operators import ordered
from metricloom.sources import cells as layout


def test_metric_sheet(spark):
    grid = [
        ["指标", "统计类型", "分类", "2021-01-01", dt.datetime(2022, 1, 1), "总计"],
        ["大定", "数量", "数量", 0, None, 9],
        ["动力", "占比", "增程", 0.4, "45%", 1],
        [None, None, "纯电", 60, "x", 1],
    ]
    got = {(r["metric"], r["category"], r["period"]): (r["value"], r["raw"]) for r in layout.tidy_metric_cells(sheet(spark, grid)).collect()}
    assert got["大定", "数量", "2021-01-01"] == (0.0, None)
    assert got["动力", "增程", "2022-01-01"] == (0.45, None)
    assert got["动力", "纯电", "2021-01-01"][0] == 0.6
    assert got["动力", "纯电", "2022-01-01"] == (None, "x")
    assert len(got) == 5


def test_chart_blocks_stop_at_total(spark):
    grid = [
        ["甲"], [None, "甲净大定", "26WK01", "26WK02"], [None, "增程", 0.4, None], [None, "总计", 10, 20], [None, "额外", 1, 1],
        ["乙"], [None, "乙大定", "26WK01"], [None, "总计", 5],
    ]
    got = {(r["subject"], r["series"], r["period"]): r["value"] for r in layout.tidy_chart_cells(sheet(spark, grid)).collect()}
    assert got == {("甲", "增程", "26WK01"): 0.4, ("甲", None, "26WK01"): 10.0, ("甲", None, "26WK02"): 20.0, ("乙", None, "26WK01"): 5.0}


def test_header_needs_every_field_and_ignores_order(spark):
    grid = [["说明"], ["总退订数", "小订小时", "小订日期", "小订数"], [2, 10, "2026-08-05", 20]]
    df = sheet(spark, grid)
    header = layout.resolve_header(df, HOURLY_HEADERS, list(HOURLY_HEADERS))
    row = layout.header_records(df, header, ["date"], ["hour", "orders", "cancel"]).first()
    assert (row["date"], row["hour"], row["orders"], row["cancel"]) == ("2026-08-05", 10.0, 20.0, 2.0)
    assert layout.resolve_header(df, DAILY_HEADERS, list(DAILY_HEADERS)).count() == 0


def test_cohort_header_in_any_order(spark):
    stages = list(reversed(STAGES))
    grid = [["大定到交车锁单（天）", *stages, "周"], [None, *["数量"] * 7, None], [3, 60, 70, 75, 80, None, 90, 100, "26WK40"]]
    row = layout.tidy_cohort_cells(sheet(spark, grid)).first()
    assert [row[f"s{i}"] for i in range(1, 8)] == [100.0, 90.0, None, 80.0, 75.0, 70.0, 60.0]
    assert row["period"] == "26WK40" and row["order_to_lock_days"] == 3.0


def test_option_retreat_blocks(spark):
    head = [None, "小订数", "总退订数", "小订后退订比例", "大定后退订比例", "总退订比例"]
    grid = [["地理区域退订比例"], ["地理区域", *head[1:]], ["东北", 1601, 93, 0.043, 0.014, 0.058], [],
            ["版本退订比例"], ["总退订比例", "版本", "小订数", "总退订数"], ["1.3%", "四驱", 1796, 28]]
    got = {(r["dimension"], r["label"]): (r["orders"], r["cancel"], r["share"]) for r in layout.tidy_option_retreat(sheet(spark, grid)).collect()}
    assert got == {("地理区域", "东北"): (1601.0, 93.0, 0.058), ("版本", "四驱"): (1796.0, 28.0, pytest.approx(0.013))}


FEE = [
    ["权益金额", 5000], [], ["", "", "26-07", None, "总计", "26-08", None, None], ["", "", "免费", "0-10000", "总计", "免费", "0-5000", "5000-10000"],
    ["", "订单数量", 100, 200, 300, 100, 200, 300], ["座椅", "按摩", 0.1, 0.2, None, "30%", 0.4, 0.5],
]


def test_fee_layout(spark):
    df = sheet(spark, FEE)
    assert tuple(layout.fee_layout(df).select("band_row", "order_row").first()) == (4, 5)
    rows = layout.tidy_fee_cells(df)
    orders = {(r["period"], r["band"]): r["value"] for r in rows.filter("row_kind = 'orders'").collect()}
    assert orders == {("26-07", "免费"): 100.0, ("26-07", "0-10000"): 200.0, ("26-08", "免费"): 100.0, ("26-08", "0-5000"): 200.0, ("26-08", "5000-10000"): 300.0}
    assert rows.filter("row_kind = 'penetration' and period = '26-08' and band = '免费'").first()["value"] == pytest.approx(0.3)


def test_fee_header_of_zeros_does_not_win(spark):
    grid = [r[:] for r in FEE] + [["版本", "选配金额", 0, 0, 0, 0, 0, 0]]
    assert tuple(layout.fee_layout(sheet(spark, grid)).select("band_row", "order_row").first()) == (4, 5)


def test_launch_sheet_and_hours(spark):
    grid = [["指标", "D1", "D2", "总计"], ["日期", "2026-10-01", 46297], ["当日净大定数量", 80, True], ["累计小订转化率", "10%", 20]]
    got = {(r["metric"], r["step"]): (r["step_date"], r["value"]) for r in layout.tidy_launch_cells(sheet(spark, grid)).collect()}
    assert got["当日留存大定数量", "D1"] == (dt.date(2026, 10, 1), 80.0)
    assert got["当日留存大定数量", "D2"] == (dt.date(2026, 10, 2), None)
    assert got["累计小订转化率", "D2"][1] == pytest.approx(0.2)
    hours = [["指标", "H1", "H2", "H3", "H4"], ["时间", "2026-10-03 20:00", dt.datetime(2026, 10, 3, 22), "2026-10-04", "总计"], ["当日大定数量", 5, 6, 7, 18]]
    rows, rejected = layout.tidy_launch_hourly(sheet(spark, hours))
    assert sorted(r["ts"].hour for r in rows.collect()) == [20, 22]
    assert [r["text"] for r in rejected.collect()] == ["2026-10-04"]


def test_sku_blocks_own_their_periods(spark):
    grid = [["SKU", None, None, None, None, None, None, None, None, "累计锁单"],
            ["SKU", "版本", "外观", "内饰", "轮毂", "26WK01", "26WK02", "总计占比", None, "累计锁单", "26WK02", "26WK03", "总计"],
            ["S1", "a", "b", "c", "d", 0, 0.6, 0.3, None, "top3", 0.6, 0.9, 1], ["S2", "a", "b", "c", "e", 1, None, 0.7, None, "top5", 0.8, 1, 1]]
    share, topk = layout.tidy_sku_cells(sheet(spark, grid))
    assert {(r["code"], r["period"]): r["share"] for r in share.collect()} == {("S1", "26WK01"): 0.0, ("S1", "26WK02"): 0.6, ("S2", "26WK01"): 1.0}
    assert {(r["label"], r["period"]): r["share"] for r in topk.collect()} == {("TOP3", "26WK02"): 0.6, ("TOP3", "26WK03"): 0.9, ("TOP5", "26WK02"): 0.8, ("TOP5", "26WK03"): 1.0}


def test_combo_blocks(spark):
    grid = [["配置组合_外观内饰", None, None, None, None, None, "配置组合_轮毂"],
            ["累计锁单", "外观", "内饰", "26WK01", "总计", None, "累计锁单", "轮毂", "26WK01", "总计"],
            ["TOP1", "黑", "白", 0.5, 1, None, "TOP1", "19寸", 0.7, 1]]
    got = {r["title"]: (r["label"], r["share"]) for r in layout.tidy_combo_cells(sheet(spark, grid)).collect()}
    assert got == {"外观内饰": ("黑 × 白", 0.5), "轮毂": ("19寸", 0.7)}


def test_rank_sheet(spark):
    grid = [["代际", "排名", "26-07", "总计"], [], ["甲1", 1, "x", "遮阳帘 77.5% (3000)"], [None, 2, "x", "踏板"]]
    rows = layout.tidy_rank_cells(sheet(spark, grid)).orderBy("ord").collect()
    assert [(r["generation"], r["rank"], r["item_text"]) for r in rows] == [("甲1", 1, "遮阳帘 77.5% (3000)"), ("甲1", 2, "踏板")]


def test_parallel_blocks_need_a_gap(spark):
    apart = [["甲表", None, None, "乙表"], ["a", "b", None, "c"], [1, 2, None, 3]]
    close = [["甲表", None, "乙表"], ["a", "b", "c"], [1, 2, 3]]
    got = layout.split_parallel_blocks(sheet(spark, apart).unionByName(sheet(spark, close, name="close")))
    assert {(r["sheet"], r["title"], r["n"]) for r in got.groupBy("sheet", "title").agg(F.count("*").alias("n")).collect()} == {("s", "甲表", 5), ("s", "乙表", 3)}


def test_declared_coverage_and_raw(spark):
    df = sheet(spark, [["统计开始日期", "2026-01-01"], ["统计截止日期", "2026-06-30"], ["x", 1.0]])
    row = layout.declared_coverage(df).first()
    assert (row["start"], row["end"]) == (dt.date(2026, 1, 1), dt.date(2026, 6, 30))
    raw = layout.raw_tables(sheet(spark, [["标题"], ["a", "b"], [1.0, None, 2.5]])).orderBy("row").collect()
    assert [r["values"] for r in raw] == [{1: "a", 2: "b"}, {1: "1", 3: "2.5"}]


def test_forward_fill_across_chunks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("r"), F.when(F.col("id") % 300 == 7, F.col("id")).alias("v"))
    filled = ordered.forward_fill(df, ["v"], ["k"], "r", chunk=16)
    wrong = filled.filter("r >= 7 and v <> floor((r - 7) / 300) * 300 + 7 or r < 7 and v is not null or r >= 7 and v is null")
    assert wrong.count() == 0 and filled.count() == 1000
    counted = ordered.running_count(df, F.col("v").isNotNull(), "n", ["k"], "r", chunk=16)
    assert counted.filter("n <> case when r < 7 then 0 else floor((r - 7) / 300) + 1 end").count() == 0


def test_compressed_labels_keep_gaps(spark):
    labels = ["26WK01", "26WK02", "26WK04", "2026-01-01", "26/1/2", "D1", "D3", "TOP2", "TOP3", "其他"]
    df = spark.createDataFrame([("k", x) for x in labels + labels], "k string, l string")
    runs = {(r["kind"], r["first_label"], r["last_label"]) for r in ordered.compress_labels(df, ["k"], "l").collect()}
    assert runs == {("week", "26WK01", "26WK02"), ("week", "26WK04", "26WK04"), ("date", "2026-01-01", "2026-01-02"), ("D", "D1", "D1"), ("D", "D3", "D3"), ("TOP", "TOP2", "TOP3"), ("other", "其他", "其他")}


def test_scans_in_levels_hold_small_windows(spark):
    n = 5000
    rows = [("x", i, i // 7 if i % 7 == 3 else None) for i in range(n)] + [("y", i, i) for i in (5, 4097)] + [("y", 4999, None)]
    df = spark.createDataFrame(rows, "k string, r int, v int").repartition(5)
    filled = ordered.forward_fill(df, ["v"], ["k"], "r", chunk=4, most=n)
    counted = ordered.running_count(df, F.col("v").isNotNull(), "n", ["k"], "r", chunk=4, most=n)
    last = {}
    want_v, want_n = {}, {}
    for k, r, v in sorted(rows):
        seen, count = last.get(k, (None, 0))
        last[k] = (v if v is not None else seen, count + (v is not None))
        want_v[k, r], want_n[k, r] = last[k]
    assert {(r["k"], r["r"]): r["v"] for r in filled.collect()} == want_v
    assert {(r["k"], r["r"]): r["n"] for r in counted.collect()} == want_n
    # Every window is cut by the chunks of its level; only the top one, of at most 4 rows, is not.
    for frame in (filled, counted):
        cuts = re.findall(r"windowspecdefinition\(k#\d+[^,]*, (\w+)#\d+", frame._jdf.queryExecution().optimizedPlan().toString())
        parts = [c for c in cuts if c.startswith("_chunk")]
        assert len(set(parts)) >= 6
