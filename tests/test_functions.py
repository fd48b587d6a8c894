import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import lit, value_of
from metricloom.functions import names, numbers, periods, text
from metricloom.sources.reports import classify_report


def test_text(spark):
    assert value_of(spark, text.clean_text(lit(" a‑b　 c\n"))) == "a-b c"
    assert value_of(spark, text.compact_text(lit("a b c"))) == "abc"
    assert value_of(spark, text.compact_identifier(lit("A_b（C）-d"))) == "abcd"
    assert value_of(spark, text.header_key(lit("整体 - 小订退 %"))) == "整体小订退"


@pytest.mark.parametrize("raw, expected", [
    ("1,234.5", 1234.5), ("(12)", -12.0), ("12.5%", 0.125), ("￥3,000元", 3000.0), ("5万元", 5.0), ("RMB 7", 7.0),
    ("n/a", None), ("", None), (None, None), ("-3", -3.0),
])
def test_norm_number(spark, raw, expected):
    assert value_of(spark, numbers.norm_number(lit(raw).cast("string"))) == expected


def test_rates(spark):
    none = lit(None).cast("string")
    assert value_of(spark, numbers.norm_rate(lit("45"))) == 0.45
    assert value_of(spark, numbers.norm_rate(lit("45%"))) == 0.45
    assert value_of(spark, numbers.norm_rate(none, lit(45.0), lit("General"))) == 0.45
    assert value_of(spark, numbers.norm_rate(none, lit(2.0), lit("0%"))) == 2.0
    assert value_of(spark, numbers.strict_rate(lit("87.7%"))) == pytest.approx(0.877)
    assert value_of(spark, numbers.strict_rate(lit("150%"))) is None
    assert value_of(spark, numbers.strict_number(lit("-2"))) is None
    assert value_of(spark, numbers.strict_number(lit("12%"))) is None
    assert value_of(spark, numbers.observed(lit(float("nan")))) is None
    assert value_of(spark, numbers.observed(lit(0.0))) == 0.0
    assert value_of(spark, numbers.safe_rate(lit(1.0), lit(0.0))) == 0.0
    assert value_of(spark, numbers.observed_rate(lit(1.0), lit(0.0))) is None
    assert value_of(spark, numbers.relative_change(lit(1.0), lit(-2.0))) == 1.5


def test_complete_sum_keeps_unknown(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 0.0)], "k string, v double")
    got = dict(df.groupBy("k").agg(numbers.complete_sum(F.col("v"))).collect())
    assert got == {"a": None, "b": 1.0}


def test_iso_week(spark):
    week = value_of(spark, periods.iso_week(lit("2026wk01")))
    assert (week["label"], week["start"], week["boundary"]) == ("26WK01", dt.date(2025, 12, 29), "year")
    assert value_of(spark, periods.iso_week(lit("26WK27")))["boundary"] == "half"
    assert value_of(spark, periods.iso_week(lit("26WK26")))["boundary"] is None
    assert value_of(spark, periods.iso_week(lit("25WK53"))) is None
    assert value_of(spark, periods.iso_week(lit("26-05"))) is None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(day=st.dates(dt.date(2000, 1, 3), dt.date(2098, 12, 31)))
def test_week_labels_match_the_calendar(spark, day):
    year, week, _ = day.isocalendar()
    label = value_of(spark, periods.week_label(lit(day)))
    assert label == f"{year % 100:02d}WK{week:02d}"
    back = value_of(spark, periods.iso_week(lit(label)))
    assert back["start"] == dt.date.fromisocalendar(year, week, 1)


def test_day_keys(spark):
    for raw in ("2026/4/2", "26-04-02", "2026年4月2日", "2026.04.02", "2026-04-02 00:00:00"):
        assert value_of(spark, periods.day_key(lit(raw))) == dt.date(2026, 4, 2), raw
    assert value_of(spark, periods.day_key(lit(None).cast("string"), lit(46114.0))) == dt.date(2026, 4, 2)
    assert value_of(spark, periods.day_key(lit("2026-02-30"))) is None


def test_summary_periods_have_four_meanings(spark):
    def judged(label):
        return tuple(value_of(spark, periods.is_summary_period(lit(label), v)) for v in ("parse", "page", "channel", "conflict"))
    assert judged("总计") == (True, True, True, True)
    assert judged("近7天") == (True, True, True, True)
    assert judged("近况") == (False, True, False, False)
    assert judged("合计") == (True, False, True, True)
    assert judged("总计占比") == (False, True, True, True)


def test_annotation_keys(spark):
    assert value_of(spark, periods.annotation_key(lit("2024-12-30"), "week")) == "2025-WK01"
    assert value_of(spark, periods.annotation_key(lit("2024-02-30"), "day")) is None
    assert value_of(spark, periods.chart_period_key(lit("25-WK1"), "week")) == "2025-WK01"
    assert value_of(spark, periods.chart_period_key(lit("25年3月"), "month")) == "2025-03"


def test_names(spark):
    rules = names.NamingRules(group="某集团", brands=("甲界",))
    def subject(s):
        return value_of(spark, names.sheet_subject(lit(s), rules))
    assert subject("甲界 M9 2026款by周第2期图表") == "甲界 M9 2026款"
    assert subject("甲界 M9 2026款总计_专项") == "甲界 M9 2026款总计"
    assert subject("甲界_SKU") == "甲界"
    assert subject("某集团-专题") == "某集团"
    assert value_of(spark, names.grain_from_name(lit("甲界by周"))) == "week"
    assert value_of(spark, names.phase_number(lit("甲界by天第 2 期"))) == 2
    assert value_of(spark, names.subject_type(lit("甲界 V680&V800"), rules)) == "generation"
    assert value_of(spark, names.subject_parent(lit("甲界 M9 2026款"), lit("generation"), rules)) == "甲界"
    assert value_of(spark, names.is_subject(lit("甲界交车锁单"), rules)) is False
    assert value_of(spark, names.is_subject(lit("甲界M9"), rules)) is True
    assert value_of(spark, names.is_combined_generation(lit("甲界 A&B"))) is True
    assert value_of(spark, names.family_key(lit("甲界 R7 增程 2026款"))) == value_of(spark, names.family_key(lit("甲界 R7 纯电 2025款")))
    assert value_of(spark, names.short_name(lit("甲界 S800 2026款 Ultimate"), rules)) == "S800U 26"
    assert value_of(spark, names.stage_label(lit("甲界 M9 预售"), lit("甲界 M9"))) == "预售"


def test_rank_items_and_bands(spark):
    item = value_of(spark, names.parse_rank_item(lit("遮阳帘 77.5%\n(3,000)")))
    assert (item["label"], item["rate"], item["amount"]) == ("遮阳帘", pytest.approx(0.775), 3000.0)
    assert value_of(spark, names.parse_rank_item(lit("普通项")))["rate"] is None
    for raw, band in (("0", "免费"), ("免费选配", "免费"), ("0-5000元", "0-5000"), ("5000以下", "0-5000"), ("30000以上", "30000-以上"), ("10000至20000", "10000-20000")):
        assert value_of(spark, names.normalize_band(lit(raw))) == band, raw
    assert value_of(spark, names.is_amount_band(lit("订单数量"))) is False


def test_hour_timestamp(spark):
    none = lit(None).cast("string")
    for c in (names.hour_timestamp(lit("2026年10月3日 20：00")), names.hour_timestamp(none, lit(46298 + 20 / 24))):
        assert value_of(spark, c) == dt.datetime(2026, 10, 3, 20, 0)
    assert value_of(spark, names.hour_timestamp(none, lit(46298 - 1462 + 20 / 24), lit(True))) == dt.datetime(2026, 10, 3, 20, 0)
    assert value_of(spark, names.hour_timestamp(lit("2026-10-03"))) is None


def test_classify_report(spark):
    assert value_of(spark, classify_report(lit("2026大定选配比例.xlsx"))) == "order_mix"
    assert value_of(spark, classify_report(lit("其他.xlsx"))) is None
