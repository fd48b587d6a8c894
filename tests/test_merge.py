import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from helpers import make, observations
from metricloom import schemas
from metricloom.operators import coverage, merge


def spans(spark, *pairs):
    return make(spark, schemas.COVERAGE, [
        {"source_file": f"f{i}", "source_order": i, "start": dt.date.fromisoformat(a), "end": dt.date.fromisoformat(b)}
        for i, (a, b) in enumerate(pairs) if a
    ])


YEAR_CUT = (("2026-07-01", "2026-12-31"), ("2027-01-01", "2027-06-30"))


def merged(spark, pieces, period="26WK53", ranges=YEAR_CUT, metric="大定"):
    """pieces: (file, value or text)."""
    rows = [
        {"metric": metric, "period": period, "source_order": f, "value": None if isinstance(v, str) else v, "raw": v if isinstance(v, str) else None}
        for f, v in pieces
    ]
    return merge.merge_sources(observations(spark, rows), spans(spark, *ranges)).first()


@pytest.mark.parametrize("pieces, expected", [
    ([(0, 140.0), (1, 90.0)], 230.0),
    ([(0, 140.0), (1, 90.0), (0, 140.0), (1, 230.0)], 230.0),
    ([(0, 0.0), (1, 90.0)], 90.0),
    ([(0, 140.0), (1, 140.0)], 140.0),
    ([(0, 140.0), (1, -1.0)], 140.0),
    ([(0, 140.0), (1, "text")], 140.0),
    ([(0, 140.0), (0, 90.0)], 140.0),
    ([(0, None), (1, 90.0)], 90.0),
])
def test_boundary_week_pieces(spark, pieces, expected):
    assert merged(spark, pieces)["value"] == expected


@pytest.mark.parametrize("period", ["26WK26", "26WK52", "27WK02"])
def test_other_weeks_are_never_added(spark, period):
    assert merged(spark, [(0, 140.0), (1, 90.0)], period)["value"] == 140.0


@pytest.mark.parametrize("ranges", [
    (("2026-07-01", "2027-01-05"), ("2027-01-01", "2027-06-30")),
    (("2026-07-01", "2026-12-30"), ("2027-01-01", "2027-06-30")),
    (("2026-07-01", "2026-12-31"), (None, None)),
])
def test_unproven_ranges_keep_the_first_value(spark, ranges):
    row = merged(spark, [(0, 140.0), (1, 90.0)], ranges=ranges)
    assert row["value"] == 140.0 and not row["added"]


def test_half_year_week(spark):
    cut = (("2026-01-01", "2026-06-30"), ("2026-07-01", "2026-12-31"))
    assert merged(spark, [(0, 140.0), (1, 90.0)], "26WK27", cut)["value"] == 230.0


def test_order_of_zero_union_does_not_matter(spark):
    for order in itertools.permutations([(0, 0.0), (1, 90.0)]):
        assert merged(spark, list(order))["value"] == 90.0


def test_first_value_wins_and_fills_blanks(spark):
    rows = []
    for f, values in ((0, {"2021": (0.0, 8.0), "2022": (None, None)}), (1, {"2021": (99.0, 8.0), "2022": (20.0, 18.0), "2023": (30.0, 28.0)})):
        for year, (a, b) in values.items():
            rows += [{"metric": "大定", "period": f"{year}-01-01", "value": a, "source_order": f, "grain": "day"},
                     {"metric": "净大定" if f == 0 else "留存大定", "period": f"{year}-01-01", "value": b, "source_order": f, "grain": "day"}]
    obs = observations(spark, rows + [{"metric": "大定", "period": "总计", "value": 5.0}])
    result = merge.merge_sources(obs, spans(spark))
    got = {(r["metric"], r["period"]): r["value"] for r in result.collect()}
    assert [got["大定", f"{y}-01-01"] for y in (2021, 2022, 2023)] == [0.0, 20.0, 30.0]
    assert [got["留存大定", f"{y}-01-01"] for y in (2021, 2022, 2023)] == [8.0, 18.0, 28.0]
    assert len(got) == 6
    lost = merge.conflicts(obs.filter("period <> '总计'"), result, spans(spark)).collect()
    assert [(r["kept_value"], r["lost_value"], r["kind"]) for r in lost] == [(0.0, 99.0, "cross file")]


def test_ratio_from_counts_and_from_weights(spark):
    def rows(f, n, share, counts):
        out = [{"metric": "大定", "value": n, "source_order": f}]
        out += [{"metric": "动力", "stat": "占比", "category": "增程", "value": share, "source_order": f}]
        out += [{"metric": "外观", "stat": "占比", "category": c, "value": v / n, "source_order": f} for c, v in counts.items()]
        out += [{"metric": "外观", "category": c, "value": v, "source_order": f} for c, v in counts.items()]
        return out
    obs = observations(spark, rows(0, 140.0, 0.4, {"黑": 56.0, "白": 84.0}) + rows(1, 90.0, 0.8, {"黑": 72.0, "白": 18.0}), period="26WK53")
    ranges = spans(spark, *YEAR_CUT)
    got = {(r["metric"], r["category"]): r["value"] for r in merge.merge_report(obs, ranges).filter("stat = '占比'").collect()}
    assert got["外观", "黑"] == pytest.approx(128 / 230)
    assert got["动力", "增程"] == pytest.approx((140 * 0.4 + 90 * 0.8) / 230)


@pytest.mark.parametrize("left, right, expected", [
    (0.0, 3.0, 3.0), (0.0, 0.0, 0.0), (2.0, 3.0, None), (None, 3.0, None), ("missing", 3.0, None), (1.5, 0.0, None),
])
def test_distinct_stores(spark, left, right, expected):
    rows = [{"metric": "大定", "value": 1.0, "source_order": f} for f in (0, 1)]
    rows += [{"metric": "门店类型", "stat": "贡献门店数", "category": "A", "value": v, "source_order": f}
             for f, v in ((0, left), (1, right)) if v != "missing"]
    judged = merge.merge_distinct_stores(observations(spark, rows, period="26WK53"), spans(spark, *YEAR_CUT)).first()
    assert judged["value"] == expected


def test_new_store_layout_beats_old_and_blank_is_unknown(spark):
    rows = [{"metric": "大定", "value": 1.0, "source_order": f} for f in (0, 1)]
    rows += [{"metric": "贡献订单门店数", "category": "A", "value": 0.0, "source_order": 0},
             {"metric": "门店类型", "stat": "贡献门店数", "category": "A", "value": None, "source_order": 0},
             {"metric": "门店类型", "stat": "贡献门店数", "category": "A", "value": 4.0, "source_order": 1}]
    judged = merge.merge_distinct_stores(observations(spark, rows, period="26WK53"), spans(spark, *YEAR_CUT)).first()
    assert judged["value"] is None and judged["reason"] == "unknown side"


def test_extra_source_is_not_merged(spark):
    ranges = (*YEAR_CUT, ("2026-12-01", "2027-02-01"))
    rows = [{"metric": "门店类型", "stat": "贡献门店数", "category": "A", "value": v, "source_order": f} for f, v in ((0, 0.0), (1, 3.0), (2, 3.0))]
    judged = merge.merge_distinct_stores(observations(spark, rows, period="26WK53"), spans(spark, *ranges)).first()
    assert judged["value"] is None and judged["reason"] == "extra source"


def test_coverage_tiers(spark):
    obs = observations(spark, [{"metric": "大定", "period": p, "value": v} for p, v in (("2026-01-03", 0.0), ("2026-01-09", 4.0), ("2026-01-12", None))], grain="day")
    chart = make(spark, schemas.CHART_OBS, [
        {"grain": "day", "period": "2025-01-01", "value": 1.0, "source_order": 0}, {"grain": "day", "period": "2025-02-01", "value": 1.0, "source_order": 7}])
    got = {r["source_order"]: (r["start"], r["end"]) for r in coverage.source_coverage(obs, chart).collect()}
    assert got == {0: (dt.date(2026, 1, 3), dt.date(2026, 1, 9)), 7: (dt.date(2025, 2, 1), dt.date(2025, 2, 1))}


def test_chart_merge(spark):
    rows = []
    for f, total, rate in ((0, 140.0, 0.4), (1, 90.0, 0.8)):
        rows += [{"report": "r", "subject": "M", "grain": "week", "period": "26WK53", "value": total, "source_order": f, "row_ord": 1},
                 {"report": "r", "subject": "M", "grain": "week", "period": "26WK53", "series": "增程", "value": rate, "source_order": f, "row_ord": 2}]
    rows.append({"report": "r", "subject": "M", "grain": "week", "period": "26WK40", "series": "增程", "value": None, "source_order": 0, "row_ord": 2})
    result = merge.merge_chart(make(spark, schemas.CHART_OBS, rows), spans(spark, *YEAR_CUT))
    got = {(r["series"], r["period"]): r["value"] for r in result.collect()}
    assert got[None, "26WK53"] == 230.0 and got["增程", "26WK53"] == pytest.approx((140 * 0.4 + 90 * 0.8) / 230)
    assert got["增程", "26WK40"] == 0.0


def test_many_copies_of_one_key(spark):
    """A third of all rows on one key, in two proven halves, still adds exactly once."""
    obs = spark.range(30000).select(
        F.lit("大定选配比例").alias("report"), F.lit("M").alias("subject"), F.lit("week").alias("grain"),
        F.when(F.col("id") % 3 == 0, "26WK53").otherwise(F.concat(F.lit("26WK"), F.lpad((F.col("id") % 40 + 1).cast("string"), 2, "0"))).alias("period"),
        F.lit("大定").alias("metric"), F.lit("数量").alias("stat"), F.lit("数量").alias("category"),
        F.when(F.col("id") % 2 == 0, 140.0).otherwise(90.0).alias("value"), F.lit(None).cast("string").alias("raw"), F.lit("0").alias("fmt"),
        (F.col("id") % 2).cast("int").alias("source_order"), F.lit(1).alias("row_ord"),
    )
    row = merge.merge_sources(obs, spans(spark, *YEAR_CUT)).filter("period = '26WK53'").first()
    assert row["value"] == 230.0
