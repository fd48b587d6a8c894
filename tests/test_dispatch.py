import datetime as dt

import pytest

from helpers import sheet
from metricloom.functions.names import NamingRules
from metricloom.operators import merge
from metricloom.plans.dispatch import Dispatch

RULES = NamingRules(group="ALL", brands=("甲界",))


def mix(days, weeks, first, second, retained):
    """A daily and a weekly sheet of an order report."""
    daily = [["", "", "", *days], ["大定", "数量", "数量", *[1.0] * len(days)], ["净大定", "数量", "数量", *[0.0] * len(days)]]
    weekly = [
        ["", "", "", *weeks], ["大定", "数量", "数量", *first], ["净大定", "数量", "数量", *retained],
        ["门店类型", "数量", "A", *second], [None, None, "B", *[a - b for a, b in zip(first, second, strict=True)]],
        ["门店类型", "占比", "A", *[b / a for a, b in zip(first, second, strict=True)]], [None, None, "B", *[1 - b / a for a, b in zip(first, second, strict=True)]],
    ]
    return daily, weekly


@pytest.fixture(scope="module")
def dispatch(spark):
    parts = []
    old, new = "2026H2大定选配比例.xlsx", "2027H1大定选配比例.xlsx"
    for file, days, weeks, values in (
        (old, ["2026-07-01", "2026-12-30", "2026-12-31"], ["26WK52", "26WK53"], ([50.0, 30.0], [20.0, 10.0], [40.0, 25.0])),
        (new, ["2027-01-01", "2027-01-03", "2027-06-30"], ["26WK53", "27WK01"], ([20.0, 60.0], [12.0, 30.0], [15.0, 50.0])),
    ):
        for grain, grid in zip(("天", "周"), mix(days, weeks, *values), strict=True):
            parts.append(sheet(spark, grid, file, f"甲界by{grain}"))
    lock = [["", "", "", "26WK52", "26WK53", "27WK01"], ["交车锁单", "数量", "数量", 9.0, 8.0, 7.0]]
    parts.append(sheet(spark, lock, "2026锁单选配比例.xlsx", "甲界by周"))
    # Another export of the second half year knows a day that the first leaves out.
    parts.append(sheet(spark, [["", "", "", "2026-07-01", "2026-08-01", "2026-12-31"], ["大定", "数量", "数量", 1.0, 5.0, 1.0]], "2026补大定选配比例.xlsx", "甲界by天"))
    chart = [["甲界", None, None], [None, "甲界周留存大定", "26WK52"], [None, "F", 0.5], [None, "总计", 41.0]]
    parts.append(sheet(spark, chart, new, "甲界by周图表"))
    hours = [["小订日期", "小订小时", "小订数", "总退订数"], ["2026-07-01", "13时", 4.0, 1.0], ["2026-07-01", 14, 6.0, 2.0]]
    parts += [sheet(spark, hours, "2026小订退订.xlsx", "甲界_小订分时退订"), sheet(spark, [hours[0], ["2026/07/01", "13", 9.0, 9.0], ["2026-07-02", "0", 1.0, 0.0]], "2027小订退订.xlsx", "甲界_小订分时退订")]
    parts.append(sheet(spark, [["说明"], ["a", "b"]], "其他.xlsx", "随便"))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    return Dispatch(cells, RULES)


def test_sheets_get_their_layouts(dispatch):
    got = {(r["file"][:6], r["sheet"]): (r["layout"], r["subject"], r["grain"]) for r in dispatch.sheets.collect()}
    assert got["2026H2", "甲界by天"] == ("matrix", "甲界", "day") and got["2027H1", "甲界by周图表"] == ("chart", "甲界", "week")
    assert got["2026小订", "甲界_小订分时退订"] == ("hourly", "甲界", None) and got["其他.xls", "随便"][0] is None
    files = {r["file"]: r["source_order"] for r in dispatch.sheets.collect()}
    assert [f for f, _ in sorted(files.items())] == [f for f, _ in sorted(files.items(), key=lambda x: x[1])]


def test_merged_matrix_has_zeros_weeks_and_ratios(dispatch):
    spans = {(r["start"], r["end"]) for r in dispatch.coverage.collect()}
    assert (dt.date(2026, 7, 1), dt.date(2026, 12, 31)) in spans and (dt.date(2027, 1, 1), dt.date(2027, 6, 30)) in spans
    got = {(r["report"], r["grain"], r["period"], r["metric"], r["stat"], r["category"]): r["value"] for r in dispatch.observations.collect()}
    week = ("order_mix", "week", "26WK53")
    # Three exports could show the week, two do; their pieces adjoin and add up.
    assert got[*week, "大定", "数量", "数量"] == 50.0 and got[*week, "留存大定", "数量", "数量"] == 40.0
    assert got[*week, "门店类型", "数量", "B"] == 28.0 and got[*week, "门店类型", "占比", "B"] == pytest.approx(0.56)
    # The half-year export proves 0 for the day that only the other one has; its value comes first.
    assert got["order_mix", "day", "2026-08-01", "大定", "数量", "数量"] == 0.0


def test_overview_takes_chart_totals(dispatch):
    got = {(r["grain"], r["period"]): (r["orders"], r["retained"], r["locked"]) for r in dispatch.overview.collect()}
    assert got == {("week", "26WK52"): (50.0, 41.0, 9.0), ("week", "26WK53"): (50.0, 40.0, 8.0), ("week", "27WK01"): (60.0, 50.0, 7.0)}


def test_records_and_separate_sheets(dispatch):
    got = {(str(r["date"]), r["hour"]): (r["orders"], r["cancel"]) for r in dispatch.hourly.collect()}
    assert got == {("2026-07-01", 13): (4.0, 1.0), ("2026-07-01", 14): (6.0, 2.0), ("2026-07-02", 0): (1.0, 0.0)}
    assert {r["file"] for r in dispatch.separate.collect()} == {"其他.xlsx"}


def test_lost_cells_are_reported_by_runs_and_rectangles(spark):
    weeks = ["26WK10", "26WK11", "26WK12", "26WK20"]
    grid = lambda a, b: [["", "", "", *weeks], ["大定", "数量", "数量", *a], ["净大定", "数量", "数量", *b]]
    cells = sheet(spark, grid([1.0, 2.0, 3.0, 4.0], [5.0, 5.0, 5.0, 5.0]), "1大定选配比例.xlsx", "甲界by周")
    cells = cells.unionByName(sheet(spark, grid([9.0, 9.0, 9.0, 4.0], [5.0, 6.0, 6.0, 7.0]), "2大定选配比例.xlsx", "甲界by周"))
    read = Dispatch(cells, RULES)
    found = merge.conflicts(read.pieces, merge.merge_sources(read.pieces, read.coverage), read.coverage)
    got = {r["metric"]: r for r in merge.conflict_report(found).collect()}
    assert got["大定"]["ranges"] == "26WK10～26WK12" and got["留存大定"]["ranges"] == "26WK11～26WK12、26WK20"
    assert [(e["period"], e["kept_value"], e["lost_value"]) for e in got["大定"]["examples"]] == [("26WK10", 1.0, 9.0), ("26WK11", 2.0, 9.0), ("26WK12", 3.0, 9.0)]
    boxes = {(r["metric"], r["sheet"], r["row_first"], r["row_last"], r["col_first"], r["col_last"]) for r in merge.conflict_cells(found).collect()}
    assert boxes == {("大定", "甲界by周", 2, 2, 4, 6), ("留存大定", "甲界by周", 3, 3, 5, 7)}
