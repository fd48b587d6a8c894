"""The stored index against a full scan."""

import tempfile

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from metricloom.sources import reports, search

ROWS = [
    (i, ["M7 旗舰", "m9", None, "", "Straße 😀 x", "a%b_c"][i % 6] if i % 7 else "m7m7m7 " * (i // 7 % 3), float(i % 5) if i % 4 else None, f"note {i // 10}")
    for i in range(300)
] + [(299, "long " + "ab" * 5000 + " needle-at-the-end", 1.0, "z"), (150, "M7", 2.0, "same"), (150, "M7", 2.0, "same")]


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(ROWS, "row int, block string, pos double, part string").repartition(5)
    return df, search.build_index(df, tempfile.mkdtemp(prefix="metricloom-test-") + "/index", "row")


def plain(df, query):
    return sorted(map(str, reports.search_rows(df, query).collect()))


@pytest.mark.parametrize("query", ["", "7", " M7 ", "旗", "旗舰", "😀", "note 1", "%b_", "needle-at-the-end", "m7m7m7 m7", "absent", "1.0", "\0"])
def test_index_equals_scan(tables, query):
    df, index = tables
    want = plain(df, query)
    assert sorted(map(str, index.search(query).collect())) == want
    assert index.total(query).first()["total"] == len(want)


@pytest.mark.parametrize("query", ["", "m7", "note 1", "absent"])
def test_pages_cover_all_rows_in_order(tables, query):
    df, index = tables
    seen = []
    for offset in range(0, 320, 70):
        seen += index.page(query, offset, 70).collect()
    assert [r["row"] for r in seen] == sorted(r["row"] for r in seen)
    assert sorted(map(str, seen)) == plain(df, query)
    assert len(index.page(query, 3, 5).collect()) == min(5, max(len(seen) - 3, 0))


def test_page_bounds(tables):
    for wrong in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            tables[1].page("m7", **wrong)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="mM79 a%b_旗舰note1", max_size=5))
def test_any_text(tables, query):
    df, index = tables
    assert sorted(map(str, index.search(query).collect())) == plain(df, query)


def test_reads_are_pruned(tables):
    index = tables[1]
    plan = index.search("旗舰版")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan, "ranges without a candidate are not read"
    assert "EqualTo(piece,旗舰版)" in plan or "In(piece" in plan, "other pieces are not read"


def test_empty_table(spark):
    df = spark.createDataFrame([], "row int, text string")
    index = search.build_index(df, tempfile.mkdtemp(prefix="metricloom-test-") + "/index", "row")
    assert index.page("x").collect() == [] and index.total("").first()["total"] == 0


def test_postings_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(search, "_STEP", 7)
    texts = ["Äb😀", "", None, "a", "ab", "\0a\0", "abcabcabcabcabcabc" * 9, "語語語語", "x" * 50] * 20
    df = spark.createDataFrame([(i, t, "K" if i % 3 else None) for i, t in enumerate(texts)], "row int, text string, `k.k` string")
    index = search.build_index(df, tempfile.mkdtemp(prefix="metricloom-test-") + "/index", "row")
    want = {}
    for r in index.rows.collect():
        for c in df.columns:
            t = "" if r["row"][c] is None else str(r["row"][c]).lower()
            for i in range(len(t)):
                key = (t + "\0\0")[i : i + 3], c, r["part"], r["block"]
                want[key] = want.get(key, 0) | 1 << r["pos"] % search.BLOCK
    got = {tuple(r)[:4]: r["bits"] % (1 << 64) for r in index.postings.select("piece", "column", "part", "block", "bits").collect()}
    assert got == want and index.postings.count() == len(want)


def test_a_task_makes_one_posting_per_piece_and_block():
    columns = {"part": pa.array([0] * 64, pa.int32()), "block": [7] * 64, "bit": list(range(64)), "text0": ["abc"] * 63 + ["abd"]}
    made = [r for b in search._postings(["text"])(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    assert {r["piece"]: r["bits"] % (1 << 64) for r in made} == {"abc": (1 << 63) - 1, "bc\0": (1 << 63) - 1, "c\0\0": (1 << 63) - 1, "abd": 1 << 63, "bd\0": 1 << 63, "d\0\0": 1 << 63}
    assert len(made) == 6
