import datetime as dt
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import make, observations
from metricloom import schemas
from metricloom.sources import reports
from metricloom.streaming import refresh, rhythm

KEY_VALUE = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="metricloom-test-")


def test_read_reports(spark, folder):
    for name, text in (("b.csv", "k,v\nx,2\n"), ("a.csv", "k,v\nx,1\n"), ("~$a.csv", "k,v\nx,9\n"), ("skip.csv", "k,v\nx,9\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    schema = KEY_VALUE
    rows = reports.read_reports(spark, folder, schema, exclude=["skip.csv"]).orderBy("source_order").collect()
    assert [(r["source_file"], r["source_order"], r["v"]) for r in rows] == [("a.csv", 0, 1), ("b.csv", 1, 2)]


def test_bad_report_fails(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write("k,v\nx,notanumber\n")
    with pytest.raises(Exception):
        reports.read_reports(spark, folder, KEY_VALUE).collect()


def test_search_and_export(spark, folder):
    df = spark.createDataFrame([(1, "M7", 0.0), (2, "M9", 12.0), (3, "M7 旗舰", 25.5), (4, '引号,"x"', None)], "row int, model string, n double")
    assert [r["row"] for r in reports.search_page(df, " m7 ", "row").collect()] == [1, 3]
    assert [r["row"] for r in reports.search_page(df, "", "row", offset=1, limit=2).collect()] == [2, 3]
    for wrong in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            reports.search_page(df, "", "row", **wrong)
    assert reports.search_total(df, "12").first()["total"] == 1
    reports.export_csv(df, folder + "/out")
    back = spark.read.option("header", True).option("escape", '"').csv(folder + "/out")
    assert {r["row"]: (r["model"], r["n"]) for r in back.collect()} == {"1": ("M7", "0"), "2": ("M9", "12"), "3": ("M7 旗舰", "25.5"), "4": ('引号,"x"', None)}


def test_publish_switches_last(spark, folder):
    df = spark.createDataFrame([("overview", "M", 1.0)], "module string, subject string, value double")
    reports.publish(df, folder, "b1")
    reports.publish(df.withColumn("value", F.lit(2.0)), folder, "b2")
    assert reports.read_published(spark, folder, "overview", "M").first()["value"] == 2.0
    assert reports.read_published(spark, folder, batch_id="b1").first()["value"] == 1.0
    with pytest.raises(Exception):
        reports.publish(df, folder, "b2")
    assert reports.current_batch(spark, folder) == "b2"


def test_one_of_two_publishers_is_refused_and_readers_keep_their_batch(spark, folder):
    df = spark.createDataFrame([("overview", "M", 1.0)], "module string, subject string, value double")
    assert reports.published_version(spark, folder) == 0 and reports.current_batch(spark, folder) is None
    assert reports.publish(df, folder, "a") == 1
    held = reports.pin_batch(spark, folder, "reader", 1)
    old = reports.read_published(spark, folder, batch_id=held)
    assert reports.publish(df.withColumn("value", F.lit(2.0)), folder, "b", seen=1) == 2
    # Begun at the same number: refused before its data are written.
    with pytest.raises(reports.PublishConflict):
        reports.publish(df, folder, "late", seen=1)
    assert not os.path.exists(f"{folder}/batch_id=late") and reports.current_batch(spark, folder) == "b"
    # Its number is taken while its data are written: refused by the pointer.
    slow = df.withColumn("value", F.lit(9.0))
    first = reports.published_version
    reports.published_version = lambda *a: 1
    try:
        with pytest.raises(reports.PublishConflict):
            reports.publish(slow, folder, "slow")
    finally:
        reports.published_version = first
    assert reports.current_batch(spark, folder) == "b"
    for name in ("c", "d"):
        reports.publish(df, folder, name)
    # a is held, d and c are the last two.
    assert [r["batch_id"] for r in reports.expired_batches(spark, folder, 2).collect()] == ["b"]
    assert reports.remove_expired(spark, folder, 2) == ["b"] and reports.remove_expired(spark, folder, 2) == []
    assert old.first()["value"] == 1.0 and reports.publish(df, folder, "e") == 5
    with pytest.raises(ValueError):
        reports.expired_batches(spark, folder, 0)


def manifest(spark, rows):
    return spark.createDataFrame([(n, s, dt.datetime(2026, 1, 1, h)) for n, s, h in rows], "name string, size bigint, mtime timestamp")


def test_manifest_and_marker(spark):
    before = manifest(spark, [("a", 1, 1), ("b", 1, 1), ("done", 0, 2)])
    now = manifest(spark, [("a", 2, 3), ("c", 1, 3), ("done", 0, 4)])
    assert {r["name"]: r["change"] for r in reports.diff_manifest(now, before).collect()} == {"a": "changed", "c": "added", "b": "deleted", "done": "changed"}
    assert reports.ready_batches(now, before, "done").first()["ready"]
    stale = manifest(spark, [("a", 2, 3), ("b", 1, 1), ("done", 0, 2)])
    assert not reports.ready_batches(stale, before, "done").first()["ready"]
    unmarked = manifest(spark, [("a", 2, 3)])
    assert reports.ready_batches(unmarked, before, "none").first()["ready"]


def test_campaigns(spark):
    raw = spark.createDataFrame([("甲界 M9", "甲界 M9 预售", "x"), ("", "y", "z"), ("乙界 S8", None, None)], "`代际名` string, `二级代际名` string, `小订发布时间` string")
    got = {r["label"]: (r["brand"], r["小订发布时段"]) for r in reports.load_campaigns(raw).collect()}
    assert got == {"甲界 M9 预售": ("甲界", "x"), "乙界 S8": ("乙界", None)}


def test_stream_equals_batch(spark, folder):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("subject", F.col("user_id").cast("string"))
    events.repartition(3).write.parquet(folder + "/in")
    stream = spark.readStream.schema(events.schema).parquet(folder + "/in")
    # A marker event far in the future pushes the watermark past the last hour.
    late = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("event_type", F.lit("purchase"))
    query = (rhythm.stream_hourly(stream, "60 days").writeStream.format("parquet").option("path", folder + "/out")
             .option("checkpointLocation", folder + "/cp").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    late.write.mode("append").parquet(folder + "/in")
    query = (rhythm.stream_hourly(stream, "60 days").writeStream.format("parquet").option("path", folder + "/out")
             .option("checkpointLocation", folder + "/cp").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    batch = rhythm.hourly_counts(events)
    got = spark.read.parquet(folder + "/out")
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


RANGES = [
    {"source_order": 0, "start": dt.date(2026, 7, 1), "end": dt.date(2026, 12, 31)}, {"source_order": 1, "start": dt.date(2027, 1, 1), "end": dt.date(2027, 6, 30)},
    {"source_order": 2, "start": dt.date(2026, 1, 1), "end": dt.date(2026, 6, 30)},
]


def export(spark, folder, name, rows, order):
    """One export as one file, so that it can be rewritten under its name."""
    made = tempfile.mkdtemp(dir=folder)
    observations(spark, rows, source_order=order).coalesce(1).write.mode("overwrite").parquet(made)
    [part] = [n for n in os.listdir(made) if n.startswith("part-")]
    shutil.copyfile(f"{made}/{part}", f"{folder}/in/{name}")


def test_refresh_replaces_and_withdraws(spark, folder):
    os.mkdir(folder + "/in")
    coverage_of = lambda read: make(spark, schemas.COVERAGE, RANGES).join(read.select("source_order").distinct(), "source_order", "left_semi")

    def run():
        refresh.stream_refresh(spark, folder + "/in", folder + "/cp", folder + "/out", coverage_of, marker="done.ready").awaitTermination()
        return refresh.current_version(spark, folder + "/out")

    def values(version=None):
        return {r["period"]: r["value"] for r in refresh.latest_results(spark, folder + "/out", version).collect()}

    export(spark, folder, "a.parquet", [{"metric": "大定", "period": "26WK53", "value": 140.0}, {"metric": "大定", "period": "26WK40", "value": 7.0}], 0)
    export(spark, folder, "c.parquet", [{"metric": "大定", "period": "26WK10", "value": 3.0}, {"metric": "大定", "period": "26WK40", "value": 9.0}], 2)
    assert run() == 1 and values() == {"26WK53": 140.0, "26WK40": 7.0, "26WK10": 3.0}
    # An unchanged folder starts no batch and makes no version.
    assert run() == 1
    export(spark, folder, "b.parquet", [{"metric": "大定", "period": "26WK53", "value": 90.0}], 1)
    assert run() == 2 and values() == {"26WK53": 230.0, "26WK40": 7.0, "26WK10": 3.0}
    # Rewritten under its name: one key changes, one is new, one is left to the other export.
    export(spark, folder, "a.parquet", [{"metric": "大定", "period": "26WK53", "value": 100.0}, {"metric": "大定", "period": "26WK41", "value": 1.0}], 0)
    assert run() == 3 and values() == {"26WK53": 190.0, "26WK41": 1.0, "26WK40": 9.0, "26WK10": 3.0}
    os.remove(folder + "/in/c.parquet")
    assert run() == 4 and values() == {"26WK53": 190.0, "26WK41": 1.0}
    # A reader that holds a version sees it unchanged.
    assert values(2) == {"26WK53": 230.0, "26WK40": 7.0, "26WK10": 3.0}
    # Added, rewritten and deleted at once, behind a marker that must be newest.
    with open(folder + "/in/done.ready", "w"):
        pass
    os.utime(folder + "/in/done.ready", (1, 1))
    export(spark, folder, "d.parquet", [{"metric": "大定", "period": "26WK20", "value": 5.0}], 2)
    export(spark, folder, "a.parquet", [{"metric": "大定", "period": "26WK41", "value": 2.0}], 0)
    os.remove(folder + "/in/b.parquet")
    assert run() == 4 and refresh.refresh_folder(spark, folder + "/in", folder + "/out", coverage_of, marker="done.ready") is None
    os.utime(folder + "/in/done.ready")
    assert run() == 5 and values() == {"26WK41": 2.0, "26WK20": 5.0}
    assert run() == 5
    for name in ("a", "d"):
        os.remove(f"{folder}/in/{name}.parquet")
    os.utime(folder + "/in/done.ready", (2**31, 2**31))
    assert run() == 6 and values() == {}


def test_second_refresh_of_a_version_is_refused(spark, folder, monkeypatch):
    os.mkdir(folder + "/in")
    coverage_of = lambda read: make(spark, schemas.COVERAGE, RANGES)
    export(spark, folder, "a.parquet", [{"metric": "大定", "period": "26WK40", "value": 7.0}], 0)
    refresh.refresh_folder(spark, folder + "/in", folder + "/out", coverage_of)
    # Another one that started before the first was done.
    monkeypatch.setattr(refresh, "current_version", lambda *_: 0)
    with pytest.raises(Exception, match="(?i)already exists"):
        refresh.refresh_folder(spark, folder + "/in", folder + "/out", coverage_of)
    monkeypatch.undo()
    assert refresh.latest_results(spark, folder + "/out").first()["value"] == 7.0


def test_batch_of_all_analyses(spark, folder):
    from metricloom.plans.registry import build_all, run_batch

    rows = [{"report": r, "metric": m, "period": p, "value": v, "grain": "day"}
            for p, v in (("2026-01-01", 4.0), ("2026-01-02", 6.0)) for r, m in (("order_mix", "大定"), ("lock_mix", "交车锁单"))]
    obs = observations(spark, rows).withColumn("period_start", F.to_date("period"))
    cohorts = make(spark, schemas.COHORTS, [{"subject": "M", "grain": "week", "period": "26WK01", **{f"s{i}": 10.0 - i for i in range(1, 8)}}])
    tables = {"observations": obs, "cohorts": cohorts}
    assert {r["module"] for r in build_all(tables).select("module").distinct().collect()} == {"overview", "conversion"}
    run_batch(tables, folder, "b1")
    shown = reports.read_published(spark, folder, "overview", "M").filter("label = '大定' and period = '2026-01-02'").first()
    assert shown["value"] == 6.0 and shown["comparison"]["rate"] == 0.5


def test_select_sheet(spark):
    obs = observations(spark, [{"metric": "大定", "period": "26WK01", "value": 1.0, "source_sheet": s} for s in ("甲 M9by周", "甲 M9by周图表")], subject="甲 M9")
    assert reports.select_sheet(obs, "大定选配比例", "甲M9", "week").count() == 1
    assert reports.select_sheet(obs, "大定选配比例", "甲M9", "week", suffix="图表", charts=True).count() == 1
