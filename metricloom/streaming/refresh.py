"""Incremental refresh of merged results from a folder of exports.

A refresh compares the folder with the manifest of the last version. Only added and rewritten exports
are read; what they and the deleted ones touch is recomputed, and one new version replaces or withdraws
it. Under ``root`` lie Parquet tables, each partitioned by version:

========== ==========================================================================================
store       rows of the exports read in that version, partitioned by bucket of their key
file_keys   which keys an export had in that version
spans       proven range of each export of that version
results     merged rows of every bucket that the version changed, partitioned by bucket
snapshot    for each bucket the version that holds its current results
manifest    the exports with size, time and the version that stored their rows; written last
========== ==========================================================================================

A version without manifest does not exist, so a broken run leaves the last one readable and the next run
writes over its remains. Of two refreshes of the same version the second to write the manifest fails.
Readers open one folder per bucket, however many versions there are.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from ..operators.merge import merge_report, unify_labels
from ..schemas import OBSERVATIONS
from .changes import difference, listing, read_changes

KEYS = ["report", "subject", "grain", "period"]
#: Parts of store and results; a change rewrites the parts that its keys fall into.
BUCKETS = 64


def affected_keys(new_rows: DataFrame) -> DataFrame:
    """Report, subject and period of every new row; boundary weeks need no widening because
    all files of the same week share the period key."""
    return unify_labels(new_rows).select(*KEYS).distinct()


def refresh_batch(all_rows: DataFrame, keys: DataFrame, coverage: DataFrame) -> DataFrame:
    """Merged result of the affected keys from all stored rows."""
    touched = unify_labels(all_rows).join(keys, KEYS, "left_semi")
    return merge_report(touched, coverage)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/{table}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the last complete version; 0 before the first."""
    manifests = _read(spark, root, "manifest")
    return 0 if manifests is None else manifests.agg(F.max("version")).first()[0] or 0


def manifest(spark: SparkSession, root: str, version: int) -> dict[str, tuple]:
    """Export name -> size, time, version that stored its rows. One entry per export, on the driver."""
    if version == 0:
        return {}
    rows = spark.read.parquet(f"{root}/manifest").filter(F.col("version") == version).filter("name is not null")
    return {r["name"]: (r["size"], r["mtime"], r["stored"]) for r in rows.collect()}


def ready(now: dict, before: dict, marker: str) -> bool:
    """Whether a completion marker allows a refresh: it must be as new as every export, and where
    exports changed it must have moved since the last version."""
    if marker not in now:
        return True
    exports = [t for n, (_, t) in now.items() if n != marker]
    moved = marker not in before or list(before[marker][:2]) != list(now[marker])
    changed = [n for n in difference(now, {n: e[:2] for n, e in before.items()}) if n != marker]
    return now[marker][1] >= max(exports, default=0) and (moved or not changed)


def refresh_folder(
    spark: SparkSession, folder: str, root: str, coverage_of, fmt: str = "parquet", schema=OBSERVATIONS, exclude=(), marker: str = None,
) -> int | None:
    """Bring the results up to the folder's state; the new version's number, or None where nothing
    changed or the batch of exports is not complete yet.

    ``coverage_of`` gives (source_order, start, end) from the whole rows of the exports just read.
    An excluded export counts as deleted.
    """
    version = current_version(spark, root)
    before, now = manifest(spark, root, version), listing(folder, exclude)
    if marker and not ready(now, before, marker):
        return None
    exports = {n: e for n, e in now.items() if n != marker}
    known = {n: e[:2] for n, e in before.items() if n != marker}
    changes = difference(exports, known)
    if not changes:
        return None
    new = version + 1
    read = sorted(n for n, c in changes.items() if c != "deleted")
    gone = [(n, before[n][2]) for n, c in changes.items() if c != "added"]
    live = [(n, new if n in changes else before[n][2]) for n in exports]
    touched = []
    if read:
        # The part of the path behind the folder; a store may spell what stands before it in its own way.
        below = F.substring_index(F.url_decode(F.col("_metadata.file_path")), f"/{folder.rstrip('/').split('/')[-1]}/", -1)
        name = F.split_part(below, F.lit("/"), F.lit(1))
        rows = spark.read.schema(schema).format(fmt).load([f"{folder.rstrip('/')}/{n}" for n in read]).withColumn("source_file", name)
        rows = unify_labels(rows).withColumn("bucket", _bucket())
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/store/version={new}")
        stored = spark.read.parquet(f"{root}/store/version={new}")
        stored.select("source_file", *KEYS, "bucket").distinct().write.mode("overwrite").parquet(f"{root}/file_keys/version={new}")
        spans = coverage_of(stored).select("source_order", "start", "end")
        spans.join(stored.select("source_order", "source_file").distinct(), "source_order").write.mode("overwrite").parquet(f"{root}/spans/version={new}")
        touched.append(spark.read.parquet(f"{root}/file_keys/version={new}").select(*KEYS, "bucket"))
    pair = "source_file string, version int"
    if gone:
        lost = spark.createDataFrame(gone, pair)
        touched.append(spark.read.parquet(f"{root}/file_keys").join(lost, ["source_file", "version"], "left_semi").select(*KEYS, "bucket"))
    keys = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
    keys = cut_lineage(keys.distinct())
    # At most BUCKETS numbers.
    buckets = sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())

    standing = spark.createDataFrame(live, pair)
    rows = spark.read.parquet(f"{root}/store").filter(F.col("bucket").isin(buckets)).join(standing, ["source_file", "version"], "left_semi")
    spans = spark.read.parquet(f"{root}/spans").join(standing, ["source_file", "version"], "left_semi").groupBy("source_order").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    made = merge_report(rows.join(keys.select(*KEYS), KEYS, "left_semi").select(*schema.fieldNames()), spans).withColumn("bucket", _bucket())
    snapshot = _snapshot(spark, root, version)
    if snapshot:
        kept = _current(spark, root, {b: v for b, v in snapshot.items() if b in buckets})
        made = made.unionByName(kept.join(keys.select(*KEYS), KEYS, "left_anti").select(*made.columns))
    # Merged rows are few; one file per bucket.
    made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/results/version={new}")
    parts = list((snapshot | {b: new for b in buckets}).items())
    spark.createDataFrame(parts, "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(f"{root}/snapshot/version={new}")
    entries = [(n, *exports[n], v) for n, v in live] + ([(marker, *now[marker], new)] if marker in now else [])
    # An empty folder is a version, too.
    entries = entries or [(None, None, None, None)]
    spark.createDataFrame(entries, "name string, size long, mtime long, stored int").coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={new}")
    return new


def _snapshot(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    if version == 0:
        return {}
    rows = spark.read.parquet(f"{root}/snapshot").filter(F.col("version") == version)
    return {r["bucket"]: r["held"] for r in rows.collect()}


def _current(spark: SparkSession, root: str, snapshot: dict[int, int]) -> DataFrame:
    """Rows of the named buckets; other folders are pruned."""
    wanted = F.lit(False)
    for v in sorted(set(snapshot.values())):
        wanted = wanted | ((F.col("version") == v) & F.col("bucket").isin([b for b, w in snapshot.items() if w == v]))
    return spark.read.parquet(f"{root}/results").filter(wanted)


def latest_results(spark: SparkSession, root: str, version: int = None) -> DataFrame:
    """Merged rows of a version, the last one by default. A reader that holds a version number keeps
    reading the same rows while newer versions are written."""
    version = version or current_version(spark, root)
    return _current(spark, root, _snapshot(spark, root, version)).drop("version", "bucket")


def stream_refresh(spark: SparkSession, folder: str, checkpoint: str, root: str, coverage_of, **options):
    """Start one run over all changes of the folder since the checkpoint, then stop. The manifest
    decides what a batch does, so a repeated batch does nothing twice."""
    def run(changes: DataFrame, batch: int) -> None:
        refresh_folder(changes.sparkSession, folder, root, coverage_of, **options)

    changes = read_changes(spark, folder, options.get("exclude", ()))
    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
