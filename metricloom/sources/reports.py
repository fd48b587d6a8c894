"""Report folders in, result batches out."""

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_text, compact_text
from ..labels import REPORTS


def read_reports(spark: SparkSession, folder: str, schema: StructType, fmt: str = "csv", exclude=()) -> DataFrame:
    """All reports of one folder level; temporary files and excluded names are skipped.

    Adds file name and source_order (path order = merge priority). A file that does not fit
    the schema fails the job. The order comes from Spark's own file index, so no rows are
    read for it; it is joined back as a table and broadcast only below the planner's limit.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "false")
    reader = reader.option("pathGlobFilter", "[!~.]*").option("header", "true")
    data = reader.format(fmt).load(folder)
    skip = set(exclude)
    names = sorted({os.path.basename(p) for p in data.inputFiles()} - skip)
    order = spark.createDataFrame(list(enumerate(names)), "source_order int, source_file string")
    plain = data.drop("source_order", "source_file")
    return plain.withColumn("source_file", F.col("_metadata.file_name")).join(order, "source_file")


def classify_report(name: Column) -> Column:
    """Analysis that reads a report, by the keyword in its file name; NULL when unknown."""
    chain = F.lit(None).cast("string")
    for word, module in reversed(REPORTS):
        chain = F.when(name.contains(word), module).otherwise(chain)
    return chain


def load_campaigns(raw: DataFrame) -> DataFrame:
    """Campaign identities from header-named columns; rows without a generation are dropped."""
    names = set(raw.columns)
    if "小订发布时段" not in names and "小订发布时间" in names:
        raw = raw.withColumn("小订发布时段", F.col("小订发布时间"))
    primary, secondary = F.trim(F.coalesce("代际名", F.lit(""))), F.trim(F.coalesce("二级代际名", F.lit("")))
    named = raw.withColumn("代际名", primary).withColumn("二级代际名", secondary).filter("`代际名` <> ''")
    label = F.coalesce(F.nullif("二级代际名", F.lit("")), F.col("代际名"))
    brand = F.col("品牌") if "品牌" in names else F.split_part(F.col("代际名"), F.lit(" "), F.lit(1))
    return named.withColumn("label", label).withColumn("brand", brand)


def contains_text(columns, query: str) -> Column:
    """Does any of the columns contain the text, whatever its case?"""
    texts = F.array(*[F.lower(F.coalesce(c.cast("string"), F.lit(""))) for c in columns])
    needle = query.strip().lower()
    return F.exists(texts, lambda t: t.contains(needle)) if needle else F.lit(True)


#: Largest page that may be asked for.
MOST_PAGE_ROWS = 500


def check_page(offset: int, limit: int) -> None:
    if not 1 <= limit <= MOST_PAGE_ROWS or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_PAGE_ROWS} rows and starts at 0 or later")


def search_rows(df: DataFrame, query: str, columns=None) -> DataFrame:
    """Every row in which any column contains the text, case-insensitively."""
    return df.filter(contains_text([F.col(c) for c in columns or df.columns], query))


def search_page(df: DataFrame, query: str, order: str, offset: int = 0, limit: int = 50, columns=None) -> DataFrame:
    """One page of the matching rows; the sort keeps only offset+limit rows per task."""
    check_page(offset, limit)
    return search_rows(df, query, columns).orderBy(order).offset(offset).limit(limit)


def search_total(df: DataFrame, query: str, columns=None) -> DataFrame:
    return search_rows(df, query, columns).agg(F.count(F.lit(1)).alias("total"))


def csv_values(df: DataFrame) -> DataFrame:
    """CSV texts: whole numbers without .0, NULL as blank."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            c = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str, query: str = "") -> None:
    """All matching rows as quoted CSV, one file per task."""
    rows = search_rows(df, query) if query else df
    csv_values(rows).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


class PublishConflict(RuntimeError):
    """Another batch became current since this one was begun."""


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a table of small files; none before the first is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """One row per published batch: its number, counted from 1, and what it is."""
    return _rows(spark, f"{root}/_current", "batch_id string, code_version string, published_at timestamp, version int")


def published_version(spark: SparkSession, root: str) -> int:
    """Number of the current batch; 0 before the first."""
    return pointers(spark, root).agg(F.max("version")).first()[0] or 0


def publish(results: DataFrame, root: str, batch_id: str, manifest: DataFrame = None, code_version: str = "", seen: int = None) -> int:
    """Write an immutable batch, then make it current; its number.

    ``seen`` is the number that was current when the batch was begun (without it: when this call starts).
    The pointer is one folder per number, which must not exist: of two batches begun at the same number
    the one that comes second is refused, whatever the order of their data. It is written after the data,
    so a broken publication leaves the current batch as it is.
    """
    spark = results.sparkSession
    current = published_version(spark, root)
    seen = current if seen is None else seen
    if seen != current:
        raise PublishConflict(f"batch {current} is current, this one was begun at {seen}")
    results.write.mode("errorifexists").partitionBy("module", "subject").parquet(f"{root}/batch_id={batch_id}")
    if manifest is not None:
        manifest.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{root}/_manifest")
    pointer = spark.range(1).select(
        F.lit(batch_id).alias("batch_id"), F.lit(code_version).alias("code_version"), F.current_timestamp().alias("published_at")
    )
    try:
        pointer.coalesce(1).write.mode("errorifexists").parquet(f"{root}/_current/version={seen + 1}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise PublishConflict(f"another batch took number {seen + 1}") from e
    return seen + 1


def current_batch(spark: SparkSession, root: str) -> str:
    """Identifier of the current batch (one small row per batch is read); NULL before the first."""
    return pointers(spark, root).agg(F.max_by("batch_id", "version")).first()[0]


def read_published(spark: SparkSession, root: str, module: str = None, subject: str = None, batch_id: str = None) -> DataFrame:
    """Rows of one batch; module and subject prune partitions."""
    df = spark.read.parquet(f"{root}/batch_id={batch_id or current_batch(spark, root)}")
    if module:
        df = df.filter(F.col("module") == module)
    return df.filter(F.col("subject") == subject) if subject else df


def pin_batch(spark: SparkSession, root: str, reader: str, hours: float) -> str:
    """The current batch, held for a reader: it is kept for so long, whatever is published meanwhile."""
    batch_id = current_batch(spark, root)
    until = F.current_timestamp() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    pin = spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(reader).alias("reader"), until.alias("until"))
    pin.coalesce(1).write.mode("append").parquet(f"{root}/_pins")
    return batch_id


def expired_batches(spark: SparkSession, root: str, keep: int = 2) -> DataFrame:
    """Batches that may be removed: neither among the last ``keep`` nor held by a reader."""
    if keep < 1:
        raise ValueError("the current batch is always kept")
    held = _rows(spark, f"{root}/_pins", "batch_id string, reader string, until timestamp").filter(F.col("until") > F.current_timestamp())
    old = pointers(spark, root).filter(F.col("version") <= published_version(spark, root) - keep)
    return old.join(held, "batch_id", "left_anti").select("batch_id", "version")


def remove_expired(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes the rows of expired batches; their pointers stay, so numbers are never given twice."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    removed = []
    for row in expired_batches(spark, root, keep).orderBy("version").collect():
        folder = f"{path}/batch_id={row['batch_id']}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
            removed.append(row["batch_id"])
    return removed


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and time of every file of a folder, without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~.]*").load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def diff_manifest(now: DataFrame, published: DataFrame) -> DataFrame:
    """added / changed / deleted files against the last published list."""
    n = now.select("name", F.col("size").alias("size"), F.col("mtime").alias("mtime"), F.lit(True).alias("_n"))
    p = published.select("name", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_p"))
    change = (
        F.when(F.col("_p").isNull(), "added").when(F.col("_n").isNull(), "deleted")
        .when((F.col("size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime")), "changed")
    )
    return n.join(p, "name", "full").select("name", change.alias("change")).filter("change is not null")


def ready_batches(manifest: DataFrame, published: DataFrame, marker: str) -> DataFrame:
    """Is the folder complete? A marker file must be newest, and must be new when files changed.

    Without a marker the folder counts as ready. Result: one row (ready, changed).
    """
    files = (F.col("name") != marker) & F.col("name").isNotNull()
    changes = diff_manifest(manifest.filter(files), published.filter(files))
    # One aggregate over the tagged rows of all three inputs.
    rows = (
        manifest.select("name", "mtime", F.lit("now").alias("side"))
        .unionByName(published.select("name", "mtime", F.lit("before").alias("side")))
        .unionByName(changes.select("name", F.lit(None).cast("timestamp").alias("mtime"), F.lit("change").alias("side")))
    )
    now, before = F.col("side") == "now", F.col("side") == "before"
    facts = rows.agg(
        F.max(F.when(now & files, F.col("mtime"))).alias("newest"),
        F.max(F.when(now & ~files, F.col("mtime"))).alias("marker"),
        F.max(F.when(before & ~files, F.col("mtime"))).alias("marker_before"),
        F.count_if(F.col("side") == "change").alias("changed"),
    )
    fresh = (F.col("changed") == 0) | F.col("marker_before").isNull() | (F.col("marker") != F.col("marker_before"))
    marked = F.coalesce(F.col("marker") >= F.col("newest"), F.lit(True)) & fresh
    return facts.select(F.when(F.col("marker").isNull(), True).otherwise(marked).alias("ready"), "changed")


def title_columns(df: DataFrame, order: str, sample: int = 100) -> DataFrame:
    """Per column: share of data-like values in the first rows; under half means a title column."""
    head = df.orderBy(order).limit(sample)
    names = [c for c in df.columns if c != order]
    texts = F.array(*[F.struct(F.lit(c).alias("name"), clean_text(F.col(c)).alias("text")) for c in names])
    long = head.select(F.explode(texts).alias("x")).select("x.*").filter("text <> ''")
    data = F.col("text").rlike(r"^[+-]?[\d,]*\.?\d+\s*[%％]?$")
    return long.groupBy("name").agg(F.avg(F.when(data, 1.0).otherwise(0.0)).alias("data_share")).withColumn(
        "is_title", F.col("data_share") < 0.5
    )


def select_sheet(obs: DataFrame, report: str, subject: str, grain: str, suffix: str = None, charts: bool = False) -> DataFrame:
    """Rows of one sheet: report, subject (spaces ignored), grain, optional name suffix."""
    rows = obs.filter((F.col("report") == report) & (F.col("grain") == grain))
    rows = rows.filter(compact_text(F.col("subject")) == compact_text(F.lit(subject)))
    if suffix:
        rows = rows.filter(F.col("source_sheet").endswith(suffix))
    return rows if charts else rows.filter(~F.coalesce(F.col("source_sheet"), F.lit("")).contains("图表"))
