"""Discovery of subjects, lineage, capabilities and data-quality reports, all as tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import (
    DEFAULT_RULES, NamingRules, family_key, generation_model_key, generation_year, is_combined_generation,
    is_subject, is_trial_generation, model_key, sheet_subject, subject_id, subject_parent, subject_type,
)
from ..functions.text import clean_text, compact_text


def to_parent(names: DataFrame, campaigns: DataFrame, name: str = "name", rules: NamingRules = DEFAULT_RULES) -> DataFrame:
    """Replaces a sub-generation by its parent generation (matched by model key)."""
    mapping = campaigns.filter("sub_generation is not null and sub_generation <> ''").select(
        model_key(F.col("sub_generation"), rules).alias("_key"), F.col("generation").alias("_parent")
    ).groupBy("_key").agg(F.min("_parent").alias("_parent"))
    return names.withColumn("_key", model_key(F.col(name), rules)).join(mapping, "_key", "left").withColumn(
        name, F.coalesce("_parent", name)
    ).select(*names.columns)


def discover_subjects(sheets: DataFrame, chart_names: DataFrame, campaigns: DataFrame, rules: NamingRules = DEFAULT_RULES) -> DataFrame:
    """Subjects from sheet names and chart blocks; the spaced spelling wins; the group always exists.

    sheets, chart_names: name, ord.
    """
    from_sheets = sheets.select(sheet_subject(F.col("name"), rules).alias("name"), "ord")
    found = from_sheets.unionByName(chart_names.select(clean_text(F.col("name")).alias("name"), "ord"))
    found = to_parent(found, campaigns, "name", rules).withColumn("name", clean_text(F.col("name")))
    named = found.filter(~F.col("name").contains("图表") & ~F.col("name").isin("Sheet1", "汇总")).filter(is_subject(F.col("name"), rules))
    group = sheets.sparkSession.range(1).select(F.lit(rules.group).alias("name"), F.lit(-1).cast("bigint").alias("ord"))
    every = named.select("name", F.col("ord").cast("bigint").alias("ord")).unionByName(group)
    # Copies of one sheet name collapse here before anything is ordered.
    spelled = every.groupBy("name").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy(compact_text(F.col("name"))).orderBy(F.col("name").contains(" ").desc(), "ord")
    picked = spelled.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    kind = subject_type(F.col("name"), rules)
    return picked.select(
        subject_id(F.col("name"), kind).alias("id"), "name", kind.alias("type"), subject_parent(F.col("name"), kind, rules).alias("parent")
    )


def latest_generations(subjects: DataFrame, name: str = "name") -> DataFrame:
    """Shortcut list: no trial names, newest year per family, one entry per model and kind."""
    rows = subjects.filter(~is_trial_generation(F.col(name)))
    tagged = rows.select(
        "*", family_key(F.col(name)).alias("_family"), generation_model_key(F.col(name)).alias("_model"),
        generation_year(F.col(name)).alias("_year"),
        (F.col(name).contains("&") | F.col(name).rlike(r"(总计|汇总|合计)\s*$")).alias("_combined"),
    )
    newest = tagged.groupBy("_family").agg(F.max("_year").alias("_newest"))
    kept = tagged.join(newest, "_family").filter("_year >= _newest")
    w = Window.partitionBy("_model", "_combined").orderBy(F.desc("_year"), name)
    return kept.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*subjects.columns)


def consumers(sources: DataFrame) -> DataFrame:
    """Which analyses used a (subject, file, sheet)."""
    return sources.select("subject", "file", "sheet", "module").distinct().groupBy("subject", "file", "sheet").agg(
        F.array_join(F.array_sort(F.collect_list("module")), ",").alias("modules"), F.count(F.lit(1)).alias("n_modules")
    )


def expand_lineage(sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """Merged references to every physical file and sheet behind them, without duplicates.

    aliases: file, sheet, physical_file, physical_sheet.
    """
    keys = [c for c in sources.columns if c not in ("file", "sheet")]
    joined = sources.join(aliases, ["file", "sheet"], "left")
    return joined.select(
        *keys, F.coalesce("physical_file", "file").alias("file"), F.coalesce("physical_sheet", "sheet").alias("sheet")
    ).distinct()


def capabilities(subjects: DataFrame, results: DataFrame, order) -> DataFrame:
    """Modules of a subject in configured order; the raw tables are always there."""
    order = list(order) + ([] if "raw" in order else ["raw"])
    lookup = F.create_map(*[F.lit(x) for i, m in enumerate(order) for x in (m, i)])
    have = results.select("subject", "module").distinct()
    raw = subjects.select(F.col("name").alias("subject"), F.lit("raw").alias("module"))
    rows = have.unionByName(raw).distinct().withColumn("_p", lookup[F.col("module")]).filter("_p is not null")
    packed = rows.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("_p", "module"))).alias("_m"))
    return subjects.select(F.col("name").alias("subject")).join(packed, "subject").select(
        "subject", F.array_join(F.transform("_m", lambda x: x["module"]), ",").alias("modules")
    )


def check_module_order(configured: DataFrame, known: DataFrame) -> DataFrame:
    """Configured but unknown, and known but not configured modules."""
    unknown = configured.join(known, "module", "left_anti").select("module", F.lit("unknown").alias("problem"))
    missing = known.join(configured, "module", "left_anti").select("module", F.lit("missing").alias("problem"))
    return unknown.unionByName(missing)


def validate(kpis: DataFrame, subjects: DataFrame) -> DataFrame:
    """Problems of a result table: unknown subject, invalid number, invalid text, missing source.

    kpis: module, subject, grain, period, label, value, text, file, sheet.
    """
    known = subjects.select(F.col("name").alias("subject"), F.lit(True).alias("_known"))
    rows = kpis.join(known, "subject", "left")
    bad_number = F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    bad_text = F.col("text").contains("NaN") | F.col("text").contains("undefined")
    missing = (F.coalesce("file", F.lit("")) == "") | (F.coalesce("sheet", F.lit("")) == "")
    found = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), F.lit("unknown subject")),
        F.when(bad_number, F.lit("invalid number")),
        F.when(bad_text, F.lit("invalid text")),
        F.when(missing, F.lit("source missing")),
    ))
    return rows.select("module", "subject", F.explode(found).alias("problem")).groupBy("module", "problem").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("subject").alias("subjects")
    )


def import_status(sheets: DataFrame, used: DataFrame) -> DataFrame:
    """Status of every sheet.

    sheets: subject, file, sheet, module (NULL = not recognised), rows, numeric. used: consumers().
    """
    joined = sheets.join(used.select("subject", "file", "sheet", "n_modules"), ["subject", "file", "sheet"], "left")
    status = (
        F.when(F.col("module").isNull(), "unmatched")
        .when(F.col("n_modules") > 0, "consumed")
        .when(F.col("sheet").contains("图表"), "chart")
        .when(F.col("numeric") == 0, "check: no numbers")
        .when(F.col("rows") <= 2, "check: header only")
        .otherwise("check: not used")
    )
    return joined.select(*sheets.columns, status.alias("status"))


def import_health(statuses: DataFrame) -> DataFrame:
    """Counts per subject over import_status()."""
    unmatched = F.col("status") == "unmatched"
    return statuses.groupBy("subject").agg(
        F.count_if(unmatched).alias("unmatched"),
        F.count_if(~unmatched).alias("recognised"),
        F.count_if(F.col("status").startswith("check")).alias("to_check"),
        F.countDistinct("file").alias("files"),
        F.coalesce(F.sum(F.when(unmatched, F.col("numeric"))), F.lit(0)).alias("unmatched_numeric"),
    )
