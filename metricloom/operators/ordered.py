"""Order-dependent operators that stay distributed when one key is very large."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import day_key, day_label, iso_week
from ..functions.text import bind


#: Largest position that is assumed where none is told: a sheet has at most so many rows.
MOST_POSITIONS = 1 << 20


def _before(totals: DataFrame, part: list, at: str, most: int, chunk: int, total, running, both, names: list) -> DataFrame:
    """Exclusive scan of one row per (part, ``at``): columns ``names`` folded over all lower positions.

    No window holds more than ``chunk`` rows: where there may be more positions, they are cut into
    chunks whose totals are scanned one level higher. ``total(at)`` and ``running(window)`` fold the
    columns of a chunk; ``both(name, lower)`` puts a higher level's result in front of a chunk's own.
    """
    if most <= chunk:
        w = Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*part, at, *[c.alias(n) for n, c in zip(names, running(w), strict=True)])
    up = at + "_"
    cut = totals.withColumn(up, F.floor(F.col(at) / chunk))
    above = cut.groupBy(*part, up).agg(*[c.alias(n) for n, c in zip(names, total(at), strict=True)])
    above = _before(above, part, up, -(-most // chunk), chunk, total, running, both, names)
    above = above.select(*part, up, *[F.col(n).alias(f"{n}_up") for n in names])
    w = Window.partitionBy(*part, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.select(*part, at, up, *[c.alias(n) for n, c in zip(names, running(w), strict=True)])
    return inner.join(above, [*part, up], "left").select(*part, at, *[both(F.col(n), F.col(f"{n}_up")).alias(n) for n in names])


def forward_fill(df: DataFrame, columns, part, order: str, chunk: int = 65536, most: int = MOST_POSITIONS) -> DataFrame:
    """Carry the last known value of ``columns`` down ``order`` inside ``part``.

    The rows of a key are cut into chunks of ``order``; each chunk is filled on its own and one carry
    row per chunk is scanned across the key, in as many levels as ``most`` positions need for windows
    of at most ``chunk`` rows. A key with a third of the table so never ends up in one task.
    """
    part, columns = list(part), list(columns)
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    keys = part + ["_chunk"]
    names = [f"_c_{c}" for c in columns]
    last = lambda values, at: [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(at))) for v in values]
    carry = cut.groupBy(*keys).agg(*[c.alias(n) for n, c in zip(names, last(columns, order), strict=True)])
    carry = _before(
        carry, part, "_chunk", -(-most // chunk), chunk, lambda at: last(names, at),
        lambda w: [F.last(n, ignorenulls=True).over(w) for n in names], lambda own, up: F.coalesce(own, up), names,
    )
    here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.select("*", *[F.last(c, ignorenulls=True).over(here).alias(f"_h_{c}") for c in columns])
    joined = filled.join(carry, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_h_{c}", f"_c_{c}"))
    return joined.select(*df.columns)


def running_count(df: DataFrame, flag: Column, name: str, part, order: str, chunk: int = 65536, most: int = MOST_POSITIONS) -> DataFrame:
    """Number of rows with ``flag`` up to and including this one, in levels like forward_fill."""
    part = list(part)
    cut = df.withColumn("_flag", F.when(flag, 1).otherwise(0)).withColumn("_chunk", F.floor(F.col(order) / chunk))
    keys = part + ["_chunk"]
    base = _before(
        cut.groupBy(*keys).agg(F.sum("_flag").alias("_n")), part, "_chunk", -(-most // chunk), chunk, lambda at: [F.sum("_n")],
        lambda w: [F.coalesce(F.sum("_n").over(w), F.lit(0))], lambda own, up: own + F.coalesce(up, F.lit(0)), ["_n"],
    ).withColumnRenamed("_n", "_base")
    here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = cut.withColumn("_here", F.sum("_flag").over(here)).join(base, keys, "left")
    return counted.withColumn(name, (F.col("_here") + F.col("_base")).cast("bigint")).select(*df.columns, name)


def islands(df: DataFrame, part, position: str, label: str = None) -> DataFrame:
    """Gaps-and-islands: one row per run of consecutive ``position`` values.

    Positions are made distinct first, so the window of a key never holds more rows than
    there are positions (calendar days, weeks, ranks).
    """
    part = list(part)
    label = label or position
    points = df.filter(F.col(position).isNotNull()).groupBy(*part, position).agg(
        F.min(label).alias("_label") if label != position else F.first(position).alias("_label")
    )
    w = Window.partitionBy(*part).orderBy(position)
    runs = points.withColumn("_run", F.col(position) - F.row_number().over(w))
    return runs.groupBy(*part, "_run").agg(
        F.min(position).alias("first_position"),
        F.max(position).alias("last_position"),
        F.min_by("_label", position).alias("first_label"),
        F.max_by("_label", position).alias("last_label"),
        F.count(F.lit(1)).alias("length"),
    ).drop("_run")


def range_text(runs: DataFrame, part, name: str = "ranges", joiner: str = "～", separator: str = "、") -> DataFrame:
    """All runs of a key as one text, in order."""
    text = F.when(F.col("first_label") == F.col("last_label"), F.col("first_label")).otherwise(
        F.concat("first_label", F.lit(joiner), "last_label")
    )
    packed = runs.groupBy(*part).agg(
        F.array_sort(F.collect_list(F.struct("first_position", text.alias("t")))).alias("_r")
    )
    return packed.withColumn(name, F.array_join(F.transform("_r", lambda r: r["t"]), separator)).drop("_r")


def label_position(label: Column) -> Column:
    """struct(kind, position, label) of a diagnosable label: day, ISO week, D-number, TOP rank."""
    text = F.trim(F.regexp_replace(label, "^/+|/+$", ""))
    facts = F.struct(text.alias("text"), day_key(text).alias("day"), iso_week(text).alias("week"))
    return bind(facts, _position)


def _position(p: Column) -> Column:
    numbered = r"(?i)^(D|TOP)(\d+)$"
    number = F.regexp_extract(p["text"], numbered, 2).try_cast("bigint")
    weeks = F.floor(F.datediff(p["week"]["start"], F.lit("1970-01-05").cast("date")) / 7)
    day, week = p["day"].isNotNull(), p["week"].isNotNull()
    is_number = p["text"].rlike(numbered)
    kind = F.when(day, "date").when(week, "week").when(is_number, F.upper(F.regexp_extract(p["text"], numbered, 1))).otherwise("other")
    position = F.when(day, F.unix_date(p["day"]).cast("bigint")).when(week, weeks.cast("bigint")).when(is_number, number)
    shown = F.when(day, day_label(p["day"])).when(week, p["week"]["label"]).otherwise(p["text"])
    return F.struct(kind.alias("kind"), position.alias("position"), shown.alias("label"))


def compress_labels(df: DataFrame, part, label: str) -> DataFrame:
    """Runs of consecutive labels per key and kind; labels of no kind are runs of their own."""
    part = list(part)
    tagged = df.select(*part, label_position(F.col(label)).alias("p")).select(
        *part, F.col("p.kind").alias("kind"), F.col("p.position").alias("position"), F.col("p.label").alias("_text")
    )
    runs = islands(tagged, part + ["kind"], "position", "_text")
    other = tagged.filter("kind = 'other' and _text <> ''").select(
        *part, "kind", F.lit(None).cast("bigint").alias("first_position"), F.lit(None).cast("bigint").alias("last_position"),
        F.col("_text").alias("first_label"), F.col("_text").alias("last_label"), F.lit(1).cast("bigint").alias("length"),
    ).distinct()
    return runs.unionByName(other)


def cell_rectangles(df: DataFrame, part, row: str = "row", col: str = "col") -> DataFrame:
    """Runs of rows per column, then equal runs across neighbouring columns."""
    part = list(part)
    runs = islands(df, part + [col], row).select(
        *part, F.col(col).alias("_col"), F.col("first_position").alias("row_first"), F.col("last_position").alias("row_last")
    )
    wide = islands(runs, part + ["row_first", "row_last"], "_col")
    return wide.select(
        *part, "row_first", "row_last",
        F.col("first_position").alias("col_first"), F.col("last_position").alias("col_last"),
    )


def previous_period(periods: DataFrame, part, period: str = "period", order: str = "period_start") -> DataFrame:
    """Each distinct period of a key with the period shown before it."""
    part = list(part)
    unique = periods.select(*part, period, order).distinct()
    w = Window.partitionBy(*part).orderBy(order, period)
    return unique.withColumn("prev_period", F.lag(period).over(w))


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
