"""Places of pattern matches in texts, with built-in functions only.

Patterns are Java patterns. They are written so that a text of any form is read in linear time and
without deep recursion: runs are possessive, and a match may only start where a run starts or right
after the match before (``\\G``).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MATCH = "array<struct<kind:string,seq:int,gap:int,hit:string,before:string,after:string>>"


def matches(text: Column, pattern: str, kind: str, context: int = 48) -> Column:
    """Leftmost non-overlapping matches: the characters since the match before (``gap``), the match,
    and up to ``context`` characters on its two sides that belong to no other match."""
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")
    )
    one = lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("seq"), F.length(z["gap"]).alias("gap"), z["hit"].alias("hit"),
        F.right(z["gap"], F.lit(context)).alias("before"), F.left(z["next"], F.lit(context)).alias("after"),
    )
    found = F.transform(F.filter(both, lambda z: z["hit"].isNotNull()), one)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(MATCH))


def candidates(df: DataFrame, text: str, patterns: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """A row per match with ``kind, hit, before, after, start, end`` (code points, end exclusive), or
    one row with nulls for a text without a match; ``rid`` names the input row. ``kind`` may repeat
    in ``patterns``; then ``pass`` tells the patterns apart. A null text is empty."""
    own = F.coalesce(F.col(text), F.lit(""))
    numbered = lambda place: lambda m: m.withField("pass", F.lit(place))
    each = [F.transform(matches(own, p, k), numbered(place)) for place, (k, p) in enumerate(patterns)]
    rows = df.select(F.monotonically_increasing_id().alias("rid"), *keep, F.concat(*each).alias("found"))
    # An input row is named by its place; all of its matches are then handled in one partition.
    rows = rows.select("rid", *keep, F.explode_outer("found").alias("m")).select("rid", *keep, "m.*").repartition("rid")
    so_far = Window.partitionBy("rid", "pass").orderBy("seq")
    end = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("seq", "gap")


def clear_of(df: DataFrame, firm: Column) -> Column:
    """True where a candidate overlaps no firm one of the same input row."""
    order = Window.partitionBy("rid").orderBy("start", "end", "pass")
    ended = F.max(F.when(firm, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(firm, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))


def joined(spans: Column, parts: list[str]) -> Column:
    """``kind:start:end`` of an array of span structs, ordered by the parts, with commas between."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(*[s[p].alias(p) for p in parts], s["kind"].alias("kind_"), s["end"].alias("end_"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind_"], s["start"], s["end_"])), ",")
