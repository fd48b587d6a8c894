"""Mixing sources to target weights by Sainte-Laguë apportionment (built-in functions only).

Targets in words come from the weights, stop at ``REPEATS`` times what a source has, and share the
excess. The mix is handed out in equal blocks of ``BLOCK`` words: sources get whole blocks by highest
quotients target / (2k + 1), and each source's blocks are apportioned in the same way to its shards
(documents dealt by a seeded hash), which gives an integer quota per source and shard. A source with more
than ``FANOUT`` shards is apportioned in levels, first to groups of shards, so that no ranking holds more
than ``FANOUT`` rows. Within a shard documents stand in seeded order as one line of blocks; a quota takes
whole rounds of the line and then its first blocks. A document so is taken at most once more than its
shard's whole rounds.

Work per document is one hash, one join by (source, shard) and one running sum within its shard; a
source of any size is spread over the shards, whose number grows with the corpus without a limit. Sources
themselves are ranked in one task, one short row each; they are assumed to be at most some millions.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last
in order; a null identifier is hashed as an empty one, and as the text is hashed with it, documents
without one are spread like the others; repeated rows (same identifier, same text) are documents of their
own and stand in one shard; an empty table gives an empty result; a source of size 0 has target 0.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.store import written

BLOCK, REPEATS = 16, 3
#: A shard has about so many words over all sources; a source or group is apportioned to at most FANOUT parts at once.
SHARD_WORDS, FANOUT = 1 << 18, 1024
SEED = "mix-1"


def _key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))


def targets(sources: DataFrame, everything: int, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``target`` to one row per ``source`` with its ``source_size``.

    Sources fill up in the order of capacity per weight; the first ones whose capacity is less than
    their share of what is left stop there, the others share the rest by weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    known = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int")))
    known = known.withColumn("room", (REPEATS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    known = known.withColumn("before", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    known = known.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    known = known.withColumn("level", (F.lit(float(everything)) - F.col("before")) / F.col("left"))
    # The first source that its share doesn't fill sets the level for all after it.
    known = known.withColumn("at", F.row_number().over(order)).withColumn("fits", F.col("level") * F.col("weight") <= F.col("room"))
    first = Window.partitionBy()
    open_at = F.min(F.when(F.col("fits"), F.col("at"))).over(first)
    known = known.withColumn("open_at", open_at)
    known = known.withColumn("final", F.max(F.when(F.col("at") == F.col("open_at"), F.col("level"))).over(first))
    return known.withColumn("target", F.when(F.col("at") < F.col("open_at"), F.col("room")).otherwise(F.col("final") * F.col("weight"))).select("source", "source_size", "target")


def apportion(df: DataFrame, group: list[str], order: list[str], weight: Column, of: Column, seats: Column, most: Column) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats of each row within its group.

    ``of`` is the group's sum of weights, ``seats`` what is to be handed out. Every row starts with
    what it has for certain (``of`` divided among half a seat less per row) and only the few next
    quotients compete for the rest, so no more than about two rows per row are ranked. ``most`` bounds
    a row's seats; what it leaves over by rounding is not handed out.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    df = df.withColumn("w_", weight.cast("double")).withColumn("of_", of.cast("double")).withColumn("seats_", seats.cast("double")).withColumn("most_", most.cast("long"))
    df = df.withColumn("rows_", F.count(F.lit(1)).over(whole).cast("double"))
    share = lambda n: F.when(F.col("of_") > 0, F.col("w_") * n / F.col("of_")).otherwise(0.0)
    low = F.floor(share(F.greatest(F.col("seats_") - F.col("rows_") / 2, F.lit(0.0))) + 0.5)
    high = F.ceil(share(F.col("seats_") + F.col("rows_") / 2) + 0.5)
    df = df.withColumn("low_", F.when(F.col("seats_") >= F.col("rows_") / 2, F.least(low, F.col("most_"))).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("high_", F.least(high, F.col("most_")).cast("long"))
    df = df.withColumn("rest_", F.col("seats_") - F.sum("low_").over(whole))
    ranked = df.filter("high_ > low_ and w_ > 0").withColumn("k_", F.explode(F.sequence(F.col("low_"), F.col("high_") - 1)))
    place = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy()).orderBy((F.col("w_") / (2 * F.col("k_") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "k_"))
    won = ranked.withColumn("place_", place).filter("place_ <= rest_").groupBy(*[F.col(c).alias(f"{c}_won") for c in group + order]).agg(F.count(F.lit(1)).alias("won_"))
    same = None
    for c in group + order:
        one = df[c].eqNullSafe(won[f"{c}_won"])
        same = one if same is None else same & one
    out = df.join(won, same, "left").withColumn("quota", F.col("low_") + F.coalesce("won_", F.lit(0)))
    return out.drop("w_", "of_", "seats_", "most_", "rows_", "low_", "high_", "rest_", "won_", *[f"{c}_won" for c in group + order])


def shard_quotas(parts: DataFrame, shards: int) -> DataFrame:
    """``source, shard, shard_size, quota`` from rows ``source, shard, shard_size, source_size, source_quota``.

    Shards form groups whose widths are powers of ``FANOUT``; from the widest on, the quota of a group
    is apportioned to the groups inside it.
    """
    widths = [1]
    while widths[-1] * FANOUT < shards:
        widths.append(widths[-1] * FANOUT)
    above = None
    for width in reversed(widths):
        size = [F.sum("shard_size").alias("part_size"), F.first("source_size").alias("of_size"), F.first("source_quota").alias("of_quota")]
        level = parts.groupBy("source", F.expr(f"shard div {width}").alias("part")).agg(*size)
        if above is None:
            level = level.withColumn("of", F.lit(0).cast("long"))
        else:
            inside = F.col("source").eqNullSafe(F.col("s_")) & (F.col("of") == F.col("o_"))
            level = level.drop("of_size", "of_quota").withColumn("of", F.expr(f"part div {FANOUT}")).join(above, inside).drop("s_", "o_")
        shared = apportion(level, ["source", "of"], ["part"], F.col("part_size"), F.col("of_size"), F.col("of_quota"), F.floor(F.col("part_size") * REPEATS / BLOCK))
        above = shared.select(F.col("source").alias("s_"), F.col("part").alias("o_"), F.col("part_size").alias("of_size"), F.col("quota").alias("of_quota"))
        if width > 1:
            above = written(above, "groups")
    return above.select(F.col("s_").alias("source"), F.col("o_").alias("shard"), F.col("of_size").alias("shard_size"), F.col("of_quota").alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _key(doc_id, text).alias("key")), "sizes")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = sums.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, everything // SHARD_WORDS)

    aimed = targets(sums, everything, weights)
    aimed = apportion(aimed, [], ["source"], F.col("target"), F.lit(everything), F.lit(everything // BLOCK), F.floor(F.col("source_size") * REPEATS / BLOCK))
    aimed = written(aimed.withColumnRenamed("quota", "source_quota"), "targets")

    dealt = sizes.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    parts = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    parts = parts.join(aimed.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    quotas = shard_quotas(parts, shards).join(aimed.select(F.col("source").alias("t_"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t_"))).drop("t_")
    quotas = written(quotas.withColumnRenamed("source", "s_").withColumnRenamed("shard", "h_"), "quotas")

    line = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(quotas, placed["source"].eqNullSafe(quotas["s_"]) & (placed["shard"] == quotas["h_"]))
    words = F.col("quota") * BLOCK
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    rest = words - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.least(F.col("size"), F.greatest(rest - F.col("before"), F.lit(0)))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
