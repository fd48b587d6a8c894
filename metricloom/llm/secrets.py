"""Secrets, told from examples by corpus-wide ownership frequency.

Every candidate value is hashed; over the corpus the distinct documents (repositories) and distinct
sources (owners) of each hash are counted. A value that more than ``MAX_OWNERS`` owners carry, or more
than ``MAX_PER_OWNER`` documents per owner, is a widely copied example. One that stays with few
owners and few of their documents is a live credential, if it is of a base kind (the first three
patterns, from their least lengths on) or looks random.

Defined cases: a null or empty text has no secrets; a null source counts as one owner of its own and
a null identifier as one document; rows that share an identifier are one document to the counts;
repeated rows are each reported; an empty table gives an empty result; further columns of a table
that is cleaned are carried along.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.spans import candidates, clear_of, joined
from metricloom.llm.store import fresh, written

KINDS = ("assign", "access", "hex", "token", "jwt", "key", "login")
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
#: Base pattern of each kind, then further kinds of which live-looking ones are added.
PATTERNS = [
    ("assign", _ASSIGN),
    ("access", r"AKIA[A-Z0-9]++"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    ("token", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}+|sk_live_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{12,}+)"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    ("login", r"://[A-Za-z0-9._%-]++:[^\s@/:]{6,}+@"),
]
BASE = 3
#: A credential is found in a handful of its owner's documents; an example goes through many of them,
#: also where a corpus has one large source or fewer than four. 20 leaves room for a handful.
MAX_OWNERS, MAX_PER_OWNER = 3, 20


def _value() -> Column:
    """The secret itself, without what it is assigned to."""
    return F.when(F.col("kind") == "assign", F.regexp_extract("hit", _ASSIGN, 2)).otherwise(F.col("hit"))


def _firm() -> Column:
    """Whether a match of a base pattern is long enough."""
    return F.coalesce(
        F.when(F.col("kind") == "assign", F.length(_value()) >= 6).when(F.col("kind") == "access", F.length("hit") >= 20).when(F.col("kind") == "hex", F.lit(True)), F.lit(False)
    )


def _random_looking(value: Column) -> Column:
    """Letters and digits mixed, with many different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def ownership(spans: DataFrame) -> DataFrame:
    """``value_hash, repositories, owners`` over rows ``value_hash, repository, owner``.

    Both counts are taken from distinct pairs, so a value that a third of all documents carry is
    spread over its pairs and reaches its counter as partial sums.
    """
    pairs = spans.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("one")).drop("one")
    by_repository = pairs.groupBy("value_hash", "repository").agg(F.lit(1).alias("repository_")).groupBy("value_hash").agg(F.count("repository_").alias("repositories"))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.lit(1).alias("owner_")).groupBy("value_hash").agg(F.count("owner_").alias("owners"))
    return by_repository.join(by_owner, "value_hash")


def _copied(max_owners: int, max_per_owner: int) -> Column:
    return (F.col("owners") > max_owners) | (F.col("repositories") > max_per_owner * F.col("owners"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = MAX_OWNERS, max_per_owner: int = MAX_PER_OWNER, repository: str | None = None) -> DataFrame:
    """A row per candidate with ``rid`` (the input row), ``doc_id, kind, start, end, value, base,
    repositories, owners, live, reported``; an input row without one has a row of nulls.

    ``live``: at most ``max_owners`` distinct owners and, on average, ``max_per_owner`` distinct
    documents (by ``repository``, or else ``doc_id``) of each; a value of a further kind also looks
    random. Reported are all base spans and the live ones of further kinds that overlap no base span.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), named(repository or doc_id).alias("repository"), named(owner).alias("owner"), F.col(text).alias("text_"))
    rows = candidates(own, "text_", PATTERNS, ["doc_id", "repository", "owner"])
    rows = rows.withColumn("base", _firm()).withColumn("clear", clear_of(rows, _firm())).withColumn("value", _value())
    rows = rows.withColumn("real", F.col("base") | F.coalesce((F.col("pass") >= BASE) & F.col("clear"), F.lit(False)))
    rows = rows.withColumn("value_hash", F.when(F.col("real"), F.sha2("value", 256)))
    table = written(rows.drop("before", "after", "hit"), "secrets")
    counted = ownership(table.filter("real").select("value_hash", "repository", "owner"))
    live = ~_copied(max_owners, max_per_owner) & (F.col("base") | _random_looking(F.col("value")) | F.col("kind").isin("key", "login"))
    # Rows without a candidate get a key of their own, so that they don't meet in one task.
    spread = table.withColumn("value_hash", F.coalesce("value_hash", F.concat(F.lit("-"), F.col("rid").cast("string"))))
    judged = spread.join(counted, "value_hash", "left").withColumn("live", F.coalesce(F.col("real") & live, F.lit(False)))
    judged = judged.withColumn("reported", F.col("real") & (F.col("base") | F.col("live")))
    return judged.select("rid", "doc_id", *[F.when(F.col("real"), F.col(c)).alias(c) for c in ("kind", "start", "end", "value", "base", "repositories", "owners")], "live", "reported")


def digest(found: DataFrame) -> DataFrame:
    """One row per input row: counts and hash of the base spans, all reported spans with the distinct
    documents and owners of each in the same order, and how many are live or copied examples."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("reported"), F.struct("start", order.alias("at"), "kind", "end", "base", "repositories", "owners"))
    per = found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS[:BASE]],
        F.count(F.when(F.col("reported") & F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("reported") & ~F.col("live"), 1)).alias("n_copied"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.array_join(F.col(f"spans.{c}").cast("array<string>"), ",").alias(c) for c in ("repositories", "owners")]
    return per.select("doc_id", *[f"n_{k}" for k in KINDS[:BASE]], F.sha2(joined(base, ["start", "at"]), 256).alias("base_sha256"), joined(F.col("spans"), ["start", "at"]).alias("spans"), "n_live", "n_copied", *counts)


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", length: str = "n_chars", max_owners: int = MAX_OWNERS, max_per_owner: int = MAX_PER_OWNER) -> DataFrame:
    """The rows with live secrets replaced by ``[SECRET]`` and ``length`` set to the new text's length
    where that column exists and the text changed. Copied examples stay; every other base value goes,
    random look or not, without the name it is assigned to. Overlapping values go as one.

    The places to replace come back per document as one short array, joined on its identifier and
    the hash of its text.
    """
    key, id_, key_, cuts_ = fresh(docs, "text_key", "id_", "key_", "cuts_")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    named = docs.withColumn(key, F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key")))
    found = find(named, key, text, owner, max_owners, max_per_owner, repository=doc_id)
    start = F.when(F.col("kind") == "assign", F.col("end") - F.length("value")).otherwise(F.col("start"))
    live = found.filter("live and reported").select(F.col("doc_id.id").alias(id_), F.col("doc_id.key").alias(key_), start.alias("start"), "end").distinct()
    # A cut that begins before an earlier one has ended belongs to the same union.
    order = Window.partitionBy(id_, key_).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("long"))
    unions = live.withColumn("union", F.sum("opens").over(order)).groupBy(id_, key_, "union").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = unions.groupBy(id_, key_).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts_))
    hit = keyed.join(cuts, keyed[doc_id].eqNullSafe(cuts[id_]) & (keyed[key] == cuts[key_]), "left")
    # From the back, so that earlier places stay true.
    step = lambda t, c: F.concat(F.substr(t, F.lit(1), c["start"]), F.lit("[SECRET]"), F.substr(t, c["end"] + 1))
    clean = F.when(F.col(cuts_).isNull(), F.col(text)).otherwise(F.aggregate(F.reverse(F.col(cuts_)), F.col(text), step))
    out = hit.withColumn(text, clean)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(cuts_).isNull(), F.col(length)).otherwise(F.length(text).cast(docs.schema[length].dataType)))
    return out.select(*docs.columns)
