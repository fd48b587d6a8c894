"""Personal data by weak supervision (built-in functions only).

Pattern, gazetteer and context labelers vote on every candidate span; expectation-maximisation
over the counts of vote patterns estimates their reliabilities per kind, and a logistic span
classifier is trained on the resulting probabilities. Spans that match a base pattern and its check
are always reported; the classifier adds candidates that no base span overlaps.

Defined cases: a null or empty text has no spans; repeated rows are each reported; an empty table
gives an empty result; only the two named columns are read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm import weak
from metricloom.llm.spans import candidates, clear_of, joined
from metricloom.llm.store import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Base pattern of each kind, then wider patterns whose matches only the classifier can accept.
PATTERNS = [
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-]*[0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
]
BASE = 4
#: Digit runs that can't be a card of 13 to 19 digits are no candidates; they are dropped after their place is known.
TOP_LEVEL = "com org net edu gov io info de fr es it nl at ch uk eu us ca".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 64 65 81 82 86 90 91".split()
NEAR = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write to",
    "ip": r"\bip\b|host|server|address|adresse|client|login",
    "card": "card|karte|tarjeta|carte|visa|master|amex|credit|payment",
    "phone": "phone|tel|call|fax|mobil|handy|telefon|cell|sms",
}
AWAY = r"(?:version|\bv|isbn|order|invoice|serial|chapter|section|hash|#|§|no\.|nr\.)[\x20.:#]*$"
VOTERS = ("format", "shape", "gazetteer", "dull", "context_for", "context_against", "edges")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Check sum of at most 19 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0


def _format() -> Column:
    """Whether a match passes the check of its kind."""
    hit, n = F.col("hit"), F.length(_digits(F.col("hit")))
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | hit.contains(":"))
        .when(F.col("kind") == "card", F.when((n >= 13) & (n <= 19), _luhn(_digits(hit))).otherwise(False))
        .otherwise((n >= 9) & (n <= 15))
    )


def _votes() -> Column:
    kind, hit, digits = F.col("kind"), F.col("hit"), _digits(F.col("hit"))
    of = lambda **by: F.coalesce(*[F.when(kind == k, v) for k, v in by.items()], F.lit(weak.ABSTAIN)).cast("tinyint")
    two = lambda good: F.when(good, 1).otherwise(0)
    one = lambda good: F.when(good, 1).otherwise(weak.ABSTAIN)
    none = lambda bad: F.when(bad, 0).otherwise(weak.ABSTAIN)
    near = {k: one(F.lower("before").rlike(f"(?:{v})")) for k, v in NEAR.items()}
    return F.array(
        F.when(F.col("pass") < BASE, two(F.col("valid"))).otherwise(weak.ABSTAIN).cast("tinyint"),
        of(
            email=two(~hit.contains("..") & hit.rlike(r"[A-Za-z]{2,}$")),
            ip=two(~hit.rlike(r"(?:^|\.)0[0-9]") & ~hit.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\.")),
            card=two(hit.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$")),
            phone=two(hit.rlike(r"[\x20().-]")),
        ),
        of(
            email=one(F.lower(F.substring_index(hit, ".", -1)).isin(TOP_LEVEL)),
            ip=none(hit.rlike(r"^(?:0|10|127|192\.168|255)\.")),
            card=two(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)")),
            phone=F.when(hit.startswith("+"), two(digits.rlike(f"^(?:{'|'.join(CALLING_CODES)})"))).otherwise(weak.ABSTAIN),
        ),
        F.when((digits != "") & (F.size(F.array_distinct(F.split(digits, ""))) <= 3), 0).otherwise(weak.ABSTAIN).cast("tinyint"),
        of(**near),
        none(F.lower("before").rlike(AWAY)).cast("tinyint"),
        two(~F.right("before", F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left("after", F.lit(1)).rlike("[A-Za-z0-9]")).cast("tinyint"),
    )


def _features() -> Column:
    """Votes as -1, 0, 1 and two facts of the span."""
    signed = [F.when(F.get("votes", F.lit(j)) == 1, 1).when(F.get("votes", F.lit(j)) == 0, -1).otherwise(0) for j in range(len(VOTERS))]
    return F.array(*signed, (F.col("pass") < BASE).cast("int"), F.when(F.right("before", F.lit(1)).isin("", " ", "\n", "\t"), 1).otherwise(0)).cast("array<tinyint>")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """A row per reported span: ``rid`` (the input row), ``doc_id, kind, start, end, hit, base, score``;
    an input row without a span has one row with nulls. ``score`` is the classifier's probability."""
    rows = candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_")), "text_", PATTERNS, ["doc_id"])
    n = F.length(_digits(F.col("hit")))
    dull = (F.col("kind") == "card") & ~((n >= 13) & (n <= 19))
    rows = rows.withColumn("valid", F.coalesce(_format(), F.lit(False)))
    rows = rows.withColumn("base", F.col("valid") & (F.col("pass") < BASE)).withColumn("clear", clear_of(rows, F.col("valid") & (F.col("pass") < BASE)))
    rows = rows.withColumn("real", F.coalesce(F.col("kind").isNotNull() & ~dull, F.lit(False)))
    rows = rows.withColumn("votes", F.when(F.col("real"), _votes()))
    table = written(rows.withColumn("features", F.when(F.col("real"), _features())).drop("before", "after"), "pii")

    spans = table.filter("real")
    models = weak.fit_reliability(spans, "kind", "votes", len(VOTERS))
    label = F.coalesce(*[F.when(F.col("kind") == k, weak.posterior(F.col("votes"), m)) for k, m in models.items()], F.lit(0.0))
    nets = weak.fit_logistic(spans.withColumn("label", label), "kind", "features", "label", len(VOTERS) + 2)
    score = F.coalesce(*[F.when(F.col("kind") == k, weak.logistic(F.col("features"), w)) for k, w in nets.items()], F.lit(0.0))
    judged = table.withColumn("score", F.when(F.col("real"), score))
    # A card or address that fails its check stays out; only what the base patterns can't see is added.
    taken = F.col("real") & (F.col("base") | ((F.col("pass") >= BASE) & F.col("clear") & (F.col("score") >= threshold)))
    shown = [F.when(taken, F.col(c)).alias(c) for c in ("kind", "start", "end", "hit", "base", "score")]
    return judged.select("rid", "doc_id", *shown)


def digest(found: DataFrame) -> DataFrame:
    """One row per input row: counts and hash of the base spans, all spans, the added ones counted."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(order.alias("at"), "kind", "start", "end", "base"))
    per = found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
        F.collect_list(span).alias("spans"),
    )
    base = F.filter("spans", lambda s: s["base"])
    return per.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(base, ["at", "start"]), 256).alias("base_sha256"), joined(F.col("spans"), ["at", "start"]).alias("spans"), "n_added")
