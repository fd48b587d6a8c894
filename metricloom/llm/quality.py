"""Quality rules as weak supervision (built-in functions only).

Rules vote good (1), bad (0) or abstain (-1); expectation-maximisation over the counts of vote
patterns estimates how reliable each rule is, and a document is kept by its posterior probability
of being good instead of having to pass every rule.

Defined cases: a null or empty text has no words and fails the base; repeated rows are judged each
for itself (all alike); an empty table gives an empty result; further columns are carried along.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.store import fresh, written
from metricloom.llm.weak import ABSTAIN, Reliability, fit_reliability, let, posterior

WINDOW = 5
#: Function words of the languages the corpus is expected in.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he from at "
    "der die das und ist ein eine von den zu mit im auf für sich nicht auch dem "
    "le la les de des du et un une que est en dans pour qui par sur avec au "
    "el los las que y se del con una por su para como más no lo al"
).split()
RULES = ("length", "symbols", "word_length", "repeated_lines", "repeated_windows", "letters", "function_words")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    exact = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce((k > 0) & (F.get(s, k - 1)["w"] == x["w"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

    # Equal windows have equal hashes, so a text of distinct hashes needs no comparison of words.
    distinct = F.size(F.array_distinct(hashed)) == n - WINDOW + 1
    return F.when(n < WINDOW, 0).when(distinct, 0).otherwise(let(let(exact, repeated), covered)).cast("long")


def counts(text: Column) -> Column:
    """Struct of counts of the whole text. The words are bound inside the expression, so that no
    rewriting of the plan can repeat their extraction for every use."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.array(*[F.lit(x) for x in FUNCTION_WORDS])
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    return let(
        F.struct(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), of_lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            x["l"]["n"].cast("long").alias("n_lines"),
            x["l"]["again"].cast("long").alias("n_dup_lines"),
            _repeat_words(x["w"], F.size(x["w"])).alias("n_repeat_words"),
            F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"),
            F.size(F.array_intersect(x["w"], common)).cast("long").alias("n_function_words"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def votes(m: Column) -> Column:
    """One vote for each of ``RULES``."""
    n = F.greatest(m["n_words"], F.lit(1))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(ABSTAIN).cast("tinyint")
    mean, letters = m["word_chars"] / n, m["n_letters"] / F.greatest(m["word_chars"], F.lit(1))
    return F.array(
        vote(m["n_words"] < 10, m["n_words"] >= 30),
        vote(m["n_symbols"] > 0.3 * n, m["n_symbols"] <= 0.1 * n),
        vote((mean < 2.5) | (mean > 15), (mean >= 3) & (mean <= 12)),
        vote(m["n_dup_lines"] > 0.3 * m["n_lines"], m["n_dup_lines"] <= 0.1 * m["n_lines"]),
        vote(m["n_repeat_words"] > 0.2 * n, m["n_repeat_words"] <= 0.05 * n),
        vote(letters < 0.6, letters >= 0.8),
        vote((m["n_function_words"] == 0) & (m["n_words"] >= 30), m["n_function_words"] >= 2),
    )


def fit(measured: DataFrame, column: str) -> Reliability:
    """Reliability of the rules over all rows. Without rows: the starting values."""
    ruled = measured.select(F.lit("all").alias("g"), votes(F.col(column)).alias("v"))
    return fit_reliability(ruled, "g", "v", len(RULES), prior=0.8).get("all") or Reliability(0.8, (0.85,) * len(RULES), (0.85,) * len(RULES))


def verdict(m: Column, model: Reliability, threshold: float = 0.5) -> tuple[Column, Column]:
    """Probability of being good, and whether the document stays."""
    quality = posterior(votes(m), model)
    return quality, ~base_failed(m) & (quality >= threshold)


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row with its counts (struct ``measured``), ``quality`` and ``kept``."""
    m, q, k = fresh(docs, "measured", "quality", "kept")
    table = written(docs.withColumn(m, counts(F.col(text))).drop(text), "quality")
    quality, kept = verdict(F.col(m), fit(table, m), threshold)
    return table.withColumn(q, quality).withColumn(k, kept)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that stay, with their columns. The texts are read once for the fit and once more for
    the result; they are never shuffled."""
    model = fit(docs.select(counts(F.col(text)).alias("measured")), "measured")
    return docs.filter(let(counts(F.col(text)), lambda m: verdict(m, model, threshold)[1]))
