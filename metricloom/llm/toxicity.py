"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled sample is drawn from all texts that may be
learned from, with a label or without, positives included. The class prior p is the share of positives
among rows with a label. With class prior p and logistic loss the risk p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]) is
minimised in numpy; where the second term turns negative, its gradient is followed backwards, so the
model can't fit the positives hidden among the unlabelled.

The fit runs on a bounded sample: at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` identifiers, taken in
the order of a hash, each with one text. The vocabulary is every word of the sample that passes the test
of excess. Word counts of the sample are summed in Spark; to the driver come the vocabulary and each
sampled text's word numbers. Scoring reads every whole text.

Defined cases: a null or empty text scores as one without known words; null labels are unlabelled and
don't count for the class prior; repeated rows score alike; of several texts with one identifier the fit
takes that with the least hash; without any positive the score is 0 for all; an empty table gives an empty
result; only identifier and text are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.store import written
from metricloom.llm.tokens import ALPHANUMERIC, pieces, words

MOST_POSITIVE, MOST_UNLABELLED = 20_000, 40_000
#: A word is taken into the vocabulary from this many positives and standard errors of excess.
LEAST_TEXTS, LEAST_EXCESS = 3, 3.0


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    terms: list[bytes]
    weights: np.ndarray
    bias: float


def _pairs(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the batch, and the distinct (text, word) pairs in them."""
    found = words(part.column("text"), ALPHANUMERIC)
    coded = found.array().dictionary_encode()
    text = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(found.bounds))
    pairs = np.unique((text << 32) | coded.indices.to_numpy().astype(np.int64))
    return coded.dictionary, pairs >> 32, pairs & 0xFFFFFFFF


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        terms, text, word = _pairs(part)
        columns = [pa.array(np.bincount(word, part.column(c).to_numpy()[text], len(terms)).astype(np.int64)) for c in ("in_p", "in_u")]
        yield pa.RecordBatch.from_arrays([terms.cast(pa.binary()), *columns], names=["term", "in_p", "in_u"])


def _known(terms: list[bytes]):
    vocabulary = pa.array(terms, pa.large_binary())

    def numbers(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        found, text, word = _pairs(part)
        place = pc.fill_null(pc.index_in(found, vocabulary), -1).to_numpy()[word]
        return text[place >= 0], place[place >= 0]

    return numbers


def _features(terms: list[bytes]):
    numbers = _known(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            text, place = numbers(part)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))
            columns = ["doc_id", "in_p", "in_u"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists], names=[*columns, "words"])

    return run


def _scores(model: Model):
    numbers = _known(model.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            text, place = numbers(part)
            total = np.bincount(text, model.weights[place], part.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-total)))], names=["doc_id", "score"])

    return run


def minimise(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, n: int, prior: float, steps: int = 400, rate: float = 0.05, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias with the least non-negative risk. ``positive`` and ``unlabelled`` say how often
    each row counts in the two samples."""
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    word = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    w, bias = np.zeros(n), np.log(prior / (1 - prior))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        q = 1 / (1 + np.exp(-(np.bincount(row, w[word], len(rows)) + bias)))
        # Slopes of l(g) and l(-g) with respect to g are q - 1 and q.
        surplus = (u * -np.log1p(-np.minimum(q, 1 - 1e-12))).sum() - prior * (p * -np.log1p(-np.minimum(q, 1 - 1e-12))).sum()
        slope = u * q - prior * p * q
        slope = prior * p * (q - 1) + slope if surplus >= 0 else -slope
        gradient = np.append(np.bincount(word, slope[row], n) + shrink * w, slope.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``; both of rows that may be learned from."""
    docs = docs.filter("doc_id is not null")
    known = labels.filter("doc_id is not null and toxic is not null")
    amounts = known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("p")).first()
    if not amounts["p"]:
        return None
    prior = min(max(amounts["p"] / amounts["n"], 1e-3), 0.9)
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    positive = known.filter("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(MOST_POSITIVE)
    unlabelled = docs.select("doc_id").distinct().orderBy(*order).limit(MOST_UNLABELLED)
    both = positive.select("doc_id", F.lit(1).alias("in_p"), F.lit(0).alias("in_u")).union(unlabelled.select("doc_id", F.lit(0).alias("in_p"), F.lit(1).alias("in_u")))
    sample = written(both.groupBy("doc_id").agg(F.max("in_p").alias("in_p"), F.max("in_u").alias("in_u")), "sample")
    # At most MOST_POSITIVE + MOST_UNLABELLED short rows, also with the hash of the text to take.
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    sample = hashed.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("in_p").alias("in_p"), F.max("in_u").alias("in_u"), F.min("hash").alias("hash"))
    sample = written(sample, "sample")
    texts = hashed.join(F.broadcast(sample), ["doc_id", "hash"])

    counts = texts.mapInArrow(_counts, "term binary, in_p long, in_u long").groupBy("term").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    sizes = sample.agg(F.sum("in_p").alias("p"), F.sum("in_u").alias("u")).first()
    if not sizes["p"] or not sizes["u"]:
        return None
    rate_p, rate_u = (F.col("in_p") + 0.0) / sizes["p"], (F.col("in_u") + 0.5) / (sizes["u"] + 1)
    excess = (rate_p - rate_u) / F.sqrt(rate_u * (1 - F.least(rate_u, F.lit(0.999))) / sizes["p"])
    chosen = counts.filter(F.col("in_p") >= LEAST_TEXTS).withColumn("excess", excess).filter(F.col("excess") >= LEAST_EXCESS)
    terms = [bytes(r["term"]) for r in chosen.orderBy(F.col("excess").desc(), "term").select("term").collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = texts.mapInArrow(_features(terms), f"doc_id {kind}, in_p int, in_u int, words array<int>")
    # Repeated rows of a sampled identifier come once.
    rows = listed.groupBy("doc_id").agg(F.max("in_p").alias("in_p"), F.max("in_u").alias("in_u"), F.min("words").alias("words")).collect()
    # Sums of floats depend on the order of rows.
    rows = sorted((tuple(r["words"]), r["in_p"], r["in_u"]) for r in rows)
    in_p, in_u = (np.array([r[k] for r in rows], float) for k in (1, 2))
    weights, bias = minimise([np.array(r[0], np.int32) for r in rows], in_p, in_u, len(terms), prior)
    return Model(terms, weights, bias)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(own.filter(~held_out(F.col("doc_id"))), labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))))
    kind = own.schema["doc_id"].dataType.simpleString()
    scored = own.mapInArrow(_scores(model), f"doc_id {kind}, score double") if model else own.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
