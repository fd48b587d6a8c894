"""Weak supervision with built-in functions: reliabilities of voters and a classifier on their labels.

Voters say 1, 0 or -1 (abstain). Both fits run over counts per distinct pattern, of which there are
at most 3^voters per group whatever the number of rows, so the array that the iteration runs over
is of bounded size.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSTAIN = -1


@dataclass(frozen=True)
class Reliability:
    """``prior``: share of class 1; ``good[j]``: how often voter j says 1 in class 1 when it votes;
    ``bad[j]``: how often it says 0 in class 0 when it votes."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(items: Column, part) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + part(x))


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _logit(votes: Column, n: int, prior: Column, good, bad) -> Column:
    score = F.log(prior / (1 - prior))
    for j in range(n):
        vote = F.get(votes, F.lit(j))
        score = score + F.when(vote == 1, F.log(good(j) / (1 - bad(j)))).when(vote == 0, F.log((1 - good(j)) / bad(j))).otherwise(0.0)
    return score


def posterior(votes: Column, model: Reliability) -> Column:
    """Probability of class 1 given the votes."""
    logit = _logit(votes, len(model.good), F.lit(model.prior), lambda j: F.lit(model.good[j]), lambda j: F.lit(model.bad[j]))
    return 1 / (1 + F.exp(-logit))


def fit_reliability(
    df: DataFrame, group: str, votes: str, n: int, prior: float = 0.5, accuracy: float = 0.85, strength: float = 0.05, rounds: int = 25
) -> dict[str, Reliability]:
    """Expectation-maximisation for each group.

    ``prior`` and ``accuracy`` are the starting point and act as ``strength`` times the group's rows
    of earlier evidence, so that the outcome does not depend on the size of the input. Voters stay
    better than chance (0.55 to 0.99), which keeps the classes from swapping names. A group without
    rows has no entry. Only the fitted numbers of each group come to the driver.
    """
    patterns = df.groupBy(F.col(group).alias("g"), F.col(votes).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    packed = patterns.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"), F.sum("n").alias("rows"))
    weight = F.col("rows") * strength

    def step(m: Column, _: Column) -> Column:
        def split(x: Column) -> Column:
            logit = _logit(x["v"], n, m["prior"], lambda j: F.get(m["good"], F.lit(j)), lambda j: F.get(m["bad"], F.lit(j)))
            return let(1 / (1 + F.exp(-logit)), lambda q: F.struct(x["v"].alias("v"), (x["n"] * q).alias("pos"), (x["n"] * (1 - q)).alias("neg")))

        def rate(rows: Column, j: int, vote: int, side: str) -> Column:
            said = lambda r: F.get(r["v"], F.lit(j))
            hits = total(rows, lambda r: F.when(said(r) == vote, r[side]).otherwise(0.0))
            cast = total(rows, lambda r: F.when(said(r) != ABSTAIN, r[side]).otherwise(0.0))
            return _clamp((hits + weight * accuracy) / (cast + weight), 0.55, 0.99)

        return let(
            F.transform(F.col("p"), split),
            lambda rows: F.struct(
                _clamp((total(rows, lambda r: r["pos"]) + weight * prior) / (F.col("rows") + weight), 0.02, 0.98).alias("prior"),
                F.array(*[rate(rows, j, 1, "pos") for j in range(n)]).alias("good"),
                F.array(*[rate(rows, j, 0, "neg") for j in range(n)]).alias("bad"),
            ),
        )

    start = F.struct(F.lit(prior).alias("prior"), F.array(*[F.lit(accuracy)] * n).alias("good"), F.array(*[F.lit(accuracy)] * n).alias("bad"))
    fitted = packed.select("g", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m"))
    return {r["g"]: Reliability(r["m"]["prior"], tuple(r["m"]["good"]), tuple(r["m"]["bad"])) for r in fitted.collect()}


def fit_logistic(df: DataFrame, group: str, features: str, target: str, n: int, rounds: int = 150, rate: float = 1.0, shrink: float = 0.01) -> dict[str, list[float]]:
    """Logistic regression of a probability on small integer features, for each group: weights, bias last.

    Gradient steps over the sums per distinct feature array (the bound of the module applies).
    """
    patterns = df.groupBy(F.col(group).alias("g"), F.col(features).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum(target), 6).alias("t"))
    packed = patterns.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("x", "n", "t"))).alias("p"), F.sum("n").alias("rows"))

    def step(w: Column, _: Column) -> Column:
        def error(x: Column) -> Column:
            score = F.get(w, F.lit(n))
            for j in range(n):
                score = score + F.get(w, F.lit(j)) * F.get(x["x"], F.lit(j))
            return F.struct(x["x"].alias("x"), (x["t"] - x["n"] / (1 + F.exp(-score))).alias("e"))

        def moved(rows: Column, j: int) -> Column:
            pull = total(rows, lambda r: r["e"] * F.get(r["x"], F.lit(j)) if j < n else r["e"])
            return F.get(w, F.lit(j)) + rate * (pull / F.col("rows") - (shrink * F.get(w, F.lit(j)) if j < n else F.lit(0.0)))

        return let(F.transform(F.col("p"), error), lambda rows: F.array(*[moved(rows, j) for j in range(n + 1)]))

    fitted = packed.select("g", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(0.0)] * (n + 1)), step).alias("w"))
    return {r["g"]: list(r["w"]) for r in fitted.collect()}


def logistic(features: Column, weights: list[float]) -> Column:
    score = F.lit(weights[-1])
    for j, w in enumerate(weights[:-1]):
        score = score + F.lit(w) * F.get(features, F.lit(j))
    return 1 / (1 + F.exp(-score))
