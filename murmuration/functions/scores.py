"""Evidence scores and confidences as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp(value: Column, threshold: float, width: float, above: bool = True) -> Column:
    """0.5 at the threshold, 0 and 1 a width away from it; a step when the width is 0 or less."""
    gap = (value - threshold) if above else (F.lit(threshold) - value)
    if width <= 0:
        return F.when(gap >= 0, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + gap * 0.5 / width))


def confidence(value: Column, score: Column, evaluable: Column) -> Column:
    """0.5 when nothing can be said, else the score of the verdict."""
    return F.when(~evaluable, 0.5).when(value, score).otherwise(1 - score)


def posterior_at_least(successes: Column, trials: Column, rate: float) -> Column:
    """Probability that a rate with a uniform prior is at least `rate`: with whole shapes, a sum of binomial terms, each from the one before, as logarithms."""
    n, odds = trials + 1, math.log(rate / (1 - rate))
    first = n * math.log(1 - rate)
    added = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(successes, F.lit(1)).cast("int")),
        F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum")),
        lambda s, j: F.struct(
            (s["term"] + F.log((n - j + 1) / j) + odds).alias("term"),
            F.when(j <= successes, added(s["sum"], s["term"] + F.log((n - j + 1) / j) + odds)).otherwise(s["sum"]).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(successes <= 0, F.exp(first)).otherwise(F.exp(total))


def decile_trigger(value: Column) -> Column:
    return F.least(F.floor(value * 10), F.lit(9)).cast("int")


def decile_diagnostic(value: Column) -> Column:
    return F.least(F.floor(value / 0.1) * 0.1, F.lit(0.9))


def severity_rank(col: str) -> Column:
    """critical 3, high 2, medium 1, low 0, unknown -1."""
    ranks = ("low", "medium", "high", "critical")
    out = F.lit(-1)
    for i, name in enumerate(ranks):
        out = F.when(F.col(col) == name, i).otherwise(out)
    return out
