"""Numeric column expressions: histogram bins, networks, densities, policy terms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse(x: Column) -> Column:
    """1/x; infinity where x is 0."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.nullif(x, F.lit(0.0)))


def unit_bin(value: Column, bins: int = 50) -> Column:
    """0-based bin of a value in [0, 1] among equal bins, closed to the right only at 1. The product is
    set right against the edges themselves, which are doubles."""
    width = F.lit(1.0 / bins)
    guess = F.least(F.floor(value * bins), F.lit(bins - 1))
    return F.when((guess < bins - 1) & (value >= (guess + 1) * width), guess + 1).when(value < guess * width, guess - 1).otherwise(guess)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def dot(weights: Sequence[float], vector: Column) -> Column:
    """Inner product of fixed weights with an array column."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(fixed, vector, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gaussian_logprob(action: Column, mean: Column) -> Column:
    """Log-density under a normal distribution of unit variance."""
    return F.lit(-0.5) * (action - mean) * (action - mean) - F.lit(0.5 * math.log(2 * math.pi))


def clipped_surrogate(logp: Column, old_logp: Column, advantage: Column, clip: float = 0.2) -> Column:
    """Per-row term of the clipped policy objective."""
    ratio = F.exp(logp - old_logp)
    bounded = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    return F.least(ratio * advantage, bounded * advantage)
