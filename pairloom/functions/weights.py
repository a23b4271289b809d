"""Probabilities and log-odds weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_probability(p: Column) -> Column:
    return p.between(0.0, 1.0)


def log_odds(p: Column) -> Column:
    """ln((1-p)/p): +inf at 0, -inf at 1, an error outside [0, 1]."""
    return (
        F.when(~is_probability(p), F.raise_error(F.concat(F.lit("probability outside [0, 1]: "), p.cast("string"))).cast("double"))
        .when(p == 0.0, F.lit(float("inf")))
        .when(p == 1.0, F.lit(float("-inf")))
        .otherwise(F.log((1.0 - p) / p))
    )


def xor_probability(p: Column, q: Column) -> Column:
    """Probability that exactly one of two independent events happens."""
    return p * (1.0 - q) + q * (1.0 - p)


def xor_probability_of_all(p: Column) -> Column:
    """Aggregate: probability that an odd number of the group's events happen."""
    return (1.0 - F.product(1.0 - 2.0 * p)) / 2.0


def merge_log_odds(a: Column, b: Column) -> Column:
    """Log-odds of the exclusive-or of two independent events, stable for large weights."""
    sign = F.when(a < 0, -1.0).otherwise(1.0) * F.when(b < 0, -1.0).otherwise(1.0)
    smaller = F.least(F.abs(a), F.abs(b))
    return sign * smaller + F.log1p(F.exp(-F.abs(a + b))) - F.log1p(F.exp(-F.abs(a - b)))


def merge_log_odds_of_all(w: Column) -> Column:
    """Aggregate form of :func:`merge_log_odds` for any number of rows.

    Each weight contributes ln tanh(|w|/2), written with exp(-|w|) so that
    neither small nor large weights lose digits. Sums and sign products combine
    before the shuffle, so a group of any size never has to sit in one array.
    """
    decay = F.exp(-F.abs(w))
    total = F.sum(F.when(decay >= 1.0, float("-inf")).otherwise(F.log1p(-decay) - F.log1p(decay)))
    sign = F.when(F.sum(F.when(w < 0, 1).otherwise(0)) % 2 == 1, -1.0).otherwise(1.0)
    size = F.when(total == 0.0, float("inf")).otherwise(F.log1p(F.exp(total)) - F.log(-F.expm1(total)))
    return sign * size
