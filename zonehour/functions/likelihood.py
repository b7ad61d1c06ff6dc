"""Logistic and binomial expressions, penalties, and the 32-bit hash uniform."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(beta) -> Column:
    """1/(1+exp(-beta)) without overflow on either side."""
    tail = F.exp(-F.abs(beta))
    return F.when(beta >= 0, 1 / (1 + tail)).otherwise(tail / (1 + tail))


def log_logistic(beta) -> Column:
    """log of :func:`logistic`."""
    return F.least(beta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(beta)))


def logit(successes, attempts) -> Column:
    return F.ln(successes / (attempts - successes))


def binomial_loglik(successes, attempts, beta) -> Column:
    """successes*log(p) + (attempts-successes)*log(1-p) at log-odds ``beta``."""
    return successes * log_logistic(beta) + (attempts - successes) * log_logistic(-beta)


def pseudo_counts(successes, attempts, eps: float = 1e-3):
    """Counts shifted off zero so that empty cells have finite log-odds."""
    return successes + F.lit(eps), attempts + F.lit(2 * eps)


def raw_rate(successes, attempts) -> Column:
    """Share of failures, safe on empty cells."""
    return 1 - successes / (attempts + F.lit(1e-6))


def penalty_weight(weight, temporal, within_time, across_time) -> Column:
    """weight * (across_time if the edge is temporal else within_time)."""
    return weight * F.when(temporal, across_time).otherwise(within_time)


def level_scaled_penalty(penalty, ordinal, rule: str = "power") -> Column:
    """Penalty grown with the depth of the ``ordinal``-th split (1-based, BFS).

    ``power``: penalty * 2**(0.25*level); ``linear``: penalty * (1+level*sqrt 2).
    """
    level = F.floor(F.log2(ordinal.cast("double")))
    if rule == "power":
        return penalty * F.pow(F.lit(2.0), level * 0.25)
    return penalty * (1 + level * F.sqrt(F.lit(2.0)))


def hash_uniform(ident, salt=0) -> Column:
    """Uniform in [0,1) from integer arithmetic only, so any engine repeats it.

    Two multiplicative mixing steps modulo 2**32; ids beyond 2**31 are folded
    with their own multiplier, so no step can overflow a bigint.
    """
    salt = (salt if isinstance(salt, Column) else F.lit(int(salt))).cast("bigint")
    low = F.pmod(ident.cast("bigint"), F.lit(2147483648))
    high = F.pmod(F.floor(ident / 2147483648), F.lit(1048576))
    h = (low * 2654435761 + high * 40503 + salt * 1013904223) % 4294967296
    h = F.floor(h / 65536) * 69069 + (h % 65536) * 1234567
    return ((h * 1664525 + 1013904223) % 4294967296) / F.lit(4294967296.0)


def poisson_steps(resolution: float = 2.0**-32) -> list[float]:
    """Poisson(1) cumulative probabilities, until what is left can't be told apart by the hash."""
    steps, term, total, k = [], math.exp(-1), 0.0, 0
    while 1 - total > resolution:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return steps


def poisson_one(uniform) -> Column:
    """Poisson(1) draw by thresholds of its distribution function."""
    draw = F.lit(0)
    for cut in poisson_steps():
        draw = draw + (uniform >= cut).cast("int")
    return draw
