"""Decay, confidence and size of small things: expressions over columns, and the kernel's coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives of shared history and of what was told, and the gate of surprise.
HISTORY_DAYS, LEDGER_HOURS, SURPRISE = 30.0, 48.0, 0.15
#: Channel weights of an impact, by the reason it reaches a file.
CHANNELS = {"call": 1.0, "import": 1.0, "test": 1.0, "inheritance": 1.0, "route": 1.0, "co-change": 0.5, "path": 0.5, "literal": 0.35}
#: Priority of a relation to a seed, by edge kind.
RELATIONS = {"contains": 0, "imports": 2, "join": 3, "anchors": 4, "tests": 5, "inherits": 6, "invokes": 7}


def recency(age_days: Column, half_life: float = HISTORY_DAYS) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def pair_score(n: Column, solo_a: Column, solo_b: Column) -> Column:
    """Weight of a pair seen together n times: Jaccard, helped a little by the count, at most a half."""
    union = solo_a + solo_b - n
    return F.when(union <= 0, 0.0).otherwise(F.least(F.lit(0.5), 0.08 + 0.55 * n / F.greatest(union, F.lit(1)) + 0.10 * F.least(n / 10, F.lit(1.0))))


def decayed(mass: Column, hours: Column, half_life: float = LEDGER_HOURS) -> Column:
    """Mass after some hours; a clock that went back does not make more of it."""
    return mass * F.pow(F.lit(0.5), F.greatest(hours, F.lit(0.0)) / half_life)


def posterior(hits: Column, n: Column) -> Column:
    """Jeffreys estimate of a rate."""
    return (hits + 0.5) / (n + 1)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def clamp_budget(budget: int | None, default: int) -> int:
    return max(256, min(16000, int(budget if budget is not None else default)))


def _log_add(a: float, b: float) -> float:
    high, low = max(a, b), min(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def bessel_i(k: int, t: float) -> float:
    """Modified Bessel function of the first kind, by its series in logarithms."""
    if t < 1e-8:
        return 1.0 if k == 0 else 0.0
    half, total, m = math.log(t / 2), -math.inf, 0
    while True:
        term = (2 * m + k) * half - math.lgamma(m + 1) - math.lgamma(m + k + 1)
        total = _log_add(total, term)
        if m > t and term < total - 40:
            return math.exp(total)
        m += 1


def order_for(t: float) -> int:
    """Terms of the series that a diffusion over time t needs."""
    return min(90, math.ceil(2.2 * t) + 16)


def heat_coefficients(t: float, order: int | None = None) -> list[float]:
    """Coefficients of exp(-tL) in the Chebyshev polynomials of L - I."""
    order = order_for(t) if order is None else order
    return [math.exp(-t) * bessel_i(k, t) * (1 if k == 0 else 2 * (-1) ** k) for k in range(order + 1)]
