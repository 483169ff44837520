"""Exact binomial (Clopper-Pearson) intervals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_quantile_udf(tail: float):
    """Arrow function returning the ``tail`` quantile of Beta(a, b).

    Regularised incomplete beta by its continued fraction (modified Lentz), inverted by
    bisection.  Runs on one row per reported group.
    """
    lgamma = math.lgamma

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        def safe(v):
            return v if abs(v) > 1e-300 else 1e-300

        def fraction(x, p, q):
            d = 1 / safe(1 - (p + q) * x / (p + 1))
            c, h = 1.0, d
            # the fraction needs about sqrt(max(p, q)) terms
            for m in range(1, 200 + int(8 * math.sqrt(max(p, q)))):
                for term in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)),
                             -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
                    d = 1 / safe(1 + term * d)
                    c = safe(1 + term / c)
                    h *= c * d
                if abs(c * d - 1) < 1e-15:
                    break
            return h

        def cdf(x, p, q):
            front = math.exp(lgamma(p + q) - lgamma(p) - lgamma(q)
                             + p * math.log(x) + q * math.log1p(-x))
            if x < (p + 1) / (p + q + 2):
                return front * fraction(x, p, q) / p
            return 1 - front * fraction(1 - x, q, p) / q

        def solve(p, q):
            if not (p > 0 and q > 0):
                return None
            lo, hi = 0.0, 1.0
            for _ in range(100):
                mid = (lo + hi) / 2
                if mid <= 0.0 or mid >= 1.0 or hi - lo < 1e-16:
                    break
                if cdf(mid, p, q) < tail:
                    lo = mid
                else:
                    hi = mid
            return (lo + hi) / 2

        return pd.Series([solve(float(p), float(q)) for p, q in zip(a, b)], dtype="float64")

    return quantile


def clopper_pearson(k: Column, n: Column, ci: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper exact bound for ``k`` successes of ``n``; (0, 1) when ``n`` is 0.

    The ends have closed forms, so the kernel only sees 0 < k < n.
    """
    alpha = (1 - ci) / 2
    inside = (k > 0) & (k < n)
    # the kernel is evaluated for all rows; harmless parameters stand in at the ends
    a_lo, b_lo = F.when(inside, k).otherwise(1), F.when(inside, n - k + 1).otherwise(1)
    a_hi, b_hi = F.when(inside, k + 1).otherwise(1), F.when(inside, n - k).otherwise(1)
    lower = _beta_quantile_udf(alpha)(a_lo.cast("double"), b_lo.cast("double"))
    upper = _beta_quantile_udf(1 - alpha)(a_hi.cast("double"), b_hi.cast("double"))
    reach = F.pow(F.lit(alpha), F.try_divide(F.lit(1.0), n))
    lo = (F.when((n == 0) | (k == 0), F.lit(0.0)).when(k == n, reach).otherwise(lower))
    hi = (F.when((n == 0) | (k == n), F.lit(1.0)).when(k == 0, 1 - reach).otherwise(upper))
    return lo, hi
