"""Numeric column expressions: rates, logits, signal statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _c


def pct(n, d, empty=None) -> Column:
    out = F.try_divide(F.lit(100.0) * _c(n), _c(d).cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def ratio(n, d) -> Column:
    return F.try_divide(_c(n).cast("double"), _c(d).cast("double"))


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def logit(c, eps: float = fixed.PRED_CLIP) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.ln(p / (1 - p))


def expit(c) -> Column:
    return 1 / (1 + F.exp(-_c(c)))


def ror(a, b, c, d) -> Column:
    """Odds ratio, null when any cell is zero: no continuity correction."""
    a, b, c, d = (_c(x).cast("double") for x in (a, b, c, d))
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    return F.when(full, (a * d) / (b * c))


def ror_lower(a, b, c, d) -> Column:
    a, b, c, d = (_c(x).cast("double") for x in (a, b, c, d))
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.when(full, F.exp(F.ln((a * d) / (b * c)) - fixed.Z95 * se))


def ic(a, exposed, events, total) -> Column:
    """Shrunk information component."""
    expected = F.try_divide(_c(exposed).cast("double") * _c(events).cast("double"), _c(total).cast("double"))
    return F.log2((_c(a) + fixed.IC_SHRINK) / (expected + fixed.IC_SHRINK))


def ic_lower(a, exposed, events, total) -> Column:
    x = _c(a) + fixed.IC_SHRINK
    return ic(a, exposed, events, total) - fixed.IC_LOW_1 * F.pow(x, F.lit(-0.5)) - fixed.IC_LOW_2 * F.pow(x, F.lit(-1.5))


def smd_means(m1, v1, m2, v2) -> Column:
    pooled = F.sqrt((_c(v1) + _c(v2)) / 2)
    return F.when(pooled > 0, (_c(m1) - _c(m2)) / pooled).when(pooled.isNotNull(), F.lit(0.0))


def smd_shares(p1, p2) -> Column:
    p1, p2 = _c(p1), _c(p2)
    spread = F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2)
    return F.when(spread > 0, (p1 - p2) / spread).when(spread.isNotNull(), F.lit(0.0))


def unbiased_skew(c) -> Column:
    """Bias-corrected skewness, null below three values or without spread."""
    n = F.count(_c(c)).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(_c(c)) > 0), F.skewness(_c(c)) * F.sqrt(n * (n - 1)) / (n - 2))
