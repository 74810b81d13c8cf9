"""Closed-form statistics as column expressions (no Python UDF).

A4 Welch t test: t and Welch-Satterthwaite df from counts and sample
variances; the two-sided p-value integrates the t density numerically.

With x = sqrt(df) * tan(theta) the t density becomes cos(theta)^(df-1), so
    P(|T| > |t|) = int_{theta0}^{pi/2} cos^(df-1) / int_0^{pi/2} cos^(df-1),
    theta0 = atan(|t| / sqrt(df)),
two bounded integrals (no gamma function).  Simpson's rule over `steps`
intervals runs inside `aggregate(sequence(...))`, JVM-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

P_STEPS = 2000


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    se2 = v1 / n1 + v2 / n2
    return F.try_divide(m1 - m2, F.sqrt(se2))  # NULL for equal scores on both sides


def welch_df(v1: Column, n1: Column, v2: Column, n2: Column) -> Column:
    a = v1 / n1
    b = v2 / n2
    return F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))


def _simpson(lo: Column, hi: Column, df: Column, steps: int) -> Column:
    h = (hi - lo) / steps
    idx = F.sequence(F.lit(0), F.lit(steps))

    def term(acc, i):
        w = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return acc + w * F.pow(F.cos(lo + i * h), df - 1.0)

    return F.aggregate(idx, F.lit(0.0), term) * h / 3.0


def t_two_sided_p(t: Column, df: Column, steps: int = P_STEPS) -> Column:
    """Two-sided p of Student's t with (possibly fractional) df >= 1."""
    theta0 = F.atan(F.abs(t) / F.sqrt(df))
    half = F.lit(math.pi / 2)
    p = _simpson(theta0, half, df, steps) / _simpson(F.lit(0.0), half, df, steps)
    return F.when(t.isNull() | df.isNull() | F.isnan(t), F.lit(None).cast("double")) \
            .otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def significance_stars(p: Column) -> Column:
    """P10 (fixed labels)."""
    return (F.when(p < 0.001, "***").when(p < 0.01, "** ").when(p < 0.05, "*  ")
             .otherwise("n.s"))


def rbf(d2: Column, gamma: Column) -> Column:
    """exp(-gamma * squared distance)."""
    return F.exp(-gamma * d2)
