"""Small statistical column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ks_pvalue(d, n1, n2) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 t^2)."""
    t2 = d * d * n1 * n2 / (n1 + n2)
    sign = lambda k: F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + sign(k) * F.exp(-2.0 * k * k * t2))
    return F.when(d <= 0, 1.0).otherwise(F.least(F.greatest(2.0 * total, F.lit(0.0)), F.lit(1.0)))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution, as a finite sum (even dof: Poisson, odd dof: erfc)."""
    if x is None or dof is None or math.isnan(x) or dof < 1 or x <= 0:
        return 1.0
    h, dof = x / 2.0, int(dof)
    if dof % 2 == 0:
        terms = [k * math.log(h) - math.lgamma(k + 1) - h for k in range(dof // 2)]
        total = 0.0
    else:
        terms = [(k - 0.5) * math.log(h) - math.lgamma(k + 0.5) - h for k in range(1, (dof - 1) // 2 + 1)]
        total = math.erfc(math.sqrt(h))
    return min(1.0, total + sum(math.exp(t) for t in terms))


@F.pandas_udf(DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(s, d) for s, d in zip(stat, dof)], dtype=float)


def array_quantile(arr: Column, p: float) -> Column:
    """Linear-interpolated quantile of a short array; NULL when it is empty."""
    s = F.sort_array(arr)
    pos = (F.size(arr) - 1) * F.lit(float(p))
    lo = F.floor(pos).cast("int")
    a, b = F.get(s, lo), F.get(s, F.ceil(pos).cast("int"))
    return a + (b - a) * (pos - lo)
