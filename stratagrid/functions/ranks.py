"""Ranks with ties, the normal distribution and unbiased moments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.rolling import last
from stratagrid.functions.windows import col


def average_rank(x: Column | str, *by: str, descending: bool = False) -> Column:
    """1-based rank within ``by``, ties sharing their mean; NULL for NULL."""
    v, all_ = col(x), Window.partitionBy(*by)
    up, down = F.rank().over(all_.orderBy(F.asc_nulls_last(x))), F.rank().over(all_.orderBy(F.desc_nulls_last(x)))
    less = down - up if descending else up - down  # from both ends: ties need no partitioning of their own
    return F.when(v.isNotNull(), (F.count(v).over(all_) + 1 + less) / 2.0)


def centred_rank(x: Column | str, *by: str) -> Column:
    """Twice the average rank less the middle, a whole number; for rows without NULL."""
    all_ = Window.partitionBy(*by)
    return (F.rank().over(all_.orderBy(F.asc(x))) - F.rank().over(all_.orderBy(F.desc(x)))).cast("long")


#: Fixed: coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
LOW = 0.02425


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal's inverse distribution function, to about 1e-9."""
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    tail = lambda u: _poly(_C, u) / _poly(_D, u)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < LOW, tail(low)).when(p > 1 - LOW, -tail(high)).otherwise(_poly(_A, r) * q / _poly(_B, r))


def sql_normal_quantile(p: str) -> str:
    """The same in SQL."""

    def poly(cs, x):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"(CASE WHEN {p} < {LOW} THEN {poly(_C, low)} / {poly(_D, low)} WHEN {p} > {1 - LOW} THEN -{poly(_C, high)} / {poly(_D, high)} ELSE {poly(_A, r)} * {q} / {poly(_B, r)} END)"


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by Abramowitz and Stegun 26.2.17, to about 1e-7."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x < 0, tail).otherwise(1 - tail)


def unbiased_skew(x: Column | str, d: int) -> Column:
    """Of the last ``d`` rows."""
    n = last(F.count, d, x).cast("double")
    return F.when(n >= 3, last(F.skewness, d, x) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(x: Column | str, d: int) -> Column:
    """Excess kurtosis of the last ``d`` rows."""
    n = last(F.count, d, x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * last(F.kurtosis, d, x) + 6))
