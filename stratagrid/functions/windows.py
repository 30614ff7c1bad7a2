"""Frames over an entity's rows and over a date's rows, and guarded arithmetic.

Two rolling means live side by side on purpose: ``full`` is NULL until its window is full, the kernels
in ``operators.kernels`` fall back to the prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stratagrid.functions.rolling import DATE, ENTITY, ahead, last


def per_entity() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(DATE)


def last_rows(d: int) -> WindowSpec:
    """The current row and the d - 1 before it."""
    return per_entity().rowsBetween(1 - d, 0)


def so_far() -> WindowSpec:
    return per_entity().rowsBetween(Window.unboundedPreceding, 0)


def per_date(*more: str) -> WindowSpec:
    return Window.partitionBy(DATE, *more)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(x: Column | str, d: int, agg=F.avg) -> Column:
    """``agg`` of the last d values, NULL unless all of them are there."""
    return F.when(last(F.count, d, x) == d, last(agg, d, x))


def at_least(x: Column | str, d: int, least: int, agg=F.avg) -> Column:
    """``agg`` of the last d values, NULL unless ``least`` of them are there."""
    return F.when(last(F.count, d, x) >= least, last(agg, d, x))


def before(x: Column | str, n: int = 1) -> Column:
    return ahead(F.lag(col(x), n).over(per_entity()))


def or_if_zero(x: Column | str, guard: float) -> Column:
    """``x`` with 0 replaced; NULL stays NULL."""
    return F.when(col(x) == 0, F.lit(guard)).otherwise(col(x))


def change(x: Column | str) -> Column:
    return col(x) - before(x)


def returns(x: Column | str) -> Column:
    """Relative change to the row before."""
    return F.try_divide(col(x), before(x)) - 1


def row_number() -> Column:
    return F.row_number().over(per_entity())


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def rounded(*names: str, places: int | dict[str, int] = 6):
    """For ``select``: entity, date and the named columns rounded, so that engines can be compared."""
    at = places.get if isinstance(places, dict) else lambda n, other: places
    return [ENTITY, DATE, *(F.round(n, at(n, 6)).alias(n) for n in names)]


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of pairs that are both there; NULL (not an error) where either does not vary."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    f = lambda agg: agg if over is None else agg.over(over)
    return F.try_divide(f(F.covar_pop(a, b)), f(F.stddev_pop(a)) * f(F.stddev_pop(b)))
