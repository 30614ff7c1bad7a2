"""Aggregates of an entity's last d rows as one NumPy pass over the entity, instead of d updates a row and expression.

Expressions are built as ever; inside ``rolled`` what they ask of ``last`` and ``ahead`` is written down, computed once
for all of them and put in their place. Outside, both are plain window expressions with the same results.

Defined results are Spark's: NULL is left out, NaN counts and is the largest value, deviations without a row
or (samples) with one are NULL, as are quotients by 0. Work is cut into blocks of CELLS numbers, so memory
doesn't grow with an entity's rows times d.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

ENTITY, DATE = "entity", "date"
CELLS = 1 << 18
_ASKED: contextvars.ContextVar[Asked | None] = contextvars.ContextVar("asked", default=None)


class Asked:
    """What expressions under construction need: columns ahead of the pass, its inputs and its aggregates."""

    def __init__(self):
        self.before: dict[str, tuple[str, Column]] = {}
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.plain: dict[str, str] = {}
        self.aggregates: dict[tuple, str] = {}

    def put(self, at: dict, prefix: str, c: Column) -> str:
        return at.setdefault(str(c), (f"_{prefix}{len(at)}", c))[0]


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _frame(d: int):
    return Window.partitionBy(ENTITY).orderBy(DATE).rowsBetween(1 - d, 0)


def ahead(c: Column) -> Column:
    """A window expression of one step a row, which Spark computes before the pass."""
    asked = _ASKED.get()
    return c if asked is None else F.col(asked.put(asked.before, "b", c))


def quantile(p: float) -> Callable:
    """Interpolated quantile, for ``last``."""

    def percentile(x):
        return F.percentile(x, F.lit(p))

    percentile.share = p
    return percentile


def corr(x, y):
    """Correlation of pairs that are both there, for ``last``; NULL where either does not vary."""
    raise NotImplementedError("only in a pass")


def mad(x):
    """Median distance from the median, for ``last``."""
    raise NotImplementedError("only in a pass")


def last(agg: Callable, d: int, *xs: Column | str) -> Column:
    """``agg`` (a function of ``pyspark.sql.functions`` or of this module) over the row and the d - 1 before it."""
    asked = _ASKED.get()
    if asked is None:
        return agg(*map(_column, xs)).over(_frame(d))
    names = tuple(asked.put(asked.inputs, "x", _column(x).cast("double")) for x in xs)
    asked.plain |= {n: x for n, x in zip(names, xs, strict=True) if isinstance(x, str)}
    return F.col(asked.aggregates.setdefault((agg.__name__, d, getattr(agg, "share", None), *names), f"_a{len(asked.aggregates)}"))


def asking() -> bool:
    return _ASKED.get() is not None


class Block:
    """The windows of d rows that end at rows ``a`` to ``b`` of padded columns, and what several aggregates share."""

    def __init__(self, columns: dict[str, tuple[np.ndarray, np.ndarray]], d: int, a: int, b: int):
        self.columns, self.d, self.a, self.b, self.held = columns, d, a, b, {}

    def once(self, key, make):
        if key not in self.held:
            self.held[key] = make()
        return self.held[key]

    def raw(self, x):
        """Values (0 for NULL) and whether they are there, a row a window."""

        def make():
            pad = (len(self.columns[x][0]) - self.columns["n"]) - (self.d - 1)
            return tuple(np.lib.stride_tricks.sliding_window_view(c[pad:], self.d)[self.a : self.b] for c in self.columns[x])

        return self.once(("raw", x), make)

    def n(self, x):
        return self.once(("n", x), lambda: self.raw(x)[1].sum(axis=1).astype(float))

    def max(self, x):
        v, ok = self.raw(x)
        return self.once(("max", x), lambda: np.where(ok, v, -np.inf).max(axis=1))

    def centred(self, x, also=None):
        """Distances from the mean of the values (of pairs, if ``also`` must be there), 0 for none, their number, and the mean.

        The largest value is taken off first, so that a flat window has distances of exactly 0.
        """

        def make():
            v, ok = self.raw(x)
            if also is not None:
                ok = ok & self.raw(also)[1]
            n = ok.sum(axis=1).astype(float)
            base = self.max(x)
            base = np.where(np.isfinite(base), base, 0.0)
            off = np.where(ok, v - base[:, None], 0.0)
            mean = off.sum(axis=1) / n
            return np.where(ok, off - mean[:, None], 0.0), n, base + mean

        return self.once(("centred", x, also), make)

    def squares(self, x, also=None):
        return self.once(("squares", x, also), lambda: np.square(self.centred(x, also)[0]).sum(axis=1))

    def products(self, x, y):
        return self.once(("products", x, y), lambda: (self.centred(x, y)[0] * self.centred(y, x)[0]).sum(axis=1))

    def sorted(self, x):
        """Values in order, behind them NaN for what isn't there."""
        v, ok = self.raw(x)
        return self.once(("sorted", x), lambda: np.sort(np.where(ok, v, np.nan), axis=1))

    def at_share(self, held, n, p):
        place = np.maximum(n - 1, 0) * p
        low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
        rows = np.arange(len(held))
        one, two = held[rows, low], held[rows, high]
        return np.where((low == high) | (one == two), one, (high - place) * one + (place - low) * two)

    def of(self, kind: str, share, x: str, y: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Values of an aggregate and whether they are there."""
        v, ok = self.raw(x)
        n = self.n(x)
        some = n > 0
        if kind == "count":
            return n, np.ones(len(n), bool)
        if kind in ("sum", "avg"):
            total = self.once(("sum", x), lambda: v.sum(axis=1))
            return (total, some) if kind == "sum" else (total / n, some)
        if kind == "max":
            return self.max(x), some
        if kind == "min":
            return np.fmin.reduce(np.where(ok, v, np.nan), axis=1), some
        if kind == "stddev_pop":
            return np.sqrt(self.squares(x) / n), some
        if kind == "stddev_samp":
            return np.sqrt(self.squares(x) / (n - 1)), n > 1
        if kind in ("skewness", "kurtosis"):
            m2, off = self.squares(x), self.centred(x)[0]
            if kind == "skewness":
                return np.sqrt(n) * (off * off * off).sum(axis=1) / np.sqrt(m2 * m2 * m2), some & (m2 != 0)
            return n * np.square(off * off).sum(axis=1) / (m2 * m2) - 3.0, some & (m2 != 0)
        if kind == "percentile":
            return self.at_share(self.sorted(x), n, share), some
        if kind == "mad":
            held = self.sorted(x)
            far = np.sort(np.abs(held - self.at_share(held, n, 0.5)[:, None]), axis=1)
            return self.at_share(far, n, 0.5), some
        if kind == "below":
            own = v[:, -1:]
            less = (v < own) | (~np.isnan(v) & np.isnan(own))
            return np.where(ok[:, -1], (less & ok).sum(axis=1), 0).astype(float), np.ones(len(n), bool)
        if kind == "mean_deviation":
            return np.abs(self.centred(x)[0]).sum(axis=1) / n, some
        if kind == "first_least":
            return np.where(ok & ~np.isnan(v), v, np.inf).argmin(axis=1).astype(float), some
        # y is the one that regressions are on
        sxx, syy, sxy = self.squares(x, y), self.squares(y, x), self.products(x, y)
        pairs = self.centred(x, y)[1] > 0
        if kind == "corr":
            scale = np.sqrt(sxx) * np.sqrt(syy)
            return sxy / scale, pairs & (scale != 0)
        if kind == "regr_slope":
            return sxy / syy, pairs & (syy != 0)
        if kind == "regr_intercept":
            return self.centred(x, y)[2] - sxy / syy * self.centred(y, x)[2], pairs & (syy != 0)
        if kind == "regr_r2":
            return np.where(sxx == 0, 1.0, sxy * sxy / (sxx * syy)), pairs & (syy != 0)
        raise ValueError(kind)


def below(x):
    """Values that are smaller than the row's own, for ``last``."""
    raise NotImplementedError("only in a pass")


def mean_deviation(x):
    """Mean distance from the mean, for ``last``."""
    raise NotImplementedError("only in a pass")


def first_least(x):
    """How many rows after the window's first one its first smallest value stands, for ``last``."""
    raise NotImplementedError("only in a pass")


def passed(table: pa.Table, inputs: list[str], aggregates: list[tuple], kept: list[str]) -> pa.Table:
    """One entity's rows with their aggregates."""
    days = table.column(DATE).combine_chunks()
    if len(days) > 1 and (days.null_count or not pc.all(pc.less_equal(days[:-1], days[1:])).as_py()):
        table = table.sort_by(DATE)
    n, pad = table.num_rows, max(d for _, d, *_ in aggregates) - 1
    columns: dict = {"n": n}
    for x in inputs:
        c = table.column(x).combine_chunks()
        ok = np.concatenate([np.zeros(pad, bool), c.is_valid().to_numpy(zero_copy_only=False)])
        v = np.concatenate([np.zeros(pad), c.fill_null(0.0).to_numpy(zero_copy_only=False)])
        columns[x] = v, ok
    out: list = [None] * len(aggregates)
    with np.errstate(all="ignore"):
        for d in {d for _, d, *_ in aggregates}:
            own = [i for i, a in enumerate(aggregates) if a[1] == d]
            step, parts = max(1, CELLS // d), {i: [] for i in own}
            for a in range(0, n, step):
                block = Block(columns, d, a, min(n, a + step))
                for i in own:
                    kind, _, share, *xs = aggregates[i]
                    parts[i].append(block.of(kind, share, *xs))
            for i in own:
                v, ok = (np.concatenate(p) for p in zip(*parts[i], strict=True))
                out[i] = pa.array(v, pa.float64(), mask=~ok)
    return pa.table([*(table.column(k) for k in kept), *out], [*kept, *(f"_a{i}" for i in range(len(out)))])


def rolled(df: DataFrame, build: Callable[[], dict[str, Column]]) -> DataFrame:
    """``df`` with the columns that ``build`` gives; what they ask of ``last`` comes from one pass over each entity."""
    asked = Asked()
    token = _ASKED.set(asked)
    try:
        out = build()
    finally:
        _ASKED.reset(token)
    if not asked.aggregates:
        return df.withColumns(build())
    held = df.withColumns(dict(asked.before.values())) if asked.before else df
    kept = held.columns
    fields = [*held.schema.fields, *(StructField(n, DoubleType()) for n in asked.aggregates.values())]
    # a column of doubles is its own input, so that no row carries it twice through the exchange ("n" is the pass's own name)
    twice = {n: x for n, x in asked.plain.items() if x in kept and x != "n" and isinstance(held.schema[x].dataType, DoubleType)}
    more = {n: c for n, c in asked.inputs.values() if n not in twice}
    inputs = list(dict.fromkeys(twice.get(n, n) for n, _ in asked.inputs.values()))
    aggregates = [(kind, d, share, *(twice.get(x, x) for x in xs)) for kind, d, share, *xs in asked.aggregates]

    def run(table: pa.Table) -> pa.Table:
        return passed(table, inputs, aggregates, kept)

    found = (held.withColumns(more) if more else held).groupBy(ENTITY).applyInArrow(run, StructType(fields))
    return found.withColumns(out).select(*df.columns, *(c for c in out if c not in df.columns))
