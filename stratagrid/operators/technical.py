"""Technical indicators of bars (entity, date, open, high, low, close, volume, amount).

Windows need all their rows. Price levels are divided by the close, so that a series times any factor
gives the same values. Recursive averages (``ewm``) run in one pandas call per entity; everything else
is window expressions over one partitioning, so Spark shuffles once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions import rolling
from stratagrid.functions.rolling import ahead, last, quantile
from stratagrid.functions.windows import DATE, ENTITY, before, change, col, correlation, full, last_rows, or_if_zero, returns, so_far

TINY = 1e-10
SPANS = (5, 10, 20, 30, 60)


def cs() -> Column:
    return or_if_zero("close", TINY)


def kbar() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    base, span = or_if_zero("open", TINY), or_if_zero(h - low, TINY)
    top, bottom = F.greatest(o, c), F.least(o, c)
    return {
        "kmid": (c - o) / base, "klen": (h - low) / base, "kmid2": (c - o) / span,
        "kup": (h - top) / base, "kup2": (h - top) / span, "klow": (bottom - low) / base, "klow2": (bottom - low) / span,
        "ksft": (2 * c - h - low) / base, "ksft2": (2 * c - h - low) / span,
    }


def price_ratios() -> dict[str, Column]:
    return {f"{x}0": F.col(x) / cs() for x in ("open", "high", "low")}


def moving_averages(spans=(5, 10, 20, 60, 120)) -> dict[str, Column]:
    return {f"ma_{d}": full("close", d) / cs() for d in spans}


def bollinger(d: int = 20) -> dict[str, Column]:
    mid, dev = full("close", d), full("close", d, F.stddev_samp)
    upper, lower = mid + 2 * dev, mid - 2 * dev
    return {"boll_mid": mid / cs(), "boll_upper": upper / cs(), "boll_lower": lower / cs(), "boll_pct": (F.col("close") - lower) / or_if_zero(upper - lower, TINY)}


def true_range() -> Column:
    gone = before("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - gone), F.abs(F.col("low") - gone))


def atr(d: int = 14) -> Column:
    """Needs a column ``tr`` (``true_range``)."""
    return full("tr", d) / cs()


def roc(periods=(6, 12, 20)) -> dict[str, Column]:
    return {f"roc_{p}": (F.col("close") - before("close", p)) / or_if_zero(before("close", p), TINY) * 100 for p in periods}


def williams(periods=(10, 20)) -> dict[str, Column]:
    return {f"wr_{p}": (full("high", p, F.max) - F.col("close")) / or_if_zero(full("high", p, F.max) - full("low", p, F.min), TINY) * -100 for p in periods}


def mean_deviation(x: Column | str, d: int) -> Column:
    """Mean distance from the window's mean."""
    if rolling.asking():
        return last(rolling.mean_deviation, d, x)
    held = F.collect_list(col(x)).over(last_rows(d))
    mean = F.avg(col(x)).over(last_rows(d))
    return F.aggregate(held, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.size(held)


def cci(periods=(14, 20)) -> dict[str, Column]:
    """Needs ``tp``, the typical price."""
    return {f"cci_{p}": (F.col("tp") - full("tp", p)) / or_if_zero(F.when(last(F.count, p, "tp") == p, mean_deviation("tp", p)), TINY) / 0.015 for p in periods}


def volatility(periods=(5, 20)) -> dict[str, Column]:
    """Needs ``lr``, the log return."""
    return {f"vol_{p}": full("lr", p, F.stddev_samp) * (252**0.5) for p in periods}


def log_return() -> Column:
    return F.ln(F.greatest(F.try_divide(F.col("close"), before("close")), F.lit(1e-12)))


def volumes() -> dict[str, Column]:
    """Needs ``up``: whether the close rose."""
    mean = full("volume", 5)
    signed = F.when(F.col("up"), F.col("volume")).otherwise(-F.col("volume"))
    return {
        "volume_ma5": mean, "volume_ratio": F.col("volume") / or_if_zero(mean, 1.0), "obv": ahead(F.sum(signed).over(so_far())), "vol_up_ratio_20": full(F.col("up").cast("double"), 20),
        "amount_ma5": full("amount", 5), "amount_ratio": F.col("amount") / or_if_zero(full("amount", 5), 1.0),
    }


def position(d: int) -> dict[str, Column]:
    c = F.col("close")
    less = last(rolling.below, d, "close") if rolling.asking() else F.size(F.filter(F.collect_list("close").over(last_rows(d)), lambda v: v < c))
    high, low = full("high", d, F.max), full("low", d, F.min)
    q = lambda p: full("close", d, quantile(p))
    return {
        f"max_{d}": high / cs(), f"min_{d}": low / cs(), f"qtlu_{d}": q(0.8) / cs(), f"qtld_{d}": q(0.2) / cs(),
        f"rank_{d}": F.when(last(F.count, d, "close") == d, less / float(d)),
        f"rsv_{d}": (c - low) / or_if_zero(high - low, TINY),
    }


def correlations(d: int) -> dict[str, Column]:
    """Needs ``lv`` = ln(volume + 1), ``ret`` and ``lvr`` = ln(|volume return| + 1)."""
    of = lambda x, y: last(rolling.corr, d, x, y) if rolling.asking() else correlation(x, y, last_rows(d))
    both = lambda x, y: F.when(last(F.count, d, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) == d, of(x, y))
    return {f"corr_{d}": both("close", "lv"), f"cord_{d}": both("ret", "lvr")}


def trend(d: int) -> dict[str, Column]:
    """Needs ``rn`` (``kernels.numbered``)."""
    c, there = F.col("close"), last(F.count, d, "close") == d
    slope, cut = last(F.regr_slope, d, "close", "rn"), last(F.regr_intercept, d, "close", "rn")
    flat = last(F.min, d, "close") == last(F.max, d, "close")
    return {
        f"beta_{d}": F.when(there, slope / cs()), f"rsqr_{d}": F.when(there, F.when(flat, 1.0).otherwise(last(F.regr_r2, d, "close", "rn"))),
        f"resi_{d}": F.when(there, (c - (slope * F.col("rn") + cut)) / cs()),
        f"vma_{d}": full("volume", d) / or_if_zero("volume", TINY), f"vstd_{d}": full("volume", d, F.stddev_pop) / or_if_zero("volume", TINY),
    }


def counts(d: int) -> dict[str, Column]:
    """Needs ``dc``, the change of the close."""
    there = last(F.count, d, F.lit(1)) == d
    share = lambda cond: F.when(there, last(F.avg, d, F.when(cond, 1.0).otherwise(0.0)))
    rise, fall, total = full(F.greatest(F.col("dc"), F.lit(0.0)) + F.col("dc") * 0, d, F.sum), full(F.greatest(-F.col("dc"), F.lit(0.0)) + F.col("dc") * 0, d, F.sum), full(F.abs("dc"), d, F.sum)
    up, down = share(F.col("dc") > 0), share(F.col("dc") < 0)
    return {f"cntp_{d}": up, f"cntn_{d}": down, f"cntd_{d}": up - down, f"sump_{d}": rise / or_if_zero(total, TINY), f"sumn_{d}": fall / or_if_zero(total, TINY), f"sumd_{d}": (rise - fall) / or_if_zero(total, TINY)}


def extremes(d: int) -> dict[str, Column]:
    """Where in the window the first highest high and lowest low stand, from 0 to 1; needs ``rn``."""
    there = last(F.count, d, "high") == d
    offset = lambda x: last(rolling.first_least, d, x) if rolling.asking() else F.min(F.struct(x.alias("v"), F.col("rn"))).over(last_rows(d))["rn"] - (F.col("rn") - d + 1)
    place = lambda x: offset(x) / (d - 1)
    top, bottom = F.when(there, place(-F.col("high"))), F.when(there, place(F.col("low")))
    return {f"imax_{d}": top, f"imin_{d}": bottom, f"imxd_{d}": top - bottom}


def volume_shape(d: int) -> dict[str, Column]:
    """Needs ``rv`` = |return| * volume and ``dv``, the change of the volume."""
    rise, fall, total = full(F.when(F.col("dv").isNotNull(), F.greatest(F.col("dv"), F.lit(0.0))), d, F.sum), full(F.when(F.col("dv").isNotNull(), F.greatest(-F.col("dv"), F.lit(0.0))), d, F.sum), full(F.abs("dv"), d, F.sum)
    guard = or_if_zero(total, TINY)
    return {f"wvma_{d}": full("rv", d, F.stddev_samp) / or_if_zero(full("rv", d), TINY), f"vsump_{d}": rise / guard, f"vsumn_{d}": fall / guard, f"vsumd_{d}": (rise - fall) / guard}


def money_flow(d: int = 14) -> Column:
    """Needs ``tp`` and ``dtp``, its change."""
    flow = F.col("tp") * F.col("volume")
    up = full(F.when(F.col("dtp") > 0, flow).when(F.col("dtp").isNotNull(), 0.0), d, F.sum)
    down = full(F.when(F.col("dtp") < 0, flow).when(F.col("dtp").isNotNull(), 0.0), d, F.sum)
    return 100 - 100 / (1 + up / or_if_zero(down, TINY))


def cmo(d: int = 14) -> Column:
    """Needs ``dc``."""
    rise, fall = full(F.when(F.col("dc").isNotNull(), F.greatest(F.col("dc"), F.lit(0.0))), d, F.sum), full(F.when(F.col("dc").isNotNull(), F.greatest(-F.col("dc"), F.lit(0.0))), d, F.sum)
    return 100 * (rise - fall) / or_if_zero(rise + fall, TINY)


def prepared(bars: DataFrame) -> DataFrame:
    """Bars with the columns that the indicators above start from; one sort per entity serves all."""
    out = bars.withColumns({"rn": F.row_number().over(so_far()).cast("double"), "tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "dc": change("close"), "dv": change("volume"), "ret": returns("close"), "lr": log_return(), "tr": true_range(), "lv": F.ln(F.col("volume") + 1), "lvr": F.ln(F.abs(returns("volume")) + 1)})
    return out.withColumns({"dtp": change("tp"), "up": F.coalesce(F.col("dc") > 0, F.lit(False)), "rv": F.abs("ret") * F.col("volume")})


RECURSIVE = ("ema_12", "ema_26", "macd_dif", "macd_dea", "macd_hist", "rsi_6", "rsi_12", "rsi_24", "kdj_k_9", "kdj_d_9", "kdj_j_9", "kdj_k_14", "kdj_d_14", "kdj_j_14", "pdi", "mdi", "adx", "adxr", "trix")


def recursive(bars: DataFrame, columns: tuple[str, ...] = RECURSIVE) -> DataFrame:
    """entity, date and those of the indicators that carry a state from row to row which ``columns`` names; no others are computed.

    A window can't express the recurrence in linear time, so each entity's rows form one pandas group.
    """
    asked = lambda *prefixes: any(n.startswith(prefixes) for n in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        c, h, low = (pdf[x].astype(float) for x in ("close", "high", "low"))
        scale = c.replace(0, TINY)
        span = lambda x, s: x.ewm(span=s, adjust=False).mean()
        alpha = lambda x, a: x.ewm(alpha=a, adjust=False).mean()
        out = {}
        if asked("ema_", "macd_"):
            e12, e26 = span(c, 12), span(c, 26)
            dif = e12 - e26
            dea = span(dif, 9)
            out |= {"ema_12": e12 / scale, "ema_26": e26 / scale, "macd_dif": dif / scale, "macd_dea": dea / scale, "macd_hist": 2 * (dif - dea) / scale}
        if asked("rsi_"):
            d = c.diff()
            rise, fall = d.clip(lower=0), (-d).clip(lower=0)
            for p in (6, 12, 24):
                if f"rsi_{p}" in columns:
                    out[f"rsi_{p}"] = 100 - 100 / (1 + alpha(rise, 1 / p) / alpha(fall, 1 / p).replace(0, TINY))
        for p in (9, 14):
            if any(f"kdj_{x}_{p}" in columns for x in "kdj"):
                top, bottom = h.rolling(p).max(), low.rolling(p).min()
                rsv = (c - bottom) / (top - bottom).replace(0, TINY) * 100
                k = alpha(rsv, 1 / 3)
                j = alpha(k, 1 / 3)
                out |= {f"kdj_k_{p}": k, f"kdj_d_{p}": j, f"kdj_j_{p}": 3 * k - 2 * j}
        if asked("pdi", "mdi", "adx"):
            up, down = h.diff(), -low.diff()
            plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
            # the greatest that is there, as of columns side by side
            tr = pd.Series(np.fmax(np.fmax(h - low, (h - c.shift()).abs()), (low - c.shift()).abs()), index=c.index)
            wide = alpha(tr, 1 / 14).replace(0, TINY)
            pdi, mdi = 100 * alpha(plus, 1 / 14) / wide, 100 * alpha(minus, 1 / 14) / wide
            adx = alpha(100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, TINY), 1 / 14)
            out |= {"pdi": pdi, "mdi": mdi, "adx": adx, "adxr": (adx + adx.shift(14)) / 2}
        if asked("trix"):
            out["trix"] = span(span(span(c, 15), 15), 15).pct_change() * 100
        held = {n: out[n].to_numpy() for n in columns}
        return pd.DataFrame({ENTITY: pdf[ENTITY].to_numpy(), DATE: pdf[DATE].to_numpy()} | {n: np.where(np.isfinite(v), v, np.nan) for n, v in held.items()})

    kinds = dict(bars.dtypes)
    return bars.select(ENTITY, DATE, "high", "low", "close").groupBy(ENTITY).applyInPandas(run, f"{ENTITY} {kinds[ENTITY]}, {DATE} {kinds[DATE]}, " + ", ".join(f"{n} double" for n in columns))
