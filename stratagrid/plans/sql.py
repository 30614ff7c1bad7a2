"""Pieces of the SQL that states the queries' results on the plain tables."""

from __future__ import annotations

BARS = """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1, 2"""

E = "(PARTITION BY entity ORDER BY date)"

PREPARED = f"""WITH bars AS ({BARS}),
p0 AS (SELECT *, CAST(row_number() OVER {E} AS DOUBLE) AS rn, (high + low + close) / 3 AS tp, close - lag(close) OVER {E} AS dc, volume - lag(volume) OVER {E} AS dv,
  close / lag(close) OVER {E} - 1 AS ret, ln(greatest(close / lag(close) OVER {E}, 1e-12)) AS lr,
  greatest(high - low, abs(high - lag(close) OVER {E}), abs(low - lag(close) OVER {E})) AS tr,
  ln(volume + 1) AS lv, ln(abs(volume / lag(volume) OVER {E} - 1) + 1) AS lvr FROM bars),
p AS (SELECT *, tp - lag(tp) OVER {E} AS dtp, coalesce(dc > 0, false) AS up, abs(ret) * volume AS rv FROM p0)
"""


def w(d: int) -> str:
    return f"(PARTITION BY entity ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = "(PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(x: str, d: int, agg: str = "avg") -> str:
    return f"(CASE WHEN count({x}) OVER {w(d)} = {d} THEN {agg}({x}) OVER {w(d)} END)"


def nz(x: str, guard: str = "1e-10") -> str:
    """x with 0 replaced."""
    return f"(CASE WHEN ({x}) = 0 THEN {guard} ELSE ({x}) END)"


def select(columns: dict[str, str], source: str = "p", places: int | dict[str, int] = 6, head: str = PREPARED) -> str:
    """``places`` for all columns, or for those it names (6 for others)."""
    at = places.get if isinstance(places, dict) else lambda n, other: places
    return f"{head} SELECT entity, date, " + ", ".join(f"round({e}, {at(n, 6)}) AS {n}" for n, e in columns.items()) + f" FROM {source}"
