"""Feature selection over the panel, with the SQL that states the same choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import selection as sel
from stratagrid.plans.cross_section import HEAD, panel
from stratagrid.plans.registry import query

FEATURES = ["close", "dc", "ret", "rv", "score", "tr", "volume"]
BLOCKS = {"dc": "moves", "ret": "moves", "rv": "moves", "tr": "ranges", "close": "ranges", "volume": "sizes", "score": "scores"}
SPLIT = "1999-07-01"
LABEL = "CASE WHEN fwd > 0.1 THEN 2 WHEN fwd < -0.1 THEN 0 WHEN fwd IS NOT NULL THEN 1 END"
#: One row a row and feature that has a value, with ranks of feature and outcome among these.
LONG = HEAD + ", l AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT entity, date, fwd, {LABEL} AS label, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM m WHERE fwd IS NOT NULL AND {f} IS NOT NULL" for f in FEATURES) + ")"


@query("ud16_mutual_information", LONG + """, b AS (SELECT feature, label, floor((rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS bin FROM l),
c AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS a, sum(n) OVER (PARTITION BY feature, label) AS k FROM c)
SELECT feature, sum(n)::BIGINT AS n, round(sum(n / t * ln(n * t / (a * k))), 9) AS mi FROM d GROUP BY 1""")
def mutual_information(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("label", F.expr(LABEL))
    return sel.mutual_information(rows, FEATURES, "label").withColumn("mi", F.round("mi", 9))


def forward_sql(k: int = 4) -> str:
    """Products of all pairs of columns, swept once a step."""
    names = [*FEATURES, "fwd"]
    out = HEAD + ", r AS MATERIALIZED (SELECT row_number() OVER () AS id, date < DATE '" + SPLIT + "' AS t, " + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)
    out += " FROM m WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names) + "), u AS MATERIALIZED ("
    out += " UNION ALL ".join(f"SELECT id, t, '{n}' AS i, {n} - (SELECT avg({n}) FILTER (t) FROM r) AS x FROM r" for n in names)
    out += """), g0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) FILTER (a.t) AS v, sum(a.x * b.x) FILTER (NOT a.t) AS w FROM u a JOIN u b USING (id) GROUP BY 1, 2)"""
    for s in range(k):
        out += f""", c{s} AS (SELECT d.i AS f, 1 - (y.w - 2 * e.v / d.v * e.w + e.v / d.v * e.v / d.v * d.w) / (SELECT w FROM g0 WHERE i = 'fwd' AND j = 'fwd') AS score
          FROM g{s} d JOIN g{s} e ON e.i = d.i AND e.j = 'fwd' JOIN g0 o ON o.i = d.i AND o.j = d.i CROSS JOIN (SELECT w FROM g{s} WHERE i = 'fwd' AND j = 'fwd') y
          WHERE d.i = d.j AND d.i <> 'fwd' AND d.v > 1e-10 * o.v),
        s{s} AS MATERIALIZED (SELECT f, score FROM c{s} ORDER BY score DESC, f LIMIT 1),
        g{s + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - ip.v * pj.v / pp.v AS v, g.w - ip.v / pp.v * pj.w - pj.v / pp.v * ip.w + ip.v / pp.v * pj.v / pp.v * pp.w AS w
          FROM g{s} g JOIN g{s} ip ON ip.i = g.i JOIN g{s} pj ON pj.j = g.j JOIN g{s} pp ON pp.i = pp.j AND pp.i = ip.j AND pj.i = pp.i JOIN s{s} ON pp.i = f WHERE g.i <> f AND g.j <> f)"""
    return out + " UNION ALL ".join(f" SELECT {s + 1} AS step, f AS feature, round(score, 9) AS score FROM s{s}" for s in range(k))


@query("ud16_forward", forward_sql())
def forward(spark, sf_dir):
    return sel.forward(panel(spark, sf_dir), FEATURES, "fwd", F.col("date") < F.lit(SPLIT).cast("date"), 4).withColumn("score", F.round("score", 9))


AVERAGE = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
CASES = "CASE i.feature " + " ".join(f"WHEN '{f}' THEN '{b}'" for f, b in BLOCKS.items()) + " END"


@query("ud16_thinned", LONG.replace("WITH", "WITH RECURSIVE", 1) + f""", k AS (SELECT feature, {AVERAGE.format(by="feature", x="x")} AS a, {AVERAGE.format(by="feature", x="fwd")} AS b FROM l),
i AS (SELECT feature, corr(a, b) AS ic FROM k GROUP BY 1), o AS MATERIALIZED (SELECT *, {CASES} AS block, row_number() OVER (ORDER BY round(abs(ic), 12) DESC, feature) AS place FROM i WHERE abs(ic) > 0.01),
z AS (""" + " UNION ALL ".join(f"SELECT entity, date, '{f}' AS feature, CAST(coalesce({f}, 0) AS DOUBLE) AS x FROM m WHERE fwd IS NOT NULL" for f in FEATURES) + f"""),
q AS MATERIALIZED (SELECT entity, date, feature, {AVERAGE.format(by="feature", x="x")} AS a FROM z),
n AS MATERIALIZED (SELECT x.feature, y.feature AS other, abs(corr(x.a, y.a)) AS near FROM q x JOIN q y USING (entity, date) GROUP BY 1, 2),
t AS (SELECT place, CASE WHEN true THEN [feature] END AS kept FROM o WHERE place = 1
  UNION ALL SELECT o.place, CASE WHEN EXISTS (SELECT 1 FROM n JOIN o e ON e.feature = n.other WHERE n.feature = o.feature AND list_contains(t.kept, n.other) AND e.block = o.block AND near >= 0.85) THEN t.kept ELSE list_append(t.kept, o.feature) END FROM t JOIN o ON o.place = t.place + 1)
SELECT o.feature, round(ic, 9) AS ic, o.place, list_contains((SELECT kept FROM t ORDER BY place DESC LIMIT 1), o.feature) AS kept FROM o""")
def thinned(spark, sf_dir):
    found = sel.thinned(panel(spark, sf_dir), FEATURES, "fwd", ["entity", "date"], BLOCKS)
    return found.select("feature", F.round("ic", 9).alias("ic"), F.col("place").cast("long").alias("place"), "kept")
