import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import codes, queries
from stratagrid.session import table
from tests.oracle import differences

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, of int, cell int, x string"


def plain(rows):
    """All distances, round by round; rows are (id, vector, label)."""
    rows = [r for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(int).reshape(len(rows), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()
    for last in (False, False, False, False, True):
        d = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        who, error = d.argmin(-1), d.min(-1).sum(-1)
        for p in range(0 if last else 4):
            for e in set(who[:, p]):
                books[p, e] = np.floor_divide(x[who[:, p] == e, p].sum(0), (who[:, p] == e).sum())
    labels = {}
    for r, e in zip(rows, error, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{i:02x}" for i in w), int(e), labels[r[2]], sha) for r, w, e in zip(rows, who, error, strict=True))


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compressed(df).collect())


def test_sql(spark, sf):
    assert differences(spark, sf, queries.op11_codes, queries.ORACLES["op11_codes"]) == []


def test_brute_force(spark, sf):
    df = table(spark, sf, "embeddings")
    assert got(df.repartition(7)) == plain([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 290, [float(c) for c in rng.integers(-9, 9, 8) / 1024 * 700], int(i % 3) or None) for i in range(320)]  # ties and repeated ids
    rows += [(1, rows[1][1], 1)] * 40 + [(None, rows[5][1], None), (7, None, 1), (8, [], 1), (-4, [None] * 8, 1), (-3, [float("nan")] * 8, 1), (-2, [1.0] * 7 + [float("-inf")], 2)]
    df = spark.createDataFrame([(*r, "c", 1, 2, 3, "x") for r in rows], SCHEMA).repartition(5)
    assert got(df) == plain(rows)
    few = df.where("vec_id < 9")
    assert got(few) == plain([r for r in rows if r[0] is not None and r[0] < 9])
    assert codes.compressed(df.where(F.lit(False))).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], "vec_id long, embedding array<float>, label int")).collect()


@pytest.mark.parametrize("scale", [1, 1 << 14])  # doubles, and integers beyond them
def test_tree_finds_the_first_nearest(scale):
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (30, 16))
    entries = centres[rng.integers(0, 30, 250)] + rng.integers(-2, 3, (250, 16))
    entries[200:] = entries[:50]  # equal entries
    q = np.concatenate([entries, centres[rng.integers(0, 30, 2000)] + rng.integers(-3, 4, (2000, 16))]) * scale
    tree = codes.Nearest(entries * scale)
    who, error = tree.find(q)
    d = np.array([[sum(int(v) ** 2 for v in row) for row in (x - entries * scale)] for x in q[::37]], dtype=object)
    assert (who[::37] == [list(r).index(min(r)) for r in d]).all() and (error[::37] == [min(r) for r in d]).all()
    assert tree.visits < 0.5 * len(q) * 16  # balls are left out where groups lie apart


def test_ties_on_a_lattice():
    grid = np.array([[a, b, c, d] for a in range(4) for b in range(4) for c in range(4) for d in range(4)]) * 2
    q = np.array([[a, b, c, d] for a in range(8) for b in range(8) for c in range(8) for d in range(8)])
    order = np.random.default_rng(5).permutation(256)
    who, error = codes.Nearest(grid[order]).find(q)
    d = ((q[:, None] - grid[order][None]) ** 2).sum(-1)
    assert (who == d.argmin(1)).all() and (error == d.min(1)).all()
