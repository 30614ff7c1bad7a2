"""Near copies fall as if posts were read one by one."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.functions import edits
from stratagrid.operators import text as t

DAY = datetime.date(2024, 1, 1)
SCHEMA = "k long, entity string, date date, text string, kept string"


def looped(rows, pairs):
    """Keys that stay; ``pairs`` of (later, earlier)."""
    before, kept = {}, set()
    for a, b in pairs:
        before.setdefault(a, set()).add(b)
    for k in rows:
        if not before.get(k, set()) & kept:
            kept.add(k)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_decided_is_the_loop(spark, seed):
    rng = random.Random(seed)
    pairs = {(i, i - 1) for i in range(1, 8)} if seed == 0 else {tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(90)}  # seed 0: one chain
    got = {r.k: r.kept for r in t.decided(spark.createDataFrame(list(pairs), "later long, earlier long")).collect()}
    kept = looped(range(60), pairs)
    assert got == {k: k in kept for p in pairs for k in p}


def test_no_pairs(spark):
    assert t.decided(spark.createDataFrame([], "later long, earlier long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_posts(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))

    def edited(s, n):
        s = list(s)
        for _ in range(n):
            s[rng.randrange(len(s))] = rng.choice("xyzé")
        return "".join(s)

    # a ~ b ~ c, but a and c differ: a falls to none, b falls by a, c stays
    a, b = base, edited(base, 5)
    c = edited(b, 5)
    rows = [(1, "e", 0, a), (2, "e", 1, b), (3, "e", 2, c), (4, "e", 9, a), (5, "f", 0, a), (6, "e", 0, a.upper()), (7, "e", 0, a), (8, None, 0, a), (9, "e", None, a), (10, "e", 0, None), (11, "e", 0, ""), (12, "e", 0, "ab"), (13, "e", 0, "ab"), (14, "e", 0, "ac")]
    rows += [(20 + i, "g", rng.randrange(9), edited(base, rng.randrange(7))) for i in range(40)]
    df = spark.createDataFrame([(k, e, None if d is None else DAY + datetime.timedelta(days=d), x, "other") for k, e, d, x in rows], SCHEMA).drop("kept").repartition(4)
    got = {r.k: r.kept for r in t.without_near_copies(df, "text", "k").collect()}
    order = sorted((r for r in rows if r[1] and r[2] is not None and r[3]), key=lambda r: (r[2], r[0]))
    pairs = [
        (y[0], x[0]) for i, x in enumerate(order) for y in order[i + 1 :]
        if x[1] == y[1] and y[2] - x[2] <= 3 and 1 - distance(x[3].lower(), y[3].lower()) / max(len(x[3]), len(y[3])) > 0.9
    ]
    kept = looped([r[0] for r in order], pairs)
    assert got == {r[0]: r not in order or r[0] in kept for r in rows}
    assert got[1] and not got[2] and not got[6] and not got[7] and got[4] and got[5] and not got[13] and got[14]


def test_counts_never_ask_for_more_edits_than_there_are(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
    pairs = [(word(), word()) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", t.least_edits(t.run_counts("a"), t.run_counts("b")).alias("n")).collect():
        assert r.n <= distance(r.a, r.b) + 1e-9


def test_distances_and_bounds():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé 😀") for _ in range(rng.randrange(30))) for _ in range(2))
        assert edits.distance(a, b) == distance(a, b)
        for q in (3, 5, 7, 8):
            assert edits.least(*(edits.runs(edits.code_points(x), q) for x in (a, b)), q) <= distance(a, b)
            assert np.bitwise_count(edits.bits(edits.code_points(a), q, 64) ^ edits.bits(edits.code_points(b), q, 64)).sum() <= 2 * q * distance(a, b)


@pytest.mark.parametrize("part", [1 << 23, 400])
def test_each_pair_meets_once_in_blocks_and_parts(spark, monkeypatch, part):
    """Days and lengths on both sides of every border of blocks, copies, no key and no date; also if blocks are cut to parts."""
    monkeypatch.setattr(t, "PART", part)
    rng = random.Random(8)
    rows = []
    for base in ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (8, 9, 11, 40, 41, 60, 90)):
        for _ in range(12):
            s = list(base)
            for _ in range(rng.randrange(1 + len(s) // 12)):
                s[rng.randrange(len(s))] = rng.choice(["", "x", "zé"])
            rows.append((len(rows), rng.choice("ef"), rng.randrange(14), "".join(s)))
    rows += [(None, "e", 3, rows[0][3]), (None, "e", 4, rows[0][3]), (500, "e", None, rows[0][3]), (501, None, 3, rows[0][3])]
    df = spark.createDataFrame([(k, e, None if d is None else DAY + datetime.timedelta(days=d), x) for k, e, d, x in rows], "k long, entity string, date date, text string")
    got = [(r.later, r.earlier, r.similarity) for r in t.near_pairs(df, "text", "k").collect()]
    want = set()
    for ka, ea, da, a in rows:
        for kb, eb, db, b in rows:
            if ea and ea == eb and None not in (da, db) and 0 <= da - db <= 3 and (db < da or (None not in (ka, kb) and kb < ka)):
                s = round(1 - distance(a, b) / max(len(a), len(b)), 6)
                want |= {(ka, kb, s)} if s > 0.9 else set()
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_pairs_are_sought_once(spark):
    """However often rounds ask for them, the pairs given to ``decided`` are computed once."""
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    pairs = spark.range(1, 6).select(F.udf(counted, "long")("id").alias("later"), (F.col("id") - 1).alias("earlier"))
    assert {r.k: r.kept for r in t.decided(pairs).collect()} == {k: k % 2 == 0 for k in range(6)}
    assert made.value == 5
