from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import whitening
from stratagrid.session import table

SCHEMA = "vec_id long, embedding array<float>, part int, n string, sums int, component string"


def checked(df, dims, components):
    rows = [r for r in df.select("vec_id", "embedding").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    want, deviation = centred @ axes / np.sqrt(values), ((n * x - sums) ** 2).sum(axis=1)
    got = defaultdict(list)
    for r in whitening.whitened(df, components).collect():
        got[r.component].append(r)
    assert sorted(got) == list(range(1, min(components, dims) + 1))
    total = np.trace(centred.T @ centred) / n
    for k, held in got.items():
        assert sorted((str(r.vec_id), r.deviation) for r in held) == sorted((str(r.vec_id), int(d)) for r, d in zip(rows, deviation, strict=True))
        a = sorted((str(r.vec_id), r.deviation, r.whitened) for r in held)
        b = sorted((str(r.vec_id), int(d), float(w)) for r, d, w in zip(rows, deviation, want[:, k - 1], strict=True))
        one, other = np.array([v[2] for v in a]), np.array([v[2] for v in b])
        assert min(np.abs(np.sort(one) - np.sort(s * other)).max() for s in (1, -1)) < 1e-7
        assert {r.n for r in held} == {n}
        assert all(abs(r.explained - values[k - 1] / total) < 1e-12 and r.identity_error < 1e-9 for r in held)


def test_against_the_whole_matrix(spark, sf):
    checked(table(spark, sf, "embeddings").repartition(70), 64, 32)  # three levels of merges


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 50, [float(v) for v in rng.normal(size=6) * 5 + 1000]) for i in range(60)] + [(3, [1000.0] * 6)] * 40
    rows += [(None, [1.5] * 6), (1, None), (2, []), (3, [None] * 6), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "n", 2, "c") for r in rows], SCHEMA).repartition(9)
    checked(df, 6, 32)
    assert whitening.whitened(df.where(F.lit(False))).count() == 0
    assert whitening.whitened(df.where("vec_id in (1, 2) and embedding is null")).count() == 0


def test_components_without_variance(spark):
    one = spark.createDataFrame([(1, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whitened(one).collect()] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    line = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = whitening.whitened(line).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in rows)


def test_merging_keeps_all_dimensions():
    rng = np.random.default_rng(7)
    x = rng.integers(-500, 500, (300, 12)) * np.array([1] * 6 + [1000] * 6) + 10**9
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 2, 30, 100, 200])]
    held = parts[0]
    for p in parts[1:]:
        held = held.merged(p)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert held.n == 300 and (held.sums == x.sum(axis=0)).all() and held.factor.shape == (12, 12)
    assert np.allclose(held.factor.T @ held.factor, scatter, rtol=1e-10, atol=1e-6 * np.abs(scatter).max() * 1e-6)
    with pytest.raises(ValueError, match="differ in length"):
        held.merged(whitening.Summary.of(x[:, :3]))


def test_deviation_beyond_a_long_is_null():
    x = np.array([[2**39, 0], [0, 0]])
    assert whitening.deviations(x, 10**6, np.array([0, 0])) == [None, 0]
    assert whitening.deviations(x, 3, np.array([1, 2])) == [None, 5]
    assert whitening.deviations(np.array([[2**29, 1]]), 3, np.array([1, 2])) == [(3 * 2**29 - 1) ** 2 + 1]
