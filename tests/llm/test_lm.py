import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stratagrid.llm import blocks, lm
from stratagrid.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    docs = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        docs.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall(low), "\n"]))
    one, two, three = Counter(), Counter(), Counter()
    for _, held, w in docs:
        if not held:
            one.update(w)
            two.update(zip(["\n", *w[:-1]], w))
            two["\n", "\n"] += 1
            three.update(zip(["\n", "\n", *w[:-2]], ["\n", *w[:-1]], w))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, held, w in docs:
        p = [(one[x] + 1) / (n + v + 1) for x in w]
        two_of = [(two[ab] + lm.MU2 * q) / (one[ab[0]] + lm.MU2) for ab, q in zip(zip(["\n", *w[:-1]], w), p)]
        grams = list(zip(["\n", "\n", *w[:-2]], ["\n", *w[:-1]], w))
        score = sum(math.log10((three[g] + lm.MU3 * q) / (two[g[:2]] + lm.MU3)) for g, q in zip(grams, two_of))
        out.setdefault(i, []).append((held, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p)), score, sum(map(math.log10, two_of))))
    return out


def check(docs, scores=None):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {}
    for r in (lm.score(docs) if scores is None else scores).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k])):
            assert a[:4] == b[:4]
            assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
            # entries are quantised to half a step each: a triple's, its context's, and a pair's below it
            assert abs(a[5] - b[5]) <= a[1] * 1.8 / lm.STEPS + 1e-6
            assert abs(a[6] - b[6]) <= a[1] * 0.6 / lm.STEPS + 1e-6


def test_equals_brute_force(spark, sf):
    check(table(spark, sf, "documents"))


def test_many_blocks_and_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 60_000)
    check(table(spark, sf, "documents").where("doc_id < 200"))


def test_odd_rows(odd, empty):
    check(odd)
    assert lm.score(empty).count() == 0


def test_a_stored_model_scores_the_same(spark, sf, odd, tmp_path):
    docs = table(spark, sf, "documents")
    lm.build(docs).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    assert sorted(lm.score_by(model, docs).collect(), key=key) == sorted(lm.score(docs).collect(), key=key)
    assert lm.score_by(model, odd).count() == odd.count()  # other texts, by the same model


def test_predicts_unseen_texts_better_than_lower_orders(spark, sf):
    held = lm.score(table(spark, sf, "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("pair_score").alias("p"), F.sum("base_score").alias("b")).first()
    assert held.s > held.p > held.b


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 5), (1000, 2000), (1000, 1 << 32), (5000, 1 << 45), (70_000, 1 << 17)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        held = lm.EliasFano.coded(values, universe)
        ef = lm.EliasFano(memoryview(held))
        assert ef.size == len(held) and 8 * len(held) <= len(values) * (2 + max(0, math.log2(universe / max(1, len(values))))) * 1.5 + 8 * 70
        assert (ef.get(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(rng.integers(0, 2 * universe, 500, dtype=np.uint64), values)
        assert (ef.find(other) == -1).all()


def test_trie_finds_each_ngram():
    rng = np.random.default_rng(2)
    keys = np.unique((rng.integers(0, 50, 3000, dtype=np.uint64) << np.uint64(24)) | rng.integers(0, 900, 3000, dtype=np.uint64))
    counts = rng.integers(1, 10_000, len(keys))
    trie = lm.Trie(lm.Trie.coded(keys, counts, 24))
    assert np.allclose(10 ** ((trie.find(keys) - 1.0) / lm.STEPS), counts, rtol=1e-3)
    other = np.setdiff1d((rng.integers(0, 60, 3000, dtype=np.uint64) << np.uint64(24)) | rng.integers(0, 1000, 3000, dtype=np.uint64), keys)
    assert (trie.find(other) == 0).all()
    assert (lm.Trie(lm.Trie.coded(keys[:0], counts[:0], 24)).find(keys) == 0).all()
