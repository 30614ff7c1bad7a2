import math
import random
import re
from collections import Counter

import numpy as np

from stratagrid.llm import neardup
from stratagrid.session import table
from tests.llm.conftest import LINE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weighted(texts):
    """Weight of each shingle of each text, from words, by the definition: tf * (1 + log(N / df) / log N), df to an eighth of a doubling."""
    counts = []
    for t in texts:
        w = WORD.findall(t)
        counts.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(g for c in counts for g in c)
    n = max(2, len(texts))
    idf = {g: min(2, max(1, 2 - round(8 * math.log2(k)) / 8 * math.log(2) / math.log(n))) for g, k in df.items()}
    return [{g: k * idf[g] for g, k in c.items()} for c in counts]


def all_links(rows):
    """Every pair of different texts at 0.8 or more, by the ids' texts."""
    texts = sorted({t for _, t in rows if t is not None})
    sets = weighted(texts)
    total, by = [sum(s.values()) for s in sets], {}
    for a, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(a)
    seen = {(a, b) for g in by.values() for x, a in enumerate(g) for b in g[x + 1 :]}
    found = []
    for a, b in seen:
        both = sum(min(w, sets[b][g]) for g, w in sets[a].items() if g in sets[b])
        if both / (total[a] + total[b] - both) >= 0.8:
            found.append((texts[a], texts[b]))
    return found


def brute(rows):
    """Classes by comparing all pairs."""
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, []).append(i)
    root = {t: t for t in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    linked = all_links(rows)
    for a, b in linked:
        root[find(a)] = find(b)
    out = {}
    for t in texts:
        out.setdefault(find(t), []).extend(i for i in texts[t] if i is not None)
    return {i: min(c) for c in out.values() for i in c}, len(linked)


def classes(docs):
    return {r.doc_id: r.class_id for r in neardup.classes(docs).where("doc_id is not null").collect()}


def test_equals_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    want, links = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert links > 2
    assert classes(docs) == want


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_chains_and_large_groups(spark):
    """Links that only neighbours in a chain have, and a group of many different copies."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(220)]
    rows = [(i, edited(rng, base, 1)) for i in range(80)]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(100, 112):
        for _ in range(2):
            chain[rng.randrange(len(chain))] = f"new{rng.randrange(10**9)}"
        rows.append((i, " ".join(chain)))
    rows += [(i, edited(rng, [f"z{rng.randrange(10**6)}" for _ in range(60)], 0)) for i in range(200, 230)]
    want, _ = brute(rows)
    got = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want
    assert len({got[i] for i in range(80)}) == 1 and len({got[i] for i in range(100, 112)}) == 1


def test_recall_in_a_large_group(spark):
    """600 different near copies, most pairs of which are just below the threshold: no link's ends are in different classes."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(1, 9))) for i in range(600)]
    rows += [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(150))) for i in range(200)]
    linked = all_links(rows)
    got = classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    by = {t: i for i, t in rows}
    together = sum(got[by[a]] == got[by[b]] for a, b in linked)
    assert len(linked) > 1000 and together >= 0.99 * len(linked)
    assert all(got[1000 + i] == 1000 + i for i in range(200))


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """One bucket of all rows gives at most NEXT candidates a row, also where ranges meet."""
    places = [(i.to_bytes(16, "big"), [(7, i // 3)]) for i in range(2000)]
    rows = spark.createDataFrame(places, "v binary, places array<struct<bucket:bigint,deep:bigint>>").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in neardup.candidates(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, j) for i in range(2000) for j in range(i + 1, min(2000, i + neardup.NEXT + 1))}


def test_pairs_beyond_the_neighbours(spark, monkeypatch):
    """One bucket of all rows in which links lie far apart, over many cells: all links come out, or those that connect components."""
    monkeypatch.setattr(neardup, "CELL", 8)
    rng = random.Random(3)
    own = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(10)]
    texts = [" ".join([*own[i % 10], f"x{i}"]) for i in range(50)]  # i and i + 10 are a link
    codes = [bytes(len(neardup.shingled([t.encode()])[0])) for t in texts]
    key = [i.to_bytes(16, "big") for i in range(50)]
    texts = spark.createDataFrame(list(zip(key, [t.encode() for t in texts], codes, strict=True)), "v binary, text binary, codes binary")

    def found(parts, every):
        rows = spark.createDataFrame([(7, key[i], p) for i, p in enumerate(parts)], "bucket long, v binary, part long").repartition(6)
        return sorted((key.index(r.a), key.index(r.b)) for r in neardup.rest(rows, texts, 50, every).collect())

    assert found(range(50), True) == sorted((i, j) for i in range(50) for j in range(i + 10, 50, 10))
    some = found([i % 20 for i in range(50)], False)
    assert all((j - i) % 20 == 10 for i, j in some) and {i % 10 for i, _ in some} == set(range(10))


def test_classes_and_links_with_one_neighbour(spark, monkeypatch):
    """What the neighbours leave out is found: classes are those of all pairs even if each text has one neighbour, and every link can be had."""
    monkeypatch.setattr(neardup, "NEXT", 1)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(1, 9))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, n = brute(rows)
    assert classes(docs) == want
    found = neardup.links(docs, every=True)
    assert n > 400 and found.count() == found.select("a", "b").distinct().count() and 0.99 * n <= found.count() <= n


def test_a_link_whose_sketches_seldom_agree(spark):
    """Two texts at 56 of 68 that share a bucket are one class, whatever else their sketches say."""
    rng = random.Random(4)
    for _ in range(20_000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        pair = [" ".join(words), " ".join([*words, *(f"x{rng.randrange(10**6)}" for _ in range(6))])]  # 56 shingles, and 6 more of weight 2
        g, tf, doc = neardup.shingled([t.encode() for t in pair])
        df = Counter(g.tolist())
        _, samples = neardup.sampled(g, tf * neardup.rarity(np.array([8 * (df[x] - 1) for x in g.tolist()]), 2), doc, neardup.tables())
        sketch = (samples & np.uint64(255)).astype(np.uint8).T
        buckets = neardup.places(samples)[0]
        if (buckets[0] == buckets[1]).any() and not neardup.agreeing(*sketch):
            break
    else:
        raise AssertionError("no such pair")
    assert len(all_links(list(enumerate(pair)))) == 1
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert classes(docs) == {0: 0, 1: 0}
    assert neardup.links(docs, every=True).count() == 1


def test_bins_differ_no_more_than_weights():
    rng = np.random.default_rng(1)
    for sizes in ((5, 5), (40, 50), (900, 1100), (30, 9000), (1, 1)):
        one, two = (rng.choice(2**14, n, replace=False).astype(np.uint64) for n in sizes)
        a, b = (rng.choice([1.0, 1.37, 2.0, 700.0], n) for n in sizes)
        exact = Counter(dict(zip(one.tolist(), a, strict=True)))
        exact.subtract(dict(zip(two.tolist(), b, strict=True)))
        assert neardup.differing(neardup.binned(one, a), neardup.binned(two, b)) <= sum(abs(v) for v in exact.values()) + 1e-9
        assert neardup.differing(neardup.binned(one, a), neardup.binned(one, a)) == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, LINE, "a", "b", "c", "d"), (2, LINE, "e", "f", "g", "h")], "doc_id long, text string, key string, row string, v string, id string")
    assert [tuple(r) for r in neardup.keep(rows).collect()] == [(1, LINE, "a", "b", "c", "d")]


def test_odd_rows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = neardup.classes(odd).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by[4] == 4 and by[5] == 4 and by[10] == 4 and by[1] == 1 and by[2] == 2 and by[6] == 6
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.doc_id for r in rows if r.doc_id is not None} - {5, 10})
    assert neardup.classes(empty).count() == 0 and neardup.keep(empty).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    hits = tries = 0
    for _ in range(60):
        a, b = " ".join(words), edited(rng, words, 6)
        rng.shuffle(words)
        g, tf, doc = neardup.shingled([a.encode(), b.encode()])
        _, samples = neardup.sampled(g, tf.astype(float), doc, neardup.tables())
        hits += (samples[:, 0] == samples[:, 1]).sum()
        tries += neardup.SAMPLES
    ga, gb = (set(g[doc == k]) for k in (0, 1))
    alike = len(ga & gb) / len(ga | gb)
    assert abs(hits / tries - alike) < 0.03
