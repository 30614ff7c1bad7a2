import hashlib
import random
import re

from pyspark.sql import functions as F

from stratagrid.llm import blocks, substring
from stratagrid.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, span=20):
    docs = [(-(1 << 63) if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - span + 1):
            k = tuple(w[s : s + span])
            if k not in first or (i, s) < first[k]:
                first[k] = (i, s)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] < (i, s):
                gone.update(range(s, s + span))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(docs, span=20):
    got = substring.duplicates(docs, span).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == brute(rows, span)
    return {r.doc_id: r for r in got}


def test_equals_brute_force(spark, sf):
    check(table(spark, sf, "documents"))


def test_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 2000)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    parts = [text(40) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts)[rng.randrange(9) :] if rng.random() < 0.5 else text(17) for _ in range(6))) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), span=7)


def test_odd_rows(odd, empty):
    check(odd)
    assert substring.duplicates(empty).count() == 0


def test_factors_name_their_source(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, b), (3, f"x y {a} z {b}"), (4, " ".join(a.split()[20:]) + " " + " ".join(b.split()[:20]))]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(f) for f in got[3].factors] == [(2, 42, 1, 0), (43, 83, 2, 0)]
    assert [tuple(f) for f in got[4].factors] == [(0, 20, 1, 20), (20, 40, 2, 0)]  # no phrase goes over the seam
    assert not got[3].seams and not got[4].seams


def test_phrases_over_a_boundary_are_spans(spark):
    """The first source ends inside a phrase that only another one holds."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[25:] + b[:15])), (4, " ".join(a + b))]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(f) for f in got[4].factors] == [(0, 40, 1, 0), (40, 80, 2, 0)]
    assert [(f.source, f.start - 25, f.source_start) for f in got[4].seams] == [(3, i, i) for i in range(11)]


def rebuild(docs, span=20):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    number = {i: k for k, (i, _) in enumerate(rows)}
    words = [WORD.findall(t or "") for _, t in rows]
    got = {r.doc_id: [(f.start, f.end, number[f.source], f.source_start) for f in r.factors] for r in substring.duplicates(docs, span).collect()}
    factors = [got[i] for i, _ in rows]
    blank = [[None if any(s <= j < e for s, e, _, _ in f) else x for j, x in enumerate(w)] for w, f in zip(words, factors)]
    assert substring.rebuilt(blank, factors) == words  # every word of a factor comes from its source
    for f in factors:
        assert all(e - s >= span for s, e, _, _ in f) and all(x[1] <= y[0] for x, y in zip(f, f[1:]))
    return sum(map(len, factors))


def test_factors_rebuild_each_document(spark, sf, monkeypatch):
    assert rebuild(table(spark, sf, "documents")) > 100
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 2000)
    rng = random.Random(4)
    parts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts)[rng.randrange(9) :] for _ in range(5)) if i % 3 else "ab " * 60) for i in range(90)]
    assert rebuild(spark.createDataFrame(rows, "doc_id long, text string"), span=7) > 100
