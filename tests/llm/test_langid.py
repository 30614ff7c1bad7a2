import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import langid
from stratagrid.session import table


def grams_of(text: str):
    """Runs of 1 to 4 characters of ' word ', by a loop."""
    words = "".join(c if langid.alphabet()[0][ord(c)] else " " for c in text).split()
    for w in words:
        w = f" {''.join(chr(langid.alphabet()[1][ord(c)]) for c in w)} "
        for k in langid.ORDERS:
            for i in range(len(w) - k + 1):
                if w[i : i + k].strip():
                    yield w[i : i + k]


def bucket(gram: str) -> int:
    mask, h = (1 << 64) - 1, 0
    for k, c in enumerate(gram, 1):
        h = (h + ord(c) + k) * 0x9E3779B97F4A7C15 & mask
        h ^= h >> 29
    return (h * 0x9E3779B97F4A7C15 & mask) >> (64 - langid.BITS)


def plain(rows):
    """Naive Bayes over buckets, by dictionaries; rows are (doc_id, text, lang)."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    counts, prior = defaultdict(Counter), Counter()
    for d, text, lang in rows:
        if not held(d) and text is not None and lang is not None:
            prior[lang] += 1
            counts[lang].update(bucket(g) for g in grams_of(text))
    langs, out, cells = sorted(prior), [], 1 << langid.BITS
    step = lambda p: round(math.log(p) * (1 << langid.STEPS))
    for d, text, _ in rows:
        if not langs or not any(langid.alphabet()[0][ord(c)] == 2 for c in text or ""):
            out.append((str(d), held(d), "und", 0.0))
            continue
        bag = Counter(bucket(g) for g in grams_of(text))
        points = [step(prior[x] / sum(prior.values())) + sum(n * step((counts[x][b] + langid.SMOOTH) / (sum(counts[x].values()) + langid.SMOOTH * cells)) for b, n in bag.items()) for x in langs]
        top = max(points)
        out.append((str(d), held(d), langs[points.index(top)], 1 / sum(math.exp((p - top) / (1 << langid.STEPS)) for p in points)))
    return sorted(out)


def same(df):
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in langid.predicted(df).collect())
    want = plain([tuple(r) for r in df.select("doc_id", "text", "lang").collect()])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_brute_force(spark, sf):
    same(table(spark, sf, "documents").where("doc_id < 60 and length(text) < 5000").repartition(5))


def test_odd_rows(odd, empty):
    same(odd)
    assert langid.predicted(empty).count() == 0
    unlabelled = langid.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)} and len(unlabelled) == odd.count()


def test_scripts_marks_and_ties(spark):
    rows = [(1, "Ελληνικά λόγια", "el"), (2, "нет да", "ru"), (4, "हिन्दी भाषा", "hi"), (5, "123 --- ½ ²", "el"), (6, "É", None), (7, "ß ẞ İ", "tr"), (8, "\U0001f600", "xx"), (9, "中文", "zh"), (10, "q" * 9, None)]
    same(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_blocks_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(8)
    model = rng.integers(-(1 << 22), 0, (1 << langid.BITS, 3)).astype(np.int32)
    texts = ["".join(rng.choice(list("abcde  é."), n)).encode() for n in (0, 1, 3, 50, 5000, 7)]
    want, letters = langid.scored(texts, model[0], model)
    monkeypatch.setattr(langid, "CELLS", 90)
    assert (langid.scored(texts, model[0], model)[0] == want).all()
    apart = [langid.scored([t], model[0], model) for t in texts]
    assert (np.concatenate([a[0] for a in apart]) == want).all() and (np.concatenate([a[1] for a in apart]) == letters).all()


def test_held_out_accuracy(spark, sf):
    rows = langid.predicted(table(spark, sf, "documents")).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows) > 100


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, "a", f"l{i}") for i in range(200)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.predicted(docs)
