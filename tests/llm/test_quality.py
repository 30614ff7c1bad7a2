import re

import pyarrow as pa
from pyspark.sql import functions as F

from stratagrid.llm import quality
from stratagrid.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for r in runs:
        times[r] = times.get(r, 0) + 1
    hit = set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def check(docs):
    got = quality.score(docs).collect()
    want = docs.select("doc_id", "text").collect()
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, *(r[c] for c in base)) for r in got), key=key) == sorted(((r.doc_id, *brute(r.text)) for r in want), key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_base_equals_brute_force(spark, sf):
    check(table(spark, sf, "documents"))


def test_odd_rows(odd):
    check(odd.where("doc_id is null or doc_id not in (8, 12)"))
    assert quality.score(odd).count() == odd.count()


def test_empty_table(empty):
    assert quality.score(empty).count() == 0
    assert quality.clean(empty).columns == empty.columns


def test_lines_are_judged_alone():
    lines = ["Home | About | News | Contact", "Of%%% athe*** erntwh.%%% the&&&", "A plain sentence stands here, with a point.", "Please enable JavaScript to go on reading this page.", "Menu"]
    found = quality.judged(pa.RecordBatch.from_pydict({"text": ["\n".join(lines)]}))
    assert found["clean_text"] == [lines[2]]


def test_rejects_what_lost_too_much(spark):
    good = " ".join(f"word{i}" for i in range(20)) + "."
    nav = " | ".join(f"item{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good + "\n" + nav), (2, good)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.score(docs).collect()} == {1: False, 2: True}


def test_prose_is_kept(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    share = quality.score(docs).join(docs.select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p"))
    p = {r.quality: r.p for r in share.collect()}
    assert p[1] > 0.95 and p[0] < 0.3, p
