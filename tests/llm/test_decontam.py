import random
from itertools import combinations

from stratagrid.llm import decontam
from stratagrid.session import table


def brute(docs, items):
    """Documents with REACH aligned words of an item, or a whole short one, of which few differ."""
    out = {}
    words = lambda t: [w.decode() for w in decontam.words_of((t or "").encode())]
    held = [(k, words(t)) for k, t in items]
    for i, t in docs:
        w = words(t)
        for k, v in held:
            if not v or len(v) < decontam.LEAST and w != v:
                continue
            reach = min(decontam.REACH, len(v))
            spare = decontam.SPARE if len(v) >= decontam.REACH else len(v) // 8
            for p in range(len(w) - reach + 1):
                if any(sum(a != b for a, b in zip(w[p : p + reach], v[q : q + reach])) <= spare for q in range(len(v) - reach + 1)):
                    out.setdefault(i, set()).add(k)
                    break
    return out


def test_finds_what_brute_force_finds(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {r.doc_id: set(r.item_ids) for r in decontam.contaminated(docs, items).collect()}
    few = [(r.doc_id, r.text) for r in docs.where("doc_id in (29, 37, 39, 706, 979)").collect()]
    few += [(r.doc_id, r.text) for r in docs.where("doc_id % 100 = 3").collect()]
    want = brute(few, [(r.item_id, r.text) for r in items.collect()])
    assert {i: got[i] for i, _ in few if i in got} == want
    assert len(got) >= 20


def test_substituted_words(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(60):
        p = list(item[5:30])
        for q in range(rng.randrange(6), len(p), 9):  # one word in nine
            p[q] = f"other{q}"
        docs.append((i, "before it all " + " ".join(p) + " and after"))
    docs.append((99, " ".join(f"x{i}" for i in range(50))))
    got = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == set(range(60))


def test_short_items_case_and_marks(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "a b c"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Say: One, two; THREE four -- five six!"), (2, "a b c"), (3, "one two three four five"), (4, "it is a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_ids) for r in decontam.contaminated(docs, items).collect()) == [(1, [1]), (2, [2])]


def test_items_of_few_words_are_whole_texts_or_runs(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha"), (3, "Alpha, beta!"), (4, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta y"), (2, "Alpha -- beta"), (3, "ALPHA"), (4, "beta alpha"), (5, "alpha beta gamma delta")], "doc_id long, text string")
    found = lambda **k: sorted((r.doc_id, r.item_ids, r.n_items) for r in decontam.contaminated(docs, items, **k).collect())
    assert found() == [(2, [3, 4], 2), (3, [2], 1), (5, [1], 1)]
    assert found(least=1) == [(1, [1, 2, 3, 4], 4), (2, [2, 3, 4], 3), (3, [2], 1), (4, [2], 1), (5, [1, 2, 3, 4], 4)]
    assert found(least=4) == [(1, [1], 1), (2, [3, 4], 2), (3, [2], 1), (5, [1], 1)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [1, 4]


def test_a_phrase_of_many_items_is_compared_once(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    items = spark.createDataFrame([(i, phrase if i % 2 else f"{phrase} own{i}") for i in range(40)], "item_id int, text string")
    docs = spark.createDataFrame([(i, f"before {phrase} after") for i in range(50)], "doc_id int, text string")
    places = decontam.overlaps(docs, items)
    rows = decontam.contaminated(docs, items).collect()
    assert len(rows) == 50 and all(r.item_ids == list(range(40)) for r in rows)
    alone = decontam.overlaps(docs, items.where("item_id = 1")).where("doc_id = 3").count()
    assert places.where("doc_id = 3 and size(items) >= 20").count() >= alone > 0
    assert places.where("doc_id = 3").count() <= alone * 21  # those that end in words of their own are apart


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "The seventh letter was found under a stone by the river, and nobody could read it.")], "item_id long, text string")
    got = {r.doc_id for r in decontam.contaminated(odd, items).collect()}
    assert got == {None, 4, 5, 7, 10}
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 6
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    assert decontam.clean(odd, items.limit(0)).count() == odd.count()


def test_every_placement_of_substitutions(spark):
    """Items of all lengths from LEAST on, with as many words substituted as may be, wherever they stand."""
    items, docs = [], []
    for n in range(decontam.LEAST, 17):
        item = [f"i{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for places in combinations(range(n), decontam.SPARE if n >= decontam.REACH else n // 8):
            docs.append((len(docs), " ".join(["before", "it", *(f"other{i}" if i in places else w for i, w in enumerate(item)), "and", "after"]), n))
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int")
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert [d for d in docs if got.get(d[0]) != [d[2]]] == []


def test_short_items_spare_no_more(spark):
    docs = [(1, "x b c d e f g h"), (2, "x y c d e f g h"), (3, "x b c d e f g"), (4, "a b c d e f g h i y"), (5, "x b c d e f g h i y")]
    items = [(7, "a b c d e f g"), (8, "a b c d e f g h"), (10, "a b c d e f g h i j")]
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == {1: [8], 4: [7, 8, 10], 5: [8]}


def test_clashing_names(spark, sf):
    rows = spark.createDataFrame([(1, "a b c", "k", "b")], "doc_id long, text string, _key string, _bad string")
    assert [tuple(r) for r in decontam.clean(rows, table(spark, sf, "benchmark")).collect()] == [(1, "a b c", "k", "b")]
