import hashlib
import random
import re

from cases import SCHEMA, odd, prose

from quernel.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, its = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    its |= wins[tuple(w[p : p + n])]
        names = sorted(str(x) for x in its if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontam.report(d, b).collect()), key=str) == brute(docs, items)


def test_equal_to_every_window(spark):
    r = random.Random(2)
    items = [(i, prose(100 + i, 30)) for i in range(8)]
    items += [(20, "one two three"), (21, "single"), (22, ""), (23, None), (None, prose(77, 15)), (24, items[0][1]), (25, "a " * 12), (26, prose(5, 9)), (27, prose(5, 10))]
    docs = [(4, ""), (5, None), (6, "a " * 40), (7, "Single, one-two THREE"), (7, "Single, one-two THREE"), (None, items[1][1])]
    for i in range(60):
        w = prose(i, r.choice([5, 40, 200])).split()
        for _ in range(r.choice([0, 1, 2])):
            own = (r.choice(items[:10])[1] or "x").split() or ["x"]
            a = r.randrange(len(own))
            cut = own[a : a + r.choice([5, 9, 10, 11, 30])]
            p = r.randrange(len(w))
            w[p:p] = cut
        docs.append((100 + i, r.choice([" ", ", ", " - "]).join(w).upper() if i % 3 else " ".join(w)))
    check(spark, docs, items)


def test_large_benchmark_takes_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST_ROWS", 3)
    items = [(i, prose(i, 25)) for i in range(6)] + [(9, "two words")]
    docs = [(i, prose(50 + i, 20) + " " + items[i % 6][1] + " two words") for i in range(20)] + [(30, None), (31, "clean text")]
    check(spark, docs, items)


def test_clean_texts_stay_whatever_their_ids(spark):
    item = prose(1, 40)
    rows = [(None, item), (None, prose(2, 40)), (None, None), (3, "x " + item), (3, prose(4, 40)), (3, None), (5, item)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontam.decontaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items).collect()
    assert sorted(map(tuple, clean), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    got = decontam.report(odd(spark), items).collect()
    assert len(got) == 19 and {x.doc_id for x in got if x.contaminated} == {0, 1, 2}
    clean = decontam.decontaminated(odd(spark), items)
    assert clean.columns == odd(spark).columns and clean.count() == 15
    assert decontam.report(odd(spark), items.limit(0)).where("contaminated").count() == 0
    assert decontam.report(spark.createDataFrame([], SCHEMA), items).count() == 0


def test_a_frequent_gram_of_clean_texts_meets_nothing(spark):
    """Five words that stand in every document and every item, in runs of which none is shared: no pair is compared."""
    gram = "the very same five words"
    docs = [(i, f"{prose(i, 12)} d{i}x {gram} d{i}y {prose(-i, 12)}") for i in range(150)]
    items = [(i, f"{prose(1000 + i, 9)} i{i}x {gram} i{i}y {prose(2000 + i, 9)}") for i in range(100)]
    docs += [(900, items[3][1]), (901, f"a b {items[4][1]} c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    met = decontam._met(d, b, "doc_id", "item_id", "text", 10, 5)
    assert met.where("item_id is not null and id < 900").count() <= 20  # by chance alone; all pairs would be 15,000
    check(spark, docs, items)


def test_very_long_texts(spark):
    item = prose(55, 40)
    docs = [(1, prose(6, 250_000) + " " + item + " " + prose(7, 1000)), (2, "x" * 2_000_000), (3, "a b " * 400_000)]
    check(spark, docs, [(1, item), (2, "short one"), (3, "a b " * 5 + "c")])
