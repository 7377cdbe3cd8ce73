import collections
import re

import numpy as np
import pyarrow as pa
from cases import SCHEMA, edited, odd, prose

from quernel.llm import minhash
from quernel.llm.bytetok import chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bags(text):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text))
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None


def brute(rows, threshold=0.8):
    """Smallest id of each id's class, over all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(i, t, bags(t)) for i, t in rows if t is not None]
    for k, (i, t, x) in enumerate(own):
        for j, u, y in own[:k]:
            same = t == u
            if not same and x and y:
                shared = sum((x & y).values())
                same = shared / (sum(x.values()) + sum(y.values()) - shared) >= threshold
            if same:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in rows}


def test_equal_to_all_pairs(spark):
    rows = [(i, prose(i, 60)) for i in range(30)]
    base = prose(99, 80)
    rows += [(100 + i, edited(base, i, 1 + i % 6)) for i in range(90)]  # a cloud: some are linked, some are not
    rows += [(300 + i, edited(base, i, 1 + i % 6)) for i in range(10)]  # exact copies
    chain = prose(7, 60)
    for i in range(6):
        chain = edited(chain, 50 + i)
        rows.append((400 + i, chain))
    rows += [(500, "one two"), (501, "ONE, two!"), (502, "one"), (503, ""), (504, ""), (505, "a a a a a a a"), (506, "a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.classes(df).collect()}
    assert got == brute(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = prose(98, 80)
    rows = [(i, edited(base, i, 1 + i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in minhash.classes(df).collect()} == brute(rows)


def test_signatures_agree_as_often_as_sets_are_alike():
    base = prose(5, 400)
    texts = [base, edited(base, 1, 8), edited(base, 2, 20), prose(6, 400), "a b c " * 50, "a b c " * 40]
    sig, own = [], []
    for c in chunks(pa.array(texts)):
        cells, bounds = minhash.units(c)
        sig.append(minhash.signatures(cells, bounds, 512))
        own += [set(cells[a:z].tolist()) for a, z in zip(bounds, bounds[1:], strict=False)]
    sig = np.concatenate(sig)
    for i in range(len(texts)):
        for j in range(i):
            want = len(own[i] & own[j]) / len(own[i] | own[j])
            assert abs((sig[i] == sig[j]).mean() - want) < 0.09
    # the multisets' similarity, not the sets'
    assert len(own[4] & own[5]) / len(own[4] | own[5]) > 0.7


def test_signature_of_a_text_alone_is_that_among_others():
    texts = [prose(1, 300), "short", prose(2, 3000), "a b c d e f"]
    whole = [c for c in chunks(pa.array(texts))][0]
    cells, bounds = minhash.units(whole)
    together = minhash.signatures(cells, bounds, 64)
    for i, t in enumerate(texts):
        one = next(iter(chunks(pa.array([t]))))
        assert (minhash.signatures(*minhash.units(one), 64)[0] == together[i]).all()


def test_odd_rows(spark):
    got = minhash.classes(odd(spark)).collect()
    assert len(got) == 19
    of = {x.doc_id: x.class_id for x in got if x.doc_id is not None}
    assert of[0] == of[1] == of[2] == 0 and of[5] == of[6] == 5 and of[8] == of[9] == 8
    assert all(of[i] == i for i in (3, 4, 7, 10, 11, 12, 13, 14, 15))
    assert sum(x.class_id == 3 for x in got) in (1, 2)
    kept = minhash.one_of_each(odd(spark)).collect()
    ids = [x.doc_id for x in kept if x.doc_id is not None]
    assert sorted(ids) == [0, 3, 4, 5, 7, 8, 10, 11, 12, 13, 14, 15]


def test_null_and_repeated_ids_are_kept_by_text(spark):
    a, b, c, d, e = (prose(i, 60) for i in range(60, 65))
    rows = [
        (None, a), (None, b), (None, b), (None, edited(b, 1)), (None, None), (None, None), (1, c), (5, edited(c, 1)), (5, d), (5, d), (5, e),
        (7, edited(a, 2)), (9, edited(e, 3)), (9, None), (9, prose(65, 60)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.text) for x in minhash.one_of_each(df).collect()]
    near_b = [x for x in got if x[0] is None and x[1] is not None]
    assert len(near_b) == 1 and near_b[0][1] in (b, edited(b, 1))
    rest = [x for x in got if x not in near_b]
    want = [(None, None), (1, c), (5, d), (5, e), (7, edited(a, 2)), (9, None), (9, prose(65, 60))]
    assert sorted(rest, key=str) == sorted(want, key=str)
    classes = minhash.classes(spark.createDataFrame([(5, d), (5, e), (5, d)], "doc_id long, text string")).collect()
    assert len({x.class_id for x in classes}) == 2 and min(x.class_id for x in classes) == 5


def test_hot_head_over_salts(spark, monkeypatch):
    """A bucket head with many members is compared with them over several tasks."""
    monkeypatch.setattr(minhash, "SALT", 7)
    base = prose(97, 90)
    rows = [(i, edited(base, i, 1 + i % 4)) for i in range(150)] + [(1000 + i, base) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {x.doc_id: x.class_id for x in minhash.classes(df).collect()} == brute(rows)


def test_coarse_group_of_thousands(spark):
    """5,000 pages of one template, alike but not near; some have a near copy."""
    shared = prose(96, 60)
    rows = [(i, shared + " " + prose(10_000 + i, 45)) for i in range(4900)]
    rows += [(6000 + i, edited(rows[i * 7][1], i)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.class_id for x in minhash.classes(df).collect()}
    want = {i: i for i in range(4900)} | {6000 + i: i * 7 for i in range(100)}
    assert got == want


def test_texts_of_megabytes(spark):
    long = prose(95, 900_000)
    rows = [(0, long), (1, edited(long, 1, 2000)), (2, long), (3, prose(94, 800_000)), (4, "x" * 5_000_000), (5, prose(93, 60)), (6, edited(prose(93, 60), 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in minhash.classes(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5}


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, prose(1, 60), "p", "h", "k", "o"), (2, edited(prose(1, 60), 4), "p", "h", "k", "o"), (3, prose(2, 60), "q", "h", "k", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string, _h string, _k string, _own string")
    got = minhash.one_of_each(df)
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == [1, 3]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.classes(empty).count() == 0 and minhash.one_of_each(empty).count() == 0
