import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import dedup


def keys(text):
    """Band keys of a text, in plain Python."""
    bands, rows = dedup.SPLITS[0.7]
    codes = [ord(c) for c in text]
    hashes = set()
    for p in range(max(len(codes) - 4, 1)):
        h = 0
        for c in codes[p : p + 5]:
            h = (h * dedup.BASE + c) % dedup.PRIME
        hashes.add(h)
    low = [min((a * h + b) % dedup.PRIME for h in hashes) for a, b in dedup.coefficients(bands * rows)]
    return {(i, tuple(low[i * rows : (i + 1) * rows])) for i in range(bands)}


def sequential(rows, reference=()):
    held, kept = set().union(*map(keys, reference)), []
    for i, fields in rows:
        own = set().union(*(keys(f) for f in fields if f is not None))
        if not own & held:
            kept.append(i)
            held |= own
    return kept


def texts(seed, n):
    r = random.Random(seed)
    out = ["", "abc", "abc", "abcd"]
    while len(out) < n:
        base = r.choice(out) if r.random() < 0.6 and len(out) > 4 else "".join(r.choice("abcdef ") for _ in range(60))
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 6])):
            if t:
                t[r.randrange(len(t))] = r.choice("xyz")
        out.append("".join(t))
    return out


def test_greedy_is_sequential(spark):
    for seed in (1, 2):
        own = texts(seed, 80)
        df = spark.createDataFrame(list(enumerate(own)), "i long, t string")
        got = sorted(x.i for x in dedup.near_dedup(df, ["t"], "i").collect())
        assert got == sequential([(i, [t]) for i, t in enumerate(own)])


def test_a_chain_is_finished_in_order(spark, monkeypatch):
    """Each text is near the one before only, so every second one stays; both ways to the end agree."""
    base = "".join(random.Random(4).choice("abcdefghij ") for _ in range(300))
    own = []
    for i in range(60):
        base = base[:5 * i] + "Z" * 5 + base[5 * i + 5 :] if i else base
        own.append(base)
    df = spark.createDataFrame(list(enumerate(own)), "i long, t string")
    want = sequential([(i, [t]) for i, t in enumerate(own)])
    for rounds in (0, 2, 99):
        monkeypatch.setattr(dedup, "ROUNDS", rounds)
        assert sorted(x.i for x in dedup.near_dedup(df, ["t"], "i").collect()) == want


def test_minima_of_many_texts(monkeypatch):
    monkeypatch.setattr(dedup, "SPAN", 64)
    own = [*texts(7, 60), "", "a", "😀" * 9, "x" * 1000]
    pairs = dedup.coefficients(18)
    a, b = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    got = dedup.minima(own, a, b)
    for t, low in zip(own, got.tolist(), strict=True):
        hashes = set()
        for p in range(max(len(t) - 4, 1)):
            h = 0
            for c in t[p : p + 5]:
                h = (h * dedup.BASE + ord(c)) % dedup.PRIME
            hashes.add(h)
        assert low == [min((x * h + y) % dedup.PRIME for h in hashes) for x, y in pairs]


def test_fields_reference_and_nulls(spark):
    own = texts(3, 60)
    rows = [(i, own[i], own[-i - 1] if i % 3 else None) for i in range(30)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    ref = [own[5], own[20]]
    bench = spark.createDataFrame([(t,) for t in ref], "text string")
    got = sorted(x.i for x in dedup.near_dedup(df, ["a", "b"], "i", bench).collect())
    assert got == sequential([(i, [a, b]) for i, a, b in rows], ref)


def test_compat_lets_short_texts_meet(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "cd"), (2, "long enough")], "i long, t string")
    assert dedup.near_dedup(df, ["t"], "i").count() == 3
    assert sorted(x.i for x in dedup.near_dedup(df, ["t"], "i", compat=True).collect()) == [0, 2]


def test_groups_are_apart(spark):
    df = spark.createDataFrame([(0, "g", "same text here"), (1, "h", "same text here"), (2, "g", "same text here")], "i long, g string, t string")
    assert sorted(x.i for x in dedup.near_dedup(df, ["t"], "i", threshold=0.9, group="g").collect()) == [0, 1]
    assert dedup.near_dedup(df.limit(0), ["t"], "i").count() == 0


def test_unequal_bands_do_not_meet(spark):
    """Pairs of unlike texts, a band of which is the same number once it is folded to 31 bits."""
    pairs = [("yyumcmtpb", "siygzvdam", 1), ("ypgheffmx", "qlbqymvxg", 3), ("kmvcdfqyu", "hygbfserm", 10)]
    for a, b, at in pairs:
        folded = set()
        for t in (a, b):
            key = at
            for x in dict(keys(t))[at]:
                key = (key * dedup.BASE + x) % dedup.PRIME
            folded.add(key)
        assert len(folded) == 1 and not keys(a) & keys(b)
    df = spark.createDataFrame([(i, t, "g") for i, t in enumerate(t for a, b, _ in pairs for t in (a, b, a))], "i long, t string, g string")
    for group in (None, "g"):
        assert sorted(x.i for x in dedup.near_dedup(df, ["t"], "i", group=group).collect()) == [0, 1, 3, 4, 6, 7]
    bench = spark.createDataFrame([(a,) for a, _, _ in pairs], "text string")
    assert sorted(x.i for x in dedup.near_dedup(df, ["t"], "i", bench).collect()) == [1, 4, 7]


def test_common_length():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in "ab")
        assert dedup.common_length(a, b) == plain(a, b)


@pytest.mark.parametrize("together", [1000, 2])
def test_rouge(spark, monkeypatch, together):
    """Against all pairs in plain Python; repeated and null ids have a row each, however the blocks fall."""
    monkeypatch.setattr(dedup, "TOGETHER", together)
    r = random.Random(6)
    some = lambda: " ".join(r.choice(["a", "B", "c3", "dd", "--"]) for _ in range(r.randint(0, 9)))
    own = [(1, "A b c"), (2, "x"), (3, None), (4, ""), (1, "a c"), (None, "q"), (None, "a")] + [(10 + i, some()) for i in range(30)]
    held = ["a c", "q", None, "a c", ""] + [some() for _ in range(12)]

    def tokens(t):
        return re.findall("[a-z0-9]+", (t or "").lower())

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    want = []
    for i, t in own:
        w = tokens(t)
        want.append((i, max([0.0, *(2 * lcs(w, v) / (len(w) + len(v)) for v in map(tokens, held) if v and w)])))
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(t,) for t in held], "text string")
    got = [(x.doc_id, x.rouge) for x in dedup.rouge_l(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x.rouge for x in dedup.rouge_l(df, bench.limit(0)).collect()} == {0.0}
    for t in (0.3, 0.7, 0.9):
        over = [(x.doc_id, x.rouge) for x in dedup.rouge_over(df, bench, threshold=t).collect()]
        assert sorted(over, key=str) == sorted(((i, v if v > t else None) for i, v in want), key=str)
    assert {x.rouge for x in dedup.rouge_over(df, bench.limit(0)).collect()} == {None}


def test_rouge_compares_only_pairs_that_can_be_over(spark):
    r = random.Random(8)
    words = [f"w{min(int(r.expovariate(0.02)), 500)}" for _ in range(4000)]
    texts = [" ".join(words[i * 20 : i * 20 + r.randrange(15, 25)]) for i in range(190)]
    near = [t.replace(" ", " extra ", 2) for t in texts[:20]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[20:] + near)], "doc_id long, text string")
    bench = spark.createDataFrame([(t,) for t in texts[:20]] * 2, "text string")
    got = {x.doc_id for x in dedup.rouge_over(df, bench).where("rouge is not null").collect()}
    assert got >= set(range(170, 190))
    lists = lambda d, i: d.select(i, F.transform(dedup.words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("hashes"))
    pairs = dedup.rouge_candidates(lists(df, F.col("doc_id").alias("id")), lists(bench.distinct(), F.monotonically_increasing_id().alias("id")), 0.7)
    assert pairs.count() < 0.25 * 190 * 20



def test_minima_at_the_ends_of_the_range(monkeypatch):
    """Remainders 0 and PRIME - 1, and neighbours, are told apart as whole numbers would be."""
    rng, p = random.Random(5), dedup.PRIME
    for _ in range(200):
        a, b = rng.choice([1, p - 1, rng.randrange(1, p)]), rng.choice([0, p - 1, rng.randrange(p)])
        back = pow(a, -1, p)
        some = [(r - b) * back % p for r in rng.choice([[0, 1, p - 1], [p - 1], [p - 2, p - 1], [rng.randrange(p)], [7, 8]])]
        h = np.array(sorted(some), np.uint64)
        monkeypatch.setattr(dedup, "shingles", lambda texts, size, h=h: (h, np.array([0])))
        assert int(dedup.minima(["x"], np.array([a], np.uint64), np.array([b], np.uint64))[0, 0]) == min((a * x + b) % p for x in some)


def test_kept_rows_stay_where_they_are(spark, monkeypatch):
    """Which rows are kept is broadcast as bits also where those are many, so texts aren't shuffled for it."""
    monkeypatch.setattr("quernel.store.MAX_BROADCAST_ROWS", 3)
    own = texts(11, 40)
    df = spark.createDataFrame([(i * 7 - 50, t) for i, t in enumerate(own)] + [(900, None)], "i long, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mark in (None, "stays"):
            got = dedup.near_dedup(df, ["t"], "i", mark=mark)
            assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
            kept = got if mark is None else got.where("stays")
            assert sorted(x.i for x in kept.collect()) == sequential([(i * 7 - 50, [t]) for i, t in enumerate(own)] + [(900, [None])])
            assert mark is None or got.count() == 41
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_among_many_ids(spark, monkeypatch):
    from quernel import store

    keys = [*range(-70, 70), 1 << 62, -(1 << 63), (1 << 63) - 1, None]
    rows = spark.createDataFrame([(k, "x") for k in keys for _ in range(2)], "k long, its_word string")
    ids = [k for k in keys if k is not None and k % 3 == 0] + [None, 5000]
    for most in (store.MAX_WORDS, 0):
        monkeypatch.setattr(store, "MAX_WORDS", most)
        got = store.among(rows, F.col("k"), spark.createDataFrame([(i,) for i in ids], "n long"))
        assert got.columns == rows.columns and sorted(x.k for x in got.collect()) == sorted(2 * [k for k in keys if k in ids and k is not None])
        said = store.among(rows, F.col("k"), spark.createDataFrame([(i,) for i in ids], "n long"), "m").collect()
        assert len(said) == 2 * len(keys) and all(x.m is (x.k is not None and x.k in ids) for x in said)
