import random
import re
import zlib
from collections import Counter

import pytest
from cases import odd, prose

from quernel.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, every=31, letters=7, least=2, times=10):
    c = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = "".join(x.lower() if x < "\x80" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= letters:
                c[run] += 1
    words = {w: n for w, n in c.items() if n >= least}
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(found[w]), None if form[w] is None else words[form[w]])
    return out


def rows(df):
    got = df.collect()
    assert len({x.word for x in got}) == len(got)
    return {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got}


def corpus(seed, docs=120):
    """Words over few letters, so that neighbours are many, with frequent ones that rare ones are near to."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abéÿ") for _ in range(r.randrange(7, 11))) for _ in range(40)]
    out = []
    for i in range(docs):
        words = []
        for _ in range(r.randrange(60)):
            w = stems[min(int(r.expovariate(0.2)), 39)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abc") + w[k:], w[:k] + r.choice("abc") + w[k + 1 :], w + "a", "b" + w])
            words.append(r.choice([w, w.upper() if r.random() < 0.1 else w]))
        out.append((i, r.choice([" ", "-", "\n", "ı", "7"]).join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_of_words(spark, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert sum(x[0] is not None for x in want.values()) > 5 and max(x[3] for x in want.values()) > 5
    assert rows(S.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == want


def test_many_small_shards_and_groups(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(S, "SHARD_WORDS", 30)
    monkeypatch.setattr(S, "GROUP_BYTES", 9000)
    monkeypatch.setattr(S, "GROUPS", 3)
    assert rows(S.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_chains_long_words_and_other_bounds(spark):
    a = "x" * 3000
    docs = [(1, f"{a} {a} {a}y {a}y y{a} y{a} {a[1:]} {a[1:]} {a}z{a} {a}z{a} {a}{a} {a}{a}")]
    docs += [(2, "abcdefg " * 2000 + "abcdefgh " * 200 + "abcdefghi " * 20 + "abcdefghij " * 2)]
    for every, letters, least, times in ((0, 7, 2, 10), (3, 1, 1, 2)):
        got = rows(S.variants(spark.createDataFrame(docs, "doc_id long, text string"), every=every, letters=letters, least=least, times=times))
        assert got == brute(docs, every, letters, least, times)
    assert rows(S.variants(spark.createDataFrame(docs[1:], "doc_id long, text string"), every=0))["abcdefghij"][1] == "abcdefg"


def test_odd_rows(spark):
    df = odd(spark)
    docs = [(x.doc_id, x.text) for x in df.collect()]
    assert rows(S.variants(df)) == brute(docs)
    empty = df.where("doc_id = -5")
    assert S.variants(empty).count() == 0 and S.variants(df.where("text is null")).count() == 0
    named = df.selectExpr("doc_id AS text", "concat(text, text) AS doc_id", "1 AS word", "2 AS form", "'k' AS key", "0 AS half")
    assert rows(S.variants(named, key="text", text="doc_id")) == brute([(i, None if t is None else t + t) for i, t in docs])


def test_one_text_and_one_word_hold_most(spark):
    docs = [(1, "overwhelming " * 40000 + prose(4, 20000))] + [(i, "overwhelmin overwhelmingx") for i in range(2, 300)]
    assert rows(S.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs)
