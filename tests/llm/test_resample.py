import hashlib
import math
import re
import zlib

import pytest
from cases import edited, odd, prose

from quernel.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest=2):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, bench, percent=25, least=20, seed=7, buckets=10000, longest=2):
    """A row of (n_features, weight, score, rank) for each document, in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for c, texts in ((s, [x for _, x in docs]), (t, bench)):
        for x in texts:
            for f in grams(x, longest)[1]:
                c[bucket(f)] += 1
    total, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total + buckets) / ((s[b] + 1.0) * (aim + buckets)))) for b in range(buckets)]
    out = []
    for k, (i, x) in enumerate(docs):
        n, own = grams(x, longest)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([k, i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    full = sorted((x for x in out if x[2] >= least), key=lambda x: (-x[5], x[1] is None, x[1] or 0, x[3]))
    rank = {x[0]: r for r, x in enumerate(full[: len(full) * percent // 100], 1)}
    return sorted(((x[1], *x[3:], rank.get(x[0])) for x in out), key=str)


def rows(df):
    return sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in df.collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equal_to_plain_python(spark, longest):
    docs = [(i, prose(i % 40, 5 + i % 70) + " Été 1A-b") for i in range(160)] + [(500, prose(9, 30000))]
    bench = [edited(prose(i, 40), i) for i in range(12)] + [None, ""]
    got = R.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(x,) for x in bench], "text string"), longest=longest)
    assert rows(got) == brute(docs, bench, longest=longest)
    assert {t for _, t in got.drop("doc_id").dtypes} == {"bigint"}


def test_odd_rows(spark):
    df = odd(spark)
    docs, bench = [(x.doc_id, x.text) for x in df.collect()], df.select("text").limit(3)
    want = brute(docs, [x.text for x in bench.collect()], percent=60, least=1)
    assert rows(R.resampled(df, bench, percent=60, least=1)) == want
    none = df.where("doc_id = -5")
    assert R.resampled(none, bench).count() == 0
    assert rows(R.resampled(df, none)) == brute(docs, [])
    named = df.selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "4 AS n_words", "5 AS own_key")
    assert rows(R.resampled(named, bench, percent=60, least=1)) == want
    kept = R.drawn(named, bench, percent=60, least=1)
    assert kept.columns == named.columns
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in want if x[4] is not None}
