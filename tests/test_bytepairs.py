import base64
import pickle
import random

import pytest
import regex
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.functions.bytepairs import PATTERN, BytePairs
from quernel.queries import RANKS

TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def plain(text):
    """Merges by a loop over all pairs, one at a time."""
    out = []
    for piece in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            found = [(TABLE[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in TABLE]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [TABLE[p] for p in parts]
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    return BytePairs.load(spark, RANKS)


def test_all_documents_by_a_plain_loop(spark, pairs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", X.token_ids("text", pairs).alias("ids")).collect()
    assert len(docs) > 900
    known = {}
    for x in docs:
        want = []
        for piece in regex.findall(PATTERN, x.text or ""):
            if piece not in known:
                known[piece] = plain(piece)
            want += known[piece]
        assert x.ids == (None if x.text is None else want)


def test_odd_texts(pairs):
    r = random.Random(5)
    signs = ["'s", " ", "  ", "\n", "\t", "a", "ab", "the", "é", "中文", "😀", "123", "...", " ", "don't", "\x00", "ﬀ"]
    for _ in range(400):
        t = "".join(r.choice(signs) for _ in range(r.randrange(30)))
        assert pairs.encode(t) == plain(t) and pairs.decode(pairs.encode(t)) == t
    assert pairs.encode("") == [] and pairs.decode([]) == ""


def test_a_pre_token_of_a_megabyte(pairs):
    t = "abcde" * 200_000
    ids = pairs.encode(t)
    assert pairs.decode(ids) == t and ids[:50] == plain("abcde" * 400)[:50]


def test_cuts_are_prefixes(spark, pairs):
    texts = ["a😀b é 中文 " * k for k in range(1, 9)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for most in (1, 2, 3, 5, 8, 13, 1000):
        got = df.select("id", X.token_limited("text", most, pairs).alias("cut"), X.token_count("text", pairs).alias("n")).collect()
        for x in got:
            t = texts[x.id]
            assert x.n == (None if t is None else len(pairs.encode(t)))
            assert x.cut == t if t is None or x.n <= most else t.startswith(x.cut) and len(pairs.encode(x.cut)) <= most + 3


def test_it_travels_as_its_file(pairs):
    again = pickle.loads(pickle.dumps(pairs))
    assert again.encode("one two") == pairs.encode("one two") and len(pickle.dumps(pairs)) < 2_000_000
