import itertools
import random
import struct

import pytest
import sentencepiece
from cases import SCHEMA, odd, odd_documents, prose

from quernel.llm import pieces
from quernel.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def noise(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abcdeéß中文😀 \n\t.,;12 thethe   ") for _ in range(n))


def test_same_ids_as_the_library(spark, library):
    texts = [prose(i, 50) for i in range(30)] + [noise(i, 200) for i in range(30)] + [" lead", "trail  ", "a   b", "\n\n", "x" * 3000, "Hello, World! It's 2024."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    encoded = pieces.encode(df, PIECE_MODEL, ["doc_id"])
    got = {x.doc_id: x.ids for x in encoded.collect()}
    assert all(got[i] == library.encode(t) for i, t in enumerate(texts))
    back = {x.doc_id: x.text for x in pieces.decode(encoded, PIECE_MODEL, ["doc_id"]).collect()}
    assert all(back[i] == library.decode(got[i]) == t for i, t in enumerate(texts))


def test_odd_rows(spark, library):
    rows = odd(spark)
    encoded = pieces.encode(rows, PIECE_MODEL, ["doc_id", "node"])
    got = encoded.collect()
    assert len(got) == 19 and all(x.node == "y" for x in got)
    of = {x.doc_id: x.ids for x in got if x.doc_id is not None}
    for i, t, *_ in odd_documents():
        if i is not None and i != 1:
            assert of[i] == (None if t is None else library.encode(t))
    texts = {x.doc_id: x.text for x in pieces.decode(encoded, PIECE_MODEL, ["doc_id"]).collect() if x.doc_id is not None}
    assert texts[4] is None and texts[5] == "" and texts[14] == odd_documents()[-2][1].replace("▁", " ")


def test_round_trip(spark, library):
    rows = odd(spark)
    got = pieces.round_trip(rows.withColumn("restored", rows.n), PIECE_MODEL, ["doc_id", "node", "restored"])
    assert got.columns == ["doc_id", "node", "ids", "restored"]
    want = {(x.doc_id, tuple(x.ids) if x.ids is not None else None) for x in pieces.encode(rows, PIECE_MODEL, ["doc_id"]).collect()}
    found = got.collect()
    assert len(found) == 19 and {(x.doc_id, tuple(x.ids) if x.ids is not None else None) for x in found} == want
    assert {x.doc_id: x.restored for x in found if x.doc_id is not None} == {i: None if t is None else i != 14 for i, t, *_ in odd_documents() if i is not None}


def test_texts_of_megabytes(library):
    with open(PIECE_MODEL, "rb") as f:
        encoder = pieces.Encoder(pieces.Pieces(f.read()))
    texts = [prose(3, 400_000), "", "é" * 600_000, "ab" * 500_000, noise(5, 300_000)]
    bounds, ids = encoder.rows(texts)
    assert [ids[a:z].tolist() for a, z in itertools.pairwise(bounds)] == [library.encode(t) for t in texts]


def test_pairs_that_merges_keep_apart():
    """The walk over merges of two pieces agrees with merging them from characters."""
    with open(PIECE_MODEL, "rb") as f:
        made = pieces.Pieces(f.read())
    r = random.Random(8)
    names = [p for p in made.id if len(p) < 9]
    for _ in range(3000):
        a, b = r.choice(names), r.choice(names).lstrip(pieces.MARK) or "a"
        if b in made.id:
            assert made._fit(made.id[a], made.id[b]) == (made.merged(a + b) == [a, b])


def test_whole_table_through_a_unigram_model(spark, tmp_path):
    """The scored walk, over all texts of a table: best-scoring, and decoded to the texts."""
    r = random.Random(9)
    letters = "abdehinorst▁"
    scores = {a: -6.0 - i / 7 for i, a in enumerate(letters)}
    scores |= {a + b: -r.uniform(3, 8) for a in letters for b in letters[:-1] if r.random() < 0.6}
    scores |= {"▁th": -2.0, "▁the": -1.5, "ing": -2.5, "ation": -3.0}
    path = tmp_path / "own.model"
    path.write_bytes(unigram(scores))
    texts = [prose(i, 40).replace("g", "d").replace("u", "o").replace("l", "b") for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    made = pieces.Pieces(unigram(scores))

    def best(word):
        top = [0.0]
        for end in range(1, len(word) + 1):
            top.append(max(top[end - n] + made.score[word[end - n : end]] for n in range(1, min(5, end) + 1) if word[end - n : end] in made.score))
        return top[-1]

    for x in pieces.round_trip(df, str(path), ["doc_id"]).collect():
        assert x.restored
        want = sum(best(pieces.MARK + w) for w in texts[x.doc_id].split(" "))
        assert abs(sum(made.score[made.names[i]] for i in x.ids) - want) < 1e-6


def test_empty_table(spark):
    empty = pieces.encode(spark.createDataFrame([], SCHEMA), PIECE_MODEL, ["doc_id"])
    assert empty.count() == 0 and pieces.decode(empty, PIECE_MODEL, ["doc_id"]).count() == 0


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "SEGMENT", 50)
    monkeypatch.setattr(pieces, "MAX_PARTS", 10)
    monkeypatch.setattr(pieces, "MAX_FITS", 10)
    with open(PIECE_MODEL, "rb") as f:
        encoder = pieces.Encoder(pieces.Pieces(f.read()))
    for i in range(8):
        texts = [prose(i, 40), noise(i, 60)]
        bounds, ids = encoder.rows(texts)
        assert [ids[a:z].tolist() for a, z in itertools.pairwise(bounds)] == [library.encode(t) for t in texts]


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def unigram(scores):
    """A model file of a unigram model that keeps spaces."""
    out = _field(1, _field(1, b"<unk>") + _field(3, 2))
    for piece, score in scores.items():
        out += _field(1, _field(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score))
    return out + _field(2, _field(3, 1)) + _field(3, _field(4, 0))


def test_unigram_paths_score_best():
    r = random.Random(4)
    scores = {a: -5.0 - i for i, a in enumerate("abc▁")}
    scores |= {"".join(p): -r.uniform(2, 9) for n in (2, 3) for p in itertools.product("abc", repeat=n) if r.random() < 0.5}
    scores |= {"▁a": -3.0, "▁bc": -2.5}
    made = pieces.Pieces(unigram(scores))
    exact = {p: made.score[p] for p in scores}

    def best(part):
        if not part:
            return 0.0
        return max(exact[part[:n]] + best(part[n:]) for n in (1, 2, 3) if part[:n] in exact and n <= len(part))

    parts = ["▁" + "".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(200)]
    for part, ids in made.walk(list(set(parts))).items():
        names = [made.names[i] for i in ids]
        assert "".join(names) == part and abs(sum(exact[n] for n in names) - best(part)) < 1e-9
