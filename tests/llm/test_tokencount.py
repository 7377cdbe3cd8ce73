import random

from cases import SCHEMA, odd, odd_documents, prose
from pyspark.sql import functions as F

from quernel.llm import tokencount
from quernel.llm.queries import RANKS


def counter():
    with open(RANKS, "rb") as f:
        return tokencount.Counter(f.read())


def replaced(text, start, length, insert):
    start = min(max(start, 0), len(text))
    return text[:start] + insert + text[start + max(length, 0) :]


def test_edited_trees_equal_new_ones():
    known, r = counter(), random.Random(2)
    for seed in range(60):
        text = prose(seed, r.choice([0, 1, 30, 900]))
        tree = tokencount.Tree(text, known)
        for _ in range(12):
            start, length = r.randrange(-2, len(text) + 3), r.choice([0, 0, 1, 5, 40, 400])
            insert = r.choice(["", " ", "  \n", "'", "'s", "s't ", "word", " 12 3", "é中", "x" * 50, prose(seed + 1, 40), "\n\n\n   "])
            text = replaced(text, start, length, insert)
            tree.edit(start, length, insert)
            assert tree.text == text
            assert tree.pieces() == tokencount.Tree(text, known).pieces()
            assert tree.total == len(known.encoding.encode_ordinary(text))


def test_only_what_an_edit_touches_is_encoded_anew():
    tree = tokencount.Tree(prose(1, 20_000), counter())
    tree.edit(50_000, 3, "new words")
    assert 0 < tree.encoded < 12


def test_counts_and_kept_trees(spark):
    texts = [prose(i, 20 * i) for i in range(12)]
    edits = [(0, 4, "It's "), (10, 2, None), (10**6, 5, " end")]
    df = spark.createDataFrame([(i, t, edits) for i, t in enumerate(texts)], "doc_id long, text string, edits array<struct<start:int,length:int,insert:string>>")
    got = {x.doc_id: x for x in tokencount.counted_edits(df, RANKS, ["doc_id"]).collect()}
    encode = counter().encoding.encode_ordinary
    for i, text in enumerate(texts):
        after = replaced(replaced(replaced(text, *edits[0]), 10, 2, ""), *edits[2])
        assert got[i].n_tokens == len(encode(text)) and got[i].n_tokens_edited == len(encode(after)) and got[i].text_edited == after
    grown = tokencount.grow(df, RANKS, ["doc_id", "edits"])
    again = tokencount.counted_edits(grown, RANKS, ["doc_id"], sizes="sizes", counts="counts")
    assert {x.doc_id: x for x in again.collect()} == got


def test_odd_rows(spark):
    rows = odd(spark).withColumn("edits", F.when(F.col("doc_id") != 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit("é ").alias("insert")))))
    got = tokencount.counted_edits(rows, RANKS, ["doc_id", "n"]).collect()
    assert len(got) == 19 and all(x.n == 1 for x in got)
    encode = counter().encoding.encode_ordinary
    of = {x.doc_id: x for x in got if x.doc_id is not None}
    for i, t, *_ in odd_documents():
        if i is not None and i != 1:
            assert of[i].n_tokens == (None if t is None else len(encode(t)))
    assert of[0].n_tokens_edited == of[0].n_tokens and of[0].n_reencoded == 0  # null edits
    assert of[5].n_tokens == 0 and of[5].n_tokens_edited == len(encode("é "))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA + ", edits array<struct<start:int,length:int,insert:string>>")
    assert tokencount.counted_edits(empty, RANKS, ["doc_id"]).count() == 0 and tokencount.grow(empty, RANKS, ["doc_id"]).count() == 0
