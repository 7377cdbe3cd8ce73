"""Rows that every operator on documents has to take: nulls, empty and very long texts, repeated rows, clashing names."""

import random

WORDS = [a + b for a in ("th", "on", "er", "an", "re", "st", "ing", "ed") for b in ("a", "e", "in", "ou", "le", "at", "is")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, n=1):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "zz" + r.choice(WORDS)
    return " ".join(w)


def odd_documents():
    """doc_id, text, lang, source, n_chars, and columns that operators use as names of their own."""
    a, b = prose(1, 80), prose(2, 60)
    texts = [
        (0, a), (1, a), (1, a), (2, edited(a, 3)), (3, b), (4, None), (5, ""), (6, ""), (7, "   \n\n\n\n "), (8, "one"), (9, "One!"), (10, "%%% $$$"),
        (None, b), (None, None), (11, prose(5, 30000)), (12, "x" * 70000), (13, "\n".join(["same line"] * 9)), (14, "é" * 10 + " ▁ 中文 😀"), (15, "a  b   c\t\r\nd"),
    ]
    return [(i, t, None if i == 3 else "en", None, None if t is None else len(t), "x", 7, "y", 1) for i, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, node string, n long"


def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)
