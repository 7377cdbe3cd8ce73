import random
import zlib

from cases import SCHEMA, odd
from pyspark.sql import functions as F

from quernel.llm import langid

SYLLABLES = {"aa": ["ka", "li", "mo", "tu", "ne", "ra"], "bb": ["sch", "ung", "ei", "ver", "ich", "acht"], "cc": ["привет", "ова", "ние", "ста", "пере", "ко"]}


def spoken(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_texts_and_unseen_words(spark):
    langs = list(SYLLABLES)
    rows = [(i, spoken(langs[i % 3], i, 5 + i % 60), langs[i % 3]) for i in range(600)]
    # words that no other text has, with their language written wrongly: only held-out rows may be wrong
    rows += [(1000 + i, spoken(langs[i % 3], -i, 30).replace(" ", "x"), None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {x.doc_id: x for x in langid.predict(df, langid.fit(df)).collect()}
    assert len(got) == 630
    assert all(got[i].held_out == held(i) for i in got)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:600])
    assert all(got[1000 + i].lang_pred == langs[i % 3] for i in range(30))


def test_held_out_rows_and_their_languages_are_not_learned(spark):
    rows = [(i, spoken("aa", i, 20), "zz" if held(i) else "aa") for i in range(80)] + [(i, spoken("bb", i, 20), "bb") for i in range(80, 160) if not held(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df)).collect()
    assert {x.lang_pred for x in got} == {"aa", "bb"}


def test_a_bound_on_the_rows_that_are_learned_from(spark):
    df = spark.createDataFrame([(i, spoken("aa", i, 20), "aa") for i in range(80)], "doc_id long, text string, lang string")
    model = langid.fit(df, max_docs=10, max_words=50, max_grams=60)
    assert len(model.words[0]) <= 50 and all(len(k) <= 60 for k, _ in model.grams)


def test_odd_rows(spark):
    rows = odd(spark)
    got = langid.predict(rows, langid.fit(rows)).collect()
    assert len(got) == 19
    of = {x.doc_id: x.lang_pred for x in got if x.doc_id is not None}
    assert [of[i] for i in (4, 5, 6, 7, 10)] == ["und"] * 5
    assert all(of[i] == "en" for i in (0, 1, 2, 3, 8, 11, 12, 13, 14, 15))
    kept = langid.identified(rows)
    assert kept.columns == rows.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [0, 1, 1, 2, 3, 8, 9, 11, 12, 13, 14, 15]


def test_no_language_to_learn_from(spark):
    rows = [(1, "some words"), (2, "12 ..."), (3, None), (4, ""), (5, "слово")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in langid.predict(df, langid.fit(df)).collect()} == {"und"}
    assert sorted(x.doc_id for x in langid.identified(df).collect()) == [1, 5]


def test_all_that_was_seen_is_kept_without_bounds(spark):
    df = spark.createDataFrame([(i, spoken("aa", i, 20), "aa") for i in range(80)], "doc_id long, text string, lang string")
    few, every = langid.fit(df, max_words=5, max_grams=5), langid.fit(df, max_words=None, max_grams=None)
    assert len(few.words[0]) == 5 < len(every.words[0]) and set(few.words[0].tolist()) <= set(every.words[0].tolist())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predict(empty, langid.fit(empty)).count() == 0 and langid.identified(empty).count() == 0


def test_nothing_is_left_out_if_asked(spark):
    """Words seen once are kept with ``least`` 1: their floor is a parameter."""
    rows = [(i, f"unique{chr(97 + i // 26)}{chr(97 + i % 26)}", "aa") for i in range(40) if not held(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {least: len(langid.fit(df, max_words=None, max_grams=None, least=least).words[0]) for least in (1, 2)}
    assert kept == {1: len(rows), 2: 0}
