"""Language identification: known words first, then ever shorter character n-grams.

Each known word has a log frequency in each language. An unseen word is scored by its characters: at each of
them the longest known n-gram that begins there counts, from 5 down to 1. A text's score is the sum over its
words, so whole texts are scored in time linear in their length, by numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.bytetok import LOWER, Chunk, chunks, mix
from quernel.store import free_name, mapped, saved

GRAMS = 5
_MARK = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9FB21C651E98DF25)


class Lookup:
    """Rows of known 64-bit hashes, -1 for others; a few open tables, each for what clashed in those before."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(0))
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(8, int(len(left) * 8 - 1).bit_length())
            table = np.full(1 << bits, len(keys), dtype=np.int32)
            shift = np.uint64(64 - bits)
            at = self._at(keys[left], shift, len(self.tables))
            table[at] = left
            self.tables.append((shift, table))
            left = left[table[at] != left]

    @staticmethod
    def _at(h: np.ndarray, shift: np.uint64, turn: int) -> np.ndarray:
        return ((h * np.uint64(2 * turn + 1)) >> shift).astype(np.int64)

    def rows(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        for turn, (shift, table) in enumerate(self.tables):
            row = table[self._at(h, shift, turn)]
            np.copyto(out, row, where=self.keys[row] == h)
        out[out == len(self.keys) - 1] = -1
        return out


def _letters(c: Chunk) -> np.ndarray:
    """Words that don't begin with an ASCII digit."""
    first = c.data[c.starts]
    return np.flatnonzero((first < 48) | (first > 57))


def _spans(c: Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the given words, each word between two marks, as hashes; and the word of each."""
    data = LOWER[c.data]
    size = c.ends[words] - c.starts[words]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(c.starts[words] - (ends - size), size)
    part, owner = data[at].astype(np.uint64), np.repeat(np.arange(len(words)), size)
    lead = (part & np.uint64(0xC0)) != 0x80
    begin = np.flatnonzero(lead)
    chars = np.add.reduceat(part << (np.uint64(8) * _order(lead, begin)), begin) if len(begin) else part
    owner = owner[begin]
    n = np.bincount(owner, minlength=len(words))
    out = np.full(len(chars) + 2 * len(words), _MARK, dtype=np.uint64)
    out[np.arange(len(chars)) + 2 * owner + 1] = mix(chars + np.uint64(1))
    return out, np.repeat(np.arange(len(words)), n + 2)


def _order(lead: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Place of each byte in its character (no more than 4 in UTF-8)."""
    count = np.cumsum(lead) - 1
    return np.minimum(np.arange(len(lead)) - begin[np.maximum(count, 0)], 7).astype(np.uint64)


def _grams(chars: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n characters from each place, and the places where these are of one word."""
    if len(chars) < n:
        return chars[:0], np.zeros(0, np.int64)
    size = len(chars) - n + 1
    out = np.full(size, np.uint64(n), dtype=np.uint64)
    for j in range(n):
        out = out * _STEP + chars[j : j + size]
    at = np.flatnonzero(owner[:size] == owner[n - 1 :])
    return mix(out[at]), at


@dataclass
class Model:
    """Log frequencies by language: of words, and of n-grams in grams[n - 1]."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.n = len(model.languages)
        self.known, self.word_score = Lookup(model.words[0]), model.words[1]
        self.grams = [(Lookup(k), v) for k, v in model.grams]

    def chunk(self, c: Chunk) -> np.ndarray:
        """Scores (rows x languages)."""
        words = _letters(c)
        rows = c.word_rows()[words]
        found = self.known.rows(c.hashes()[words])
        score = self.word_score[found]
        new = np.flatnonzero(found < 0)
        if len(new):
            chars, owner = _spans(c, words[new])
            score[new] = self.spelled(chars, owner, len(new))
        out = np.zeros((c.rows, self.n))
        for i in range(self.n):
            out[:, i] = np.bincount(rows, weights=score[:, i], minlength=c.rows)
        return out

    def spelled(self, chars: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Mean, over the characters of each word, of the longest known n-gram from there."""
        open_ = np.ones(len(chars), dtype=bool)
        out, held = np.zeros((n, self.n)), np.zeros(n)
        for size in range(GRAMS, 0, -1):
            lookup, value = self.grams[size - 1]
            h, at = _grams(chars, owner, size)
            mine = open_[at]
            h, at = h[mine], at[mine]
            row = lookup.rows(h)
            hit = row >= 0
            row, at = row[hit], at[hit]
            open_[at] = False
            who = owner[at]
            held += np.bincount(who, minlength=n)
            for i in range(self.n):
                out[:, i] += np.bincount(who, weights=value[row, i], minlength=n)
        return (out / np.maximum(held, 1)[:, None]).astype(np.float32)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its key as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b["lang"].dictionary_encode()
        code = langs.indices.to_numpy()
        for c in chunks(b["text"]):
            words = _letters(c)
            if not len(words):
                continue
            own, hashes = code[c.first + c.word_rows()[words]], c.hashes()[words]
            for k in np.unique(own):
                at = words[own == k]
                h, first, n = np.unique(hashes[own == k], return_index=True, return_counts=True)
                sets = [(0, h, n)]
                chars, owner = _spans(c, at[first])
                for size in range(1, GRAMS + 1):
                    g, place = _grams(chars, owner, size)
                    g, back = np.unique(g, return_inverse=True)
                    sets.append((size, g, np.bincount(back, weights=n[owner[place]]).astype(np.int64)))
                name = langs.dictionary[int(k)]
                for size, h, n in sets:
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(name, len(h)).cast(pa.string()), pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "size", "hash", "n"],
                    )


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 20_000, max_words: int | None = 200_000, max_grams: int | None = 100_000, least: int = 2
) -> Model:
    """Learn from rows with a language that aren't held out.

    At most ``max_docs`` such rows (those of smallest hash of their key and text) are counted, and the most
    frequent ``max_words`` words and ``max_grams`` n-grams of each length that occur ``least`` times or more are
    kept: this bounds the model, which goes to the driver and to each task, whatever the table's size. None for both,
    and 1 for ``least``, keep all that those rows have.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(
        F.xxhash64(key, text).alias("_h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    last = rows.select("_h").orderBy("_h").limit(max_docs).agg(F.max("_h")).first()[0]
    if last is None:
        return Model([], (np.zeros(0, np.uint64), np.zeros((1, 0), np.float32)), [(np.zeros(0, np.uint64), np.zeros((1, 0), np.float32))] * GRAMS)
    counted = (
        mapped(rows.where(F.col("_h") <= last).select("lang", "text"), _count, "lang string, size int, hash long, n long")
        .groupBy("size", "hash", "lang")
        .agg(F.sum("n").alias("n"))
    )
    by_hash = counted.groupBy("size", "hash").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("all") >= least)
    languages = sorted(r[0] for r in rows.where(F.col("_h") <= last).select("lang").distinct().collect())
    by_hash = saved(by_hash, "frequencies")
    tables = []
    for size in range(GRAMS + 1):
        most = max_grams if size else max_words
        got = by_hash.where(F.col("size") == size).orderBy(F.desc("all"), "hash")
        got = (got if most is None else got.limit(most)).toArrow()
        keys = got["hash"].to_numpy().view(np.uint64)
        counts = np.zeros((len(keys), len(languages)))
        by = got["by"].combine_chunks()
        if len(keys):
            flat = by.flatten()
            where = np.repeat(np.arange(len(keys)), by.value_lengths().to_numpy())
            code = np.searchsorted(np.array(languages, dtype=object), np.array(flat.field("lang").to_pylist(), dtype=object))
            counts[where, code] = flat.field("n").to_numpy()
        share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(len(keys), 1))
        table = np.log(share)
        tables.append((keys, np.vstack([table, np.zeros((1, len(languages)))]).astype(np.float32)))
    return Model(languages, tables[0], tables[1:])


def _any_letter(c: Chunk) -> np.ndarray:
    low = LOWER[c.data]
    out = np.zeros(c.rows, dtype=bool)
    letter = np.append(0, np.cumsum((low >= 97) & (low <= 122)))
    out = letter[c.bounds[1:]] > letter[c.bounds[:-1]]
    for r in np.flatnonzero(~out & (np.diff(c.word_bounds) > 0)):
        out[r] = any(x.isalpha() for x in c.data[c.bounds[r] : c.bounds[r + 1]].tobytes().decode())
    return out


def with_language(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of all rows, plus lang_pred and score (columns of these names are replaced)."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    names = np.array([*model.languages, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
            for c in chunks(b.column(len(keep))):
                if not model.languages:
                    best.append(np.zeros(c.rows, np.int64))
                    share.append(np.zeros(c.rows))
                    continue
                ok = _any_letter(c)
                score = scorer.chunk(c)
                sure = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
                best.append(np.where(ok, score.argmax(axis=1), len(names) - 1))
                share.append(np.where(ok, sure, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(share))],
                names=[*keep, "lang_pred", "score"],
            )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return mapped(docs.select(*keep, F.col(text).cast("string").alias(free_name(docs, "own_text"))), run, schema)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: the share of the predicted language in the posterior).

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0, as is every
    text if no language was learned; equal scores go to the first language in order. Repeated rows come out
    as often as they are there; a null doc_id is not held out.
    """
    return with_language(docs.select(key, held_out(key).alias("held_out"), text), model, [key, "held_out"], text)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text has a language, with their columns: those predicted ``und`` go. Where no language could be
    learned, those go that have no letter."""
    model = fit(docs, key, text)
    if not model.languages:
        return docs.where(F.rlike(F.col(text).cast("string"), F.lit(r"\p{L}")))
    return with_language(docs, model, docs.columns, text).where("lang_pred <> 'und'").select(*docs.columns)
