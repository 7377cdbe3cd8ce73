"""Spelling variants: words at distance one of each other, found by running automata over shards of a trie.

The distinct words of a corpus are sorted and cut into shards of bounded size; a task puts the words of its range into
a compact trie, whose edges are labelled with runs of letters, and which is a handful of flat arrays. Shards are
broadcast, a bounded number of bytes at a time. Each word's automaton accepts what is one inserted, deleted or replaced
letter away, and is run over the tries depth-first, for blocks of words at once.

Two words at distance one part at one place only. So a word's automaton is run over the words as they are with its edit
at the middle or after it, and over the words read from their ends with its edit before the middle: each run begins
with half of the word letter by letter, and leaves a shard at the root, before anything is sent there, if the shard's
range has no word with that half. So a word is sent to about two shards, however many there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.store import hinted, mapped, saved

#: Bytes of Latin-1: letters of words, A to Z lower-cased; the rest become spaces, as does what Latin-1 lacks.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Distinct words that a task counts before it hands its counts on.
HELD = 300_000
#: Words, and letters, of a shard; bytes of shards that a task holds at once, and groups of so many that are broadcast
#: before the next ones are; words whose automata run together.
SHARD_WORDS, SHARD_LETTERS, GROUP_BYTES, GROUPS, BLOCK = 1 << 16, 4 << 20, 32 << 20, 16, 4096
#: Letters that are compared in step for many words; what is longer is compared word by word.
STEPS = 64


def runs(doc_id: int | None, text: str, every: int) -> Iterator[tuple[bytes, int]]:
    """The words of a text in Latin-1, and how often each run stands there.

    A run loses a letter where ``every`` divides the checksum of document and run: misspellings at a known rate.
    """
    head = b":" if doc_id is None else b"%d:" % doc_id
    for run, n in Counter(text.encode("latin-1", "replace").translate(_LETTER).split()).items():
        h = zlib.crc32(head + (run if run.isascii() else run.decode("latin-1").encode()))
        if every and h % every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, letters: int = 7, least: int = 2) -> DataFrame:
    """(word, n): words of at least ``letters`` letters that occur ``least`` times or more in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in found], "n": pa.array(list(found.values()), pa.int64())})

        for b in batches:
            for i, t in zip(b["id"].to_pylist(), b["text"], strict=True):
                if t.is_valid:
                    for word, n in runs(i, t.as_py(), every):
                        if len(word) >= letters:
                            found[word] += n
                if len(found) > HELD:
                    yield out()
                    found.clear()
        yield out()

    each = mapped(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# Flat strings ---------------------------------------------------------------------------------------------

def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All letters, and where each word begins (and the last ends)."""
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in words], dtype=np.int64)])


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters, ``most`` at most, are equal from a[i] and b[j] on, for each row."""
    out = np.zeros(len(i), np.int64)
    left = np.flatnonzero(most > 0)
    for k in range(STEPS):
        left = left[a[i[left] + k] == b[j[left] + k]]
        out[left] = k + 1
        left = left[most[left] > k + 1]
        if not len(left):
            return out
    for x in left:
        n = int(most[x])
        same = np.flatnonzero(a[i[x] + STEPS : i[x] + n] != b[j[x] + STEPS : j[x] + n])
        out[x] = STEPS + same[0] if len(same) else n
    return out


# Tries ----------------------------------------------------------------------------------------------------

_ARRAYS = [("key", np.int64), ("kid", np.int32), ("start", np.int32), ("size", np.int32), ("word", np.int32), ("n", np.int64), ("first", np.int32), ("letters", np.uint8)]


class Trie:
    """A shard: nodes by number, the root 0. ``key`` is parent * 256 + first letter of each edge, sorted, and ``kid``
    where it leads; a node's edge is letters[start:start + size], its word a place in ``n`` and ``first``, or -1."""

    def __init__(self, blob: bytes | memoryview):
        sizes, at = np.frombuffer(blob, np.int64, len(_ARRAYS)), len(_ARRAYS) * 8
        for (name, kind), n in zip(_ARRAYS, sizes, strict=True):
            setattr(self, name, np.frombuffer(blob, kind, int(n), at))
            at += int(n) * np.dtype(kind).itemsize

    @staticmethod
    def packed(words: list[bytes], n: list[int]) -> bytes:
        """The trie of sorted distinct words."""
        letters, first = _flat(words)
        length = np.diff(first)
        shared = np.zeros(len(words), np.int64)
        shared[1:] = common(letters, first[:-2], letters, first[1:-1], np.minimum(length[:-1], length[1:]))
        depth, parent, told, word = [0], [-1], [0], [-1]
        path = [0]
        for i, (known, m) in enumerate(zip(shared.tolist(), length.tolist(), strict=True)):
            last = -1
            while depth[path[-1]] > known:
                last = path.pop()
            if depth[path[-1]] < known:  # parts an edge
                depth.append(known)
                parent.append(path[-1])
                told.append(i)
                word.append(-1)
                parent[last] = len(depth) - 1
                path.append(len(depth) - 1)
            depth.append(m)
            parent.append(path[-1])
            told.append(i)
            word.append(i)
            path.append(len(depth) - 1)
        depth_, parent_ = np.array(depth), np.array(parent)
        begin = np.where(parent_ < 0, 0, depth_[parent_])
        start = first[np.array(told)] + begin
        key = parent_[1:] * 256 + letters[start[1:]]
        kid = np.argsort(key)
        values = {"key": key[kid], "kid": kid + 1, "start": start, "size": depth_ - begin, "word": word, "n": n, "first": first, "letters": letters}
        arrays = [np.ascontiguousarray(values[name], kind) for name, kind in _ARRAYS]
        return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *[x.tobytes() for x in arrays]])

    def text(self, i: int) -> bytes:
        return self.letters[self.first[i] : self.first[i + 1]].tobytes()


class Automata:
    """Distance-one automata of a block of words, run over a trie with the edit at ``half`` of each word or later.

    States are rows (word, node, letters of the word that are read), with or without the edit made. A row that has made
    it goes on letter by letter; one that has not parts from the word at each edge but one. Rows are taken from a stack
    of blocks, so few are held at once.
    """

    def __init__(self, trie: Trie, words: list[bytes], half: np.ndarray):
        self.trie, self.half = trie, half
        letters, self.first = _flat(words)
        self.letters = np.concatenate([letters, np.zeros(1, np.uint8)])  # one more, so the letter after the last can be read
        self.length = np.diff(self.first)
        self.stack: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]] = []
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []

    def _push(self, edited: bool, w: np.ndarray, node: np.ndarray, d: np.ndarray) -> None:
        for lo in range(0, len(w), 4 * BLOCK):
            self.stack.append((edited, w[lo : lo + 4 * BLOCK], node[lo : lo + 4 * BLOCK], d[lo : lo + 4 * BLOCK]))

    def _rest(self, w: np.ndarray, d: np.ndarray, node: np.ndarray, skip: np.ndarray) -> None:
        """The edit is made: the rest of the node's edge has to be the word's next letters."""
        need = self.trie.size[node] - skip
        ok = self.length[w] - d >= need
        w, d, node, skip, need = w[ok], d[ok], node[ok], skip[ok], need[ok]
        ok = common(self.letters, self.first[w] + d, self.trie.letters, self.trie.start[node] + skip, need) == need
        self._push(True, w[ok], node[ok], (d + need)[ok])

    def _accept(self, w: np.ndarray, node: np.ndarray) -> None:
        found = self.trie.word[node]
        ok = found >= 0
        self.hits.append((w[ok], found[ok]))

    def _exact(self, w: np.ndarray, node: np.ndarray, d: np.ndarray) -> None:
        t = self.trie
        over = (self.length[w] == d + 1) & (d >= self.half[w])  # the last letter is deleted
        self._accept(w[over], node[over])
        low, high = np.searchsorted(t.key, node * np.int64(256)), np.searchsorted(t.key, (node + 1) * np.int64(256))
        # all edges where the edit may be made, else the one of the next letter
        early = d < self.half[w]
        at = np.searchsorted(t.key, node[early] * np.int64(256) + self.letters[self.first[w[early]] + d[early]])
        low[early], high[early] = at, np.minimum(at + 1, high[early])
        n = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(w)), n)
        edge = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(row))
        w, d, kid = w[row], d[row], t.kid[edge].astype(np.int64)
        size = t.size[kid].astype(np.int64)
        same = common(self.letters, self.first[w] + d, t.letters, t.start[kid].astype(np.int64), np.minimum(size, self.length[w] - d))
        whole = same == size
        self._push(False, w[whole], kid[whole], (d + same)[whole])
        part = ~whole & (d + same >= self.half[w])
        w, d, kid, same = w[part], (d + same)[part], kid[part], same[part]
        self._rest(w, d, kid, same + 1)  # the trie has a letter more
        inside = d < self.length[w]
        w, d, kid, same = w[inside], d[inside], kid[inside], same[inside]
        self._rest(w, d + 1, kid, same + 1)  # another letter
        self._rest(w, d + 1, kid, same)  # a letter less

    def _edited(self, w: np.ndarray, node: np.ndarray, d: np.ndarray) -> None:
        done = d == self.length[w]
        self._accept(w[done], node[done])
        w, node, d = w[~done], node[~done], d[~done]
        if not len(w) or not len(self.trie.key):
            return
        key = node * np.int64(256) + self.letters[self.first[w] + d]
        at = np.minimum(np.searchsorted(self.trie.key, key), len(self.trie.key) - 1)
        ok = self.trie.key[at] == key
        kid = self.trie.kid[at[ok]].astype(np.int64)
        self._rest(w[ok], d[ok], kid, np.zeros(len(kid), np.int64))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(word of the block, word of the trie) of each pair at distance one."""
        n = len(self.length)
        self._push(False, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))
        while self.stack:
            edited, w, node, d = self.stack.pop()
            (self._edited if edited else self._exact)(w, node, d)
        return tuple(np.concatenate([x[k] for x in self.hits] or [np.zeros(0, np.int64)]) for k in (0, 1))


# Jobs -----------------------------------------------------------------------------------------------------

def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard for each run of sorted (key, n), of bounded words and letters."""
    words: list[bytes] = []
    counts: list[int] = []
    held = 0

    def shard() -> pa.RecordBatch:
        blob = Trie.packed(words, counts)
        return pa.RecordBatch.from_pydict({"low": [words[0].decode("latin-1")], "high": [words[-1].decode("latin-1")], "size": pa.array([len(blob)], pa.int64()), "blob": [blob]})

    for b in batches:
        for word, n in zip(b["key"].to_pylist(), b["n"].to_pylist(), strict=True):
            words.append(word.encode("latin-1"))
            counts.append(n)
            held += len(word)
            if len(words) >= SHARD_WORDS or held >= SHARD_LETTERS:
                yield shard()
                words, counts, held = [], [], 0
    if words:
        yield shard()


def _halves(reverse: bool) -> tuple[Column, Column]:
    """A word as the tries of that direction have it, and the half that has to be equal there."""
    key = F.reverse("word") if reverse else F.col("word")
    half = F.floor(F.length("word") / 2)
    return key, F.substr(key, F.lit(1), (F.length("word") - half if reverse else half).cast("int"))


def _intersect(tries: Callable[[], list[bytes]], reverse: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [Trie(x) for x in tries()]
        ends = [(t.text(0), t.text(len(t.n) - 1)) for t in opened]
        for b in batches:
            all_words = [w.encode("latin-1") for w in b["key"].to_pylist()]
            for lo in range(0, len(all_words), BLOCK):
                block = all_words[lo : lo + BLOCK]
                halves = [len(w) - len(w) // 2 if reverse else len(w) // 2 for w in block]
                for trie, (low, high) in zip(opened, ends, strict=True):
                    some = [(w, h) for w, h in zip(block, halves, strict=True) if low[:h] <= w[:h] <= high]
                    if some:
                        own, half = [w for w, _ in some], np.array([h for _, h in some], np.int64)
                        yield _reduced(trie, own, *Automata(trie, own, half).run(), reverse)

    return run


_FOUND = "word string, n_near long, form string, form_n long"


def _reduced(trie: Trie, own: list[bytes], mine: np.ndarray, theirs: np.ndarray, reverse: bool) -> pa.RecordBatch:
    """Of each word the number of its neighbours, and the best of them; a neighbour whose first half is the word's was
    found in the other direction."""
    found: dict[int, tuple[int, int, bytes]] = {}
    for i, j, n in zip(mine.tolist(), theirs.tolist(), trie.n[theirs].tolist(), strict=True):
        v = trie.text(j)
        if reverse:
            v, h = v[::-1], len(own[i]) // 2
            if v[:h] == own[i][::-1][:h]:
                continue
        near, most, form = found.get(i, (0, 0, b""))
        found[i] = (near + 1, n, v) if n > most or (n == most and v < form) else (near + 1, most, form)
    words = [own[i][::-1] if reverse else own[i] for i in found]
    columns = [[w.decode("latin-1") for w in words], [x[0] for x in found.values()], [x[2].decode("latin-1") for x in found.values()], [x[1] for x in found.values()]]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "form", "form_n"])


def _merged(parts: list[DataFrame], total: int) -> DataFrame:
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    return saved(both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.*"), "near", total)


def neighbours(words: DataFrame, total: int) -> DataFrame:
    """(word, n_near, form, form_n): how many words are at distance one, and the most frequent of them (ties: the
    first); words without any are left out. ``words`` is saved and has (word, n): ``total`` distinct words of letters
    up to U+00FF."""
    spark = words.sparkSession
    done, parts, sent = [], [], []
    for reverse in (False, True):
        key, half = _halves(reverse)
        keyed = words.select(key.alias("key"), half.alias("half"), "n")
        sorted_ = keyed.select("key", "n").repartitionByRange(max(1, -(-total // SHARD_WORDS)), "key").sortWithinPartitions("key")
        shards = saved(mapped(sorted_, _build, "low string, high string, size long, blob binary"), "tries", total // SHARD_WORDS)
        ranges = [tuple(x) for x in shards.select("low", "high", "size").orderBy("low").collect()]  # three values a shard
        group: list[tuple[str, str]] = []
        held = 0
        for k, (low, high, size) in enumerate(ranges):
            group.append((low, high))
            held += size
            if k + 1 < len(ranges) and held + ranges[k + 1][2] <= GROUP_BYTES:
                continue
            least, most = group[0][0], group[-1][1]
            blobs = [bytes(x[0]) for x in shards.where(F.col("low").between(least, group[-1][0])).select("blob").collect()]  # at most GROUP_BYTES, or one shard
            sent.append(spark.sparkContext.broadcast(blobs))
            near = keyed.where((F.col("half") <= most) & (F.col("half") >= F.substr(F.lit(least), F.lit(1), F.length("half")))).select("key")
            parts.append(mapped(near, _intersect(lambda s=sent[-1]: s.value, reverse), _FOUND))
            group, held = [], 0
            if len(parts) == GROUPS:
                done.append(_merged(parts, total))
                _forget(sent)
                parts, sent = [], []
    if parts:
        done.append(_merged(parts, total))
        _forget(sent)
    if not done:
        return spark.createDataFrame([], _FOUND)
    return done[0] if len(done) == 1 else _merged(done, total)


def _forget(sent: list[Broadcast]) -> None:
    for x in sent:
        x.destroy()


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, letters: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the corpus.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A to Z lower-cased, of at least ``letters`` letters and ``least``
    occurrences; ``every`` (0: never) takes a letter out of runs at a known rate. ``n_near`` counts the words one
    inserted, deleted or replaced letter away. ``form`` is the most frequent of these (ties: the first in order of code
    points) if it occurs ``times`` as often or more, else null. ``root`` is where forms lead in the end. Null and
    empty texts have no words, a null key is an empty text where runs are hashed, repeated rows count as often as they
    stand, and a text of any length is taken whole. Other columns don't come along. An empty table has no row.
    """
    words = saved(counted(docs, key, text, every, letters, least), "words", 0)
    total = words.count()
    far = F.col("form_n") >= times * F.col("n")
    rows = words.join(neighbours(words, total), "word", "left").select(
        "word", F.when(far, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form_n")).alias("form_n")
    )
    rows = saved(rows, "forms", total)
    # each step multiplies the count, so there are as many steps as a count has digits, to the base of ``times``
    steps = hinted(rows.where("form is not null").select(F.col("word").alias("step"), F.col("form").alias("next")))
    roots, open_ = None, rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = saved(open_.join(steps, F.col("root") == F.col("step"), "left").select("word", "root", "next"), "roots", total)
        done = further.where("next is null").select("word", "root")
        roots = done if roots is None else roots.unionByName(done)
        open_ = further.where("next is not null").select("word", F.col("next").alias("root"))
        if open_.isEmpty():
            break
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
