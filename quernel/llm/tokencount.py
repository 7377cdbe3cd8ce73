"""Token counts that follow edits.

A document's pre-tokens (what the tokenizer's pattern splits it into) are the leaves' content of a segment tree
whose nodes hold sums of characters and tokens. An edit descends to its place, splits and encodes anew from the
pre-token before it, and stops at the first boundary after it that was a boundary before: from there on nothing
can change, since the pattern looks forward only. Sums on the paths from the touched leaves are then renewed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.store import free_name, mapped

#: Fixed value: the public pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOK = 2  #: characters beyond a pre-token that the pattern may look at
LEAF = 64
MAX_KNOWN = 300_000  #: pre-tokens whose counts a task remembers; it then begins anew


class Counter(dict):
    """Tokens of each pre-token, encoded once while it is remembered."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        super().__init__()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MAX_KNOWN:
            self.clear()
        # the pattern isn't run once more: the library's own matcher overflows on a pre-token of a million spaces
        n = self[piece] = len(self.encoding._encode_single_piece(piece))
        return n


class Tree:
    """A document's text and the segment tree of its pre-tokens."""

    def __init__(self, text: str, counter: Counter, pieces: tuple[list[int], list[int]] | None = None) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        if pieces is None:
            found = counter.split.findall(text)
            pieces = list(map(len, found)), [counter[p] for p in found]
        self._grow(*pieces)

    def _grow(self, sizes: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(sizes) // LEAF))
        self.base = 1 << (n - 1).bit_length()
        self.sizes = [sizes[i * LEAF : (i + 1) * LEAF] for i in range(n)] + [[] for _ in range(self.base - n)]
        self.counts = [counts[i * LEAF : (i + 1) * LEAF] for i in range(n)] + [[] for _ in range(self.base - n)]
        self.chars = [0] * self.base + [sum(x) for x in self.sizes]
        self.tokens = [0] * self.base + [sum(x) for x in self.counts]
        for i in range(self.base - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def pieces(self) -> tuple[list[int], list[int]]:
        return [x for leaf in self.sizes for x in leaf], [x for leaf in self.counts for x in leaf]

    def _leaf(self, pos: int) -> tuple[int, int]:
        """The leaf with the character at ``pos``, and where it begins."""
        i, at = 1, 0
        while i < self.base:
            i *= 2
            if pos >= at + self.chars[i] and self.chars[i + 1]:
                at += self.chars[i]
                i += 1
        return i - self.base, at

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` (both cut to the text) by ``insert``."""
        start = min(max(start, 0), len(self.text))
        length = min(max(length, 0), len(self.text) - start)
        end, shift = start + length, len(insert) - length
        self.text = self.text[:start] + insert + self.text[end:]
        first, begin = self._leaf(max(start - LOOK, 0))
        keep = 0
        while keep < len(self.sizes[first]) and begin + self.sizes[first][keep] <= start - LOOK:
            begin += self.sizes[first][keep]
            keep += 1
        # old pre-tokens from here on, leaf by leaf, until a new boundary after the edit meets an old one
        leaf, turn, old = first, keep, begin
        sizes, counts, at = [], [], begin
        for m in self.counter.split.finditer(self.text, begin):
            sizes.append(m.end() - m.start())
            counts.append(self.counter[m[0]])
            at = m.end()
            if at - shift >= end:
                while old < at - shift:
                    while turn >= len(self.sizes[leaf]):
                        leaf, turn = leaf + 1, 0
                    old += self.sizes[leaf][turn]
                    turn += 1
                if old == at - shift:
                    break
        else:
            leaf, turn = self.base - 1, len(self.sizes[-1])
        self.encoded += len(sizes)
        new = self.sizes[first][:keep] + sizes + self.sizes[leaf][turn:], self.counts[first][:keep] + counts + self.counts[leaf][turn:]
        for i in range(first, leaf + 1):
            self.sizes[i], self.counts[i] = [], []
        self.sizes[first], self.counts[first] = new
        if len(new[0]) > 4 * LEAF:
            self._grow(*self.pieces())
            return
        self._renew(first, leaf)

    def _renew(self, first: int, last: int) -> None:
        low, high = first + self.base, last + self.base
        for i in range(low, high + 1):
            self.chars[i], self.tokens[i] = sum(self.sizes[i - self.base]), sum(self.counts[i - self.base])
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self._add(i)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def grow(df: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the text, and its tree as (sizes, counts) of its pre-tokens, to be kept for edits.

    An empty text has an empty tree and a null text has null in both.
    """
    ranks = _read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                grown = [None if t is None else Tree(t, counter).pieces() for t in part["text"].to_pylist()]
                lists = [pa.array([g and g[i] for g in grown], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), part["text"], *lists], names=[*keep, "text", "sizes", "counts"])

    own = df.select(*keep, F.col(text).cast("string").alias("text"))
    fields = ", ".join(f"`{n}` {k}" for n, k in own.dtypes)
    return mapped(own, run, f"{fields}, sizes array<int>, counts array<int>")


def counted_edits(df: DataFrame, vocabulary: str, keep: list[str], text: str = "text", edits: str = "edits", sizes: str | None = None, counts: str | None = None) -> DataFrame:
    """The columns ``keep`` of all rows, with the tokens of each text before and after its edits.

    ``edits`` is an array of (start, length, insert), in characters, each on the text that the ones before it
    left; parts beyond the text are cut off, a null insert is empty, and null edits are none. Trees come from
    the columns ``sizes`` and ``counts`` if given, else from the text. Adds n_pretokens (before), n_tokens,
    n_tokens_edited, n_reencoded (pre-tokens that the edits encoded anew) and text_edited; a null text has null
    in all of them. Rows are neither merged nor dropped.
    """
    ranks = _read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                rows = zip(*(x.to_pylist() for x in part.columns[len(keep) :]), strict=True)
                got = []
                for content, changes, s, c in rows:
                    if content is None:
                        got.append((None,) * 5)
                        continue
                    tree = Tree(content, counter, None if s is None else (s, c))
                    n, before = sum(map(len, tree.sizes)), tree.total
                    for change in changes or ():
                        if change is not None:
                            tree.edit(change["start"] or 0, change["length"] or 0, change["insert"] or "")
                    got.append((n, before, tree.total, tree.encoded, tree.text))
                columns = list(zip(*got, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=[*keep, *_ADDED])

    none = F.lit(None).cast("array<int>")
    own = df.select(
        *keep, F.col(text).cast("string").alias(free_name(df, "own_text")), F.col(edits).cast("array<struct<start:int,length:int,insert:string>>").alias(free_name(df, "own_edits")),
        (F.col(sizes) if sizes else none).alias(free_name(df, "own_sizes")), (F.col(counts) if counts else none).alias(free_name(df, "own_counts")),
    )
    fields = ", ".join(f"`{n}` {k}" for n, k in df.select(*keep).dtypes)
    return mapped(own, run, f"{fields}, n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long, text_edited string")


_ADDED = ["n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded", "text_edited"]
