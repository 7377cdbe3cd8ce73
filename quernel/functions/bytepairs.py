"""Byte-pair encoding by a file of ranks: ids, counts and cuts of texts, without a tokenizer library.

A text is cut into pre-tokens by a pattern; in each, neighbouring parts are merged, the pair of lowest rank first and the
leftmost of equal ones, until no pair has a rank. Parts are a linked list and pairs wait in a heap, so a pre-token of n
bytes takes n log n steps, and a task encodes each distinct pre-token once while it remembers it.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import SparkSession

#: Fixed value: the public pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens, and bytes of them, that are remembered; then a task begins anew. A longer one than LONG never is.
KNOWN, LONG = 200_000, 1000


class BytePairs:
    """A tokenizer for the functions of ``text`` and the tasks' options: ``ranks`` is a file's content, a line of base64
    and rank for each token. It travels to tasks as these bytes, and is opened there."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self._open()

    def _open(self) -> None:
        self._rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
        self._token = {n: t for t, n in self._rank.items()}
        self._split = regex.compile(self.pattern).findall
        self._known: dict[str, list[int]] = {}

    def __getstate__(self) -> tuple[bytes, str]:
        return self.ranks, self.pattern

    def __setstate__(self, state: tuple[bytes, str]) -> None:
        self.ranks, self.pattern = state
        self._open()

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str = PATTERN) -> BytePairs:
        """From any file system that Spark reads. A vocabulary of some 50,000 tokens has less than a megabyte."""
        return cls(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), pattern)

    def _merged(self, piece: bytes) -> list[int]:
        rank = self._rank
        if piece in rank:
            return [rank[piece]]
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # where the part that begins here ends, and the one before begins
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, j, k = heappop(heap)
            if end[i] != j or end[j] != k:  # one of the two was merged meanwhile
                continue
            end[i], end[j] = k, -1
            if k < n:
                before[k] = i
                if (r := rank.get(piece[i : end[k]])) is not None:
                    heappush(heap, (r, i, k, end[k]))
            if i and (r := rank.get(piece[before[i] : k])) is not None:
                heappush(heap, (r, before[i], i, k))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        out, known = [], self._known
        for piece in self._split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._merged(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= LONG:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Where the first ids of a text end inside a character, that character is left out, so what
        comes out is a prefix of the text."""
        return b"".join([self._token[i] for i in ids]).decode("utf-8", "ignore")
