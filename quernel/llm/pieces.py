"""SentencePiece encoding and decoding of whole columns.

Texts are cut into marked words (a run of spaces and what follows), and these where no piece of the vocabulary
could join two characters, so parts are encoded by themselves with the same result. Distinct parts are sorted,
which lays them out as a trie in depth-first order, and a forward pass walks it: the state of each prefix is
kept while words go on from it, so a shared prefix is scored once.

For a unigram model the state of a prefix is the best score of its segmentations and their last piece. For a
BPE model it is the last piece of the one segmentation of the prefix that the merges give: a segmentation is
that one exactly if each two neighbouring pieces, merged by themselves, stay those two pieces, so a piece may
end a prefix if it fits the state at which it begins. These are the ids that the library gives; those of a
unigram model are a best-scoring segmentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.bytetok import BASE, BASE_INVERSE, mix, power
from quernel.store import free_name, mapped

MARK = "▁"
#: Distinct parts of marked words that a task remembers; it then begins anew.
MAX_PARTS = 600_000
#: Characters that are taken together.
SEGMENT = 1 << 18
#: Pairs of pieces of which a task remembers whether merges keep them apart.
MAX_FITS = 400_000
_WIDE = 1 << 22  #: beyond any piece's id, and any character's number
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class _Known:
    """Row numbers of distinct 64-bit hashes, by open addressing over whole arrays."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << 12, np.uint64)
        self.slots = np.full(1 << 14, -1, np.int32)
        self.n = 0

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def rows(self, h: np.ndarray) -> np.ndarray:
        """-1 for those not known."""
        out = self.slots[self._at(h)]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        at = self._at(h[wrong])
        while len(wrong):
            at = (at + 1) & (len(self.slots) - 1)
            row = self.slots[at]
            out[wrong] = row
            go = (row >= 0) & (self.keys[row] != h[wrong])
            wrong, at = wrong[go], at[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct ones that aren't known get the next numbers."""
        n = self.n + len(h)
        if n > len(self.keys):
            self.keys = np.resize(self.keys, 2 * n)
        self.keys[self.n : n] = h
        new = np.arange(self.n, n, dtype=np.int32)
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n).bit_length(), -1, np.int32)
            new = np.arange(n, dtype=np.int32)
        self.n = n
        at = self._at(self.keys[new])
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            left = self.slots[at] != new
            new, at = new[left], (at[left] + 1) & (len(self.slots) - 1)


def _shared(parts: list[str]) -> list[int]:
    """How many first characters each of sorted parts has in common with the one before."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start, out = np.cumsum(size) - size, np.zeros(len(parts), np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    own = np.arange(1, len(parts))
    for n in range(64):
        own = own[(size[own] > n) & (size[own - 1] > n)]
        own = own[codes[start[own] + n] == codes[start[own - 1] + n]]
        out[own] = n + 1
    for i in own.tolist():
        a, b = parts[i - 1], parts[i]
        k, most = 64, min(len(a), len(b))
        while k < most and a[k : k + 4096] == b[k : k + 4096]:
            k += 4096
        k = min(k, most)
        while k < most and a[k] == b[k]:
            k += 1
        out[i] = k
    return out.tolist()


class Pieces:
    """A model file's vocabulary, and the encoder of words over it."""

    def __init__(self, model: bytes) -> None:
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.unigram, self.prefix, extra, rules = True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.names.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                own = dict(_fields(value))
                rules, self.prefix, extra = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if rules or extra:
            raise ValueError("only models that keep texts as they are can be used: identity rules, spaces kept")
        self.score = {p: s for p, s, k in zip(self.names, scores, self.kinds, strict=True) if k in (_NORMAL, _USER, _UNUSED)}
        self.id = {p: i for i, p in enumerate(self.names) if p in self.score}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.longest = max(map(len, self.score), default=1)
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece goes on beyond a space")
        self.cut_lines = not any("\n" in p for p in self.pairs)
        self.least = min(self.score.values(), default=0.0) - 10
        self.fits: dict[int, bool] = {}
        self.traces: dict[int, tuple[bool, list[float], list[str], list[str]]] = {}
        tails: dict[str, int] = {}  # each ending of a piece, with the piece's id if it is one
        for p, i in self.id.items():
            for at in range(len(p)):
                tails.setdefault(p[at:], self.id.get(p[at:], -1))
        flat = np.frombuffer("".join(tails).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(np.fromiter(map(len, tails), np.int64, len(tails)))
        own, size, h = np.arange(len(tails)), np.diff(np.append(0, ends)), np.zeros(len(tails), np.uint64)
        for n in range(1, self.longest + 1):
            own = own[size[own] >= n]
            h[own] = h[own] * np.uint64(BASE) + flat[ends[own] - size[own] + n - 1] + np.uint64(1)
        self.tails = _Known()
        self.tails.add(mix(h + size.astype(np.uint64)))
        self.tail_ids = np.fromiter(tails.values(), np.int64, len(tails))

    def merged(self, text: str) -> list[str]:
        """BPE by itself: join the pair of best score, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _name(self, i: int) -> str:
        return self.names[i] if i >= 0 else chr(-2 - i)

    def _trace(self, i: int) -> tuple[bool, list[float], list[str], list[str]]:
        """Whether a piece's merges give it whole; their scores in turn, and its first and last part before each."""
        found = self.traces.get(i)
        if found is None:
            parts = list(self._name(i))
            scores, first, final = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                pairs = [(-self.score[p], at) for at in range(len(parts) - 1) if (p := parts[at] + parts[at + 1]) in self.score]
                if not pairs:
                    break
                lost, at = min(pairs)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(-lost)
                first.append(parts[0])
                final.append(parts[-1])
            found = self.traces[i] = len(parts) == 1, [*scores, float("-inf")], first, final
        return found

    def _fit(self, before: int | None, i: int) -> bool:
        """Whether merges leave the pair as it is: no merge across it is ever next, best score and leftmost first."""
        ok, there, heads, _ = self._trace(i)
        if ok and before is not None:
            ok, here, _, ends = self._trace(before)
            score, x, y = self.score, 0, 0
            while ok:
                across, p, q = score.get(ends[x] + heads[y]), here[x], there[y]
                if across is not None and across > p and across >= q:
                    ok = False
                elif p == q == float("-inf"):
                    break
                elif p >= q:
                    x += 1
                else:
                    y += 1
        if len(self.fits) > MAX_FITS:
            self.fits.clear()
        self.fits[i if before is None else (before + _WIDE) * _WIDE + i] = ok
        return ok

    def walk(self, parts: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct parts."""
        return (self._walk_unigram if self.unigram else self._walk_bpe)(sorted(parts))

    def _candidates(self, parts: list[str], shared: list[int]) -> tuple[list[int], list[int], list[int]]:
        """The pieces that end at each character of each part beyond what it shares with the one before: bounds by
        character, and of each piece where in its part it begins and its id (below -1: a character that is no
        piece), longest first."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        new = size - np.array(shared, np.int64)
        last = np.cumsum(new)
        within = np.arange(int(last[-1])) - np.repeat(last - size, new)  # of the character in its part
        at = within + np.repeat(np.cumsum(size) - size, new)
        own, h, step, found = np.arange(len(at)), np.zeros(len(at), np.uint64), 1, []
        for n in range(1, self.longest + 1):
            h = h + (codes[at[own] - (n - 1)] + np.uint64(1)) * np.uint64(step)
            step = step * BASE & ((1 << 64) - 1)
            row = self.tails.rows(mix(h + np.uint64(n)))
            i = np.where(row >= 0, self.tail_ids[row], -1)
            if n == 1:
                i = np.where(i >= 0, i, -2 - codes[at].astype(np.int64))
            good = np.flatnonzero(i != -1)
            found.append((own[good], within[own[good]] - (n - 1), i[good]))
            go = np.flatnonzero((row >= 0) & (within[own] >= n))
            if not len(go):
                break
            own, h = own[go], h[go]
        node, begin, i = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(node, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(node, minlength=len(at))))
        return bounds.tolist(), begin[order].tolist(), i[order].tolist()

    def _walk_bpe(self, parts: list[str]) -> dict[str, tuple[int, ...]]:
        shared = _shared(parts)
        bounds, begins, pieces = self._candidates(parts, shared) if parts else ([], [], [])
        fit, fits = self._fit, self.fits
        out, last, node = {}, [], 0  # last[i]: the piece that ends the first i + 1 characters of the path
        for part, k in zip(parts, shared, strict=True):
            del last[k:]
            for node in range(node, node + len(part) - k):  # noqa: B020
                for c in range(bounds[node], bounds[node + 1]):
                    begin, i = begins[c], pieces[c]
                    if begin:
                        before = last[begin - 1]
                        ok = fits.get((before + _WIDE) * _WIDE + i)
                    else:
                        before, ok = None, fits.get(i)
                    if ok is None:
                        ok = fit(before, i)
                    if ok:
                        last.append(i)
                        break
            node += 1
            found, end = [], len(part)
            while end:
                i = last[end - 1]
                found.append(i)
                end -= len(self.names[i]) if i >= 0 else 1
            out[part] = tuple(reversed(found)) if min(found) >= 0 else self._ids([self._name(i) for i in reversed(found)])
        return out

    def _walk_unigram(self, parts: list[str]) -> dict[str, tuple[int, ...]]:
        score, longest = self.score, self.longest
        out, last, best = {}, [], [0.0]
        for part, k in zip(parts, _shared(parts), strict=True):
            del last[k:], best[k + 1 :]
            for end in range(k + 1, len(part) + 1):
                top, won = float("-inf"), ""
                for begin in range(max(0, end - longest), end):
                    piece = part[begin:end]
                    own = score.get(piece, self.least if end - begin == 1 else None)
                    if own is not None and best[begin] + own > top:
                        top, won = best[begin] + own, piece
                best.append(top)
                last.append(won)
            found, end = [], len(part)
            while end:
                found.append(last[end - 1])
                end -= len(last[end - 1])
            out[part] = self._ids(found[::-1])
        return out

    def _ids(self, found: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in found:
            i = self.id.get(piece)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return tuple(ids)


class Encoder:
    """Rows of texts to rows of ids. Parts are cut and looked up by 64-bit hashes of whole arrays; only those not
    yet remembered are walked."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        chars = sorted({ord(c) for p in pieces.pairs for c in p})
        self.kind = np.zeros((chars[-1] if chars else 0) + 2, np.uint16 if len(chars) < 1 << 16 else np.uint32)
        self.kind[chars] = np.arange(1, len(chars) + 1)
        self.wide = len(chars) + 1
        joined = np.zeros(self.wide * self.wide, bool)
        for p in pieces.pairs:
            joined[int(self.kind[ord(p[0])]) * self.wide + int(self.kind[ord(p[1])])] = True
        self.joined = np.packbits(joined, bitorder="little")
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a part begins at each character but the first."""
        kind = self.kind[np.minimum(codes, len(self.kind) - 1)].astype(np.int64)
        pair = kind[:-1] * self.wide + kind[1:]
        return ((self.joined[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1) == 0

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        walked = self.pieces.walk(parts)
        found = [walked[p] for p in parts]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
        first, last = self.known.n, self.known.n + len(parts)
        if last > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * last), np.resize(self.sizes, 2 * last)
        self.sizes[first:last] = size
        self.starts[first:last] = self.used + np.cumsum(size) - size
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(flat)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.add(hashes)

    def _ids(self, joined: str, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of ``codes`` that begin at ``begin``, and how many each has."""
        if self.known.n > MAX_PARTS or self.used > 8 * MAX_PARTS:
            self.clear()
        end = np.append(begin[1:], len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * power(BASE_INVERSE, len(codes)), out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * power(BASE, len(codes) + 1)[begin] + (end - begin).astype(np.uint64))
        rows = self.known.rows(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            own = new[at]
            self._learn(fresh, [joined[a:z] for a, z in zip(begin[own].tolist(), end[own].tolist(), strict=True)])
            rows[new] = self.known.rows(hashes[new])
        size = self.sizes[rows].astype(np.int64)
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.starts[rows] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], size

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and the ids. A text longer than SEGMENT is cut where a part ends."""
        lead = MARK if self.pieces.prefix else ""
        marked = [lead + t.replace(" ", MARK) if t else "" for t in texts]
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        edges = np.append(0, np.cumsum(length))
        joined = "".join(marked)
        found, counts, lo = [np.zeros(0, np.int32)], np.zeros(len(joined) + 1, np.int64) if len(marked) > 1 else None, 0
        total = 0
        size = SEGMENT
        while lo < len(joined):
            part = joined[lo : lo + size]
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            first = np.empty(len(codes), bool)
            first[0] = True
            first[1:] = self._cuts(codes)
            inner = edges[np.searchsorted(edges, lo, "right") : np.searchsorted(edges, lo + len(codes), "left")] - lo
            first[inner] = True
            begin = np.flatnonzero(first)
            if lo + len(codes) < len(joined):
                if len(begin) == 1:  # one part that goes on
                    size *= 2
                    continue
                codes, begin = codes[: begin[-1]], begin[:-1]
            ids, n = self._ids(part, codes, begin)
            found.append(ids)
            if counts is not None:
                counts[lo + begin + 1] = n
            total += len(ids)
            lo, size = lo + len(codes), SEGMENT
        values = np.concatenate(found)
        bounds = np.cumsum(counts)[edges] if counts is not None else np.array([0, total])
        if not self.pieces.bytes and len(values):  # the library gives a run of unknown characters one id
            again = np.zeros(len(values), bool)
            again[1:] = (values[1:] == self.pieces.unknown) & (values[:-1] == self.pieces.unknown)
            again[bounds[:-1][bounds[:-1] < len(values)]] = False
            bounds = bounds - np.append(0, np.cumsum(again))[bounds]
            values = values[~again]
        return bounds, values


def _groups(texts: pa.Array, most: int = 1 << 18) -> Iterator[list[str | None]]:
    group, size = [], 0
    for x in texts:
        group.append(x.as_py())
        size += len(group[-1] or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


class Decoder:
    """Ids to the UTF-8 bytes of their texts."""

    def __init__(self, pieces: Pieces) -> None:
        own = [
            bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(pieces.names, pieces.kinds, strict=True)
        ]
        self.prefix = pieces.prefix
        self.size = np.array([len(x) for x in own], np.int64)
        self.first, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(own), np.uint8)

    def rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each row, without the space that encoding puts first."""
        length = self.size[ids]
        ends = np.cumsum(length)
        out = self.pool[np.repeat(self.first[ids] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        edges = np.append(0, ends)[bounds].tolist()
        rows = [out[a:z] for a, z in zip(edges, edges[1:], strict=False)]
        return [r[1:] if r[:1] == b" " else r for r in rows] if self.prefix else rows


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(group: list[str | None], bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    null = np.append([t is None for t in group], False)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=null if null.any() else None), pa.array(values))


def encode(df: DataFrame, model: str, keep: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of all rows, and ``ids`` (array of int; a column of that name is replaced).

    ``model`` is the path of a model file, read once by the driver. An empty text has no ids and a null text
    has null; whole texts are encoded, and rows are neither merged nor dropped. A U+2581 in a text is taken
    for a space, as the library takes it.
    """
    return _encoded(df, model, keep, text, ids, None)


def round_trip(df: DataFrame, model: str, keep: list[str], text: str = "text", ids: str = "ids", restored: str = "restored") -> DataFrame:
    """encode(), and whether decoding the ids gives exactly the text (null for a null text), in one pass over it."""
    return _encoded(df, model, [c for c in keep if c != restored], text, ids, restored)


def _encoded(df: DataFrame, model: str, keep: list[str], text: str, ids: str, restored: str | None) -> DataFrame:
    keep = [c for c in keep if c != ids]
    data, n = _model(model), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(data)
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for b in batches:
            at = 0
            for group in _groups(b.column(n)):
                bounds, values = encoder.rows(group)
                out = [*(b.column(i).slice(at, len(group)) for i in range(n)), _lists(group, bounds, values)]
                if restored:
                    back = decoder.rows(values, bounds)
                    out.append(pa.array([None if t is None else t.encode() == x for t, x in zip(group, back, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, ids, *([restored] if restored else [])])
                at += len(group)

    schema = df.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType()))
    schema = schema.add(restored, "boolean") if restored else schema
    return mapped(df.select(*keep, F.col(text).cast("string").alias(free_name(df, "own_text"))), run, schema)


def decode(df: DataFrame, model: str, keep: list[str], ids: str = "ids", text: str = "text") -> DataFrame:
    """The columns ``keep`` of all rows, and ``text`` (replaced) from ``ids``; null ids give a null text.

    Control pieces have no text, the unknown piece has the library's sign, and bytes that make no UTF-8
    character give U+FFFD.
    """
    keep = [c for c in keep if c != text]
    data, n = _model(model), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Pieces(data))
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                lists = part.column(n)
                bounds = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
                rows = decoder.rows(lists.flatten().to_numpy(), bounds)
                texts = [None if x else r.decode("utf-8", "replace") for x, r in zip(lists.is_null().to_pylist(), rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(texts, pa.string())], names=[*keep, text])

    schema = df.select(*keep).schema.add(text, "string")
    return mapped(df.select(*keep, F.col(ids).cast("array<int>").alias(free_name(df, "own_ids"))), run, schema)
