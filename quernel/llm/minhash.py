"""Near-duplicate groups by DartMinHash over weighted word shingles.

A text is the multiset of its runs of five words: a run that occurs w times has weight w. The region of such
an element, w wide, gets darts at ranks that a hash gives, one unit of weight after the other, as a Poisson
process; so texts that share a unit share its darts. Darts below a rank bound, chosen so that about
k (ln k + 3) of them hit whatever the text's total weight, are dealt by hash to k coordinates, and each keeps its
earliest. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity. Signatures
are cut into bands; texts that meet in a band are compared exactly, and links are followed into groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.bytetok import Chunk, chunks, mix
from quernel.llm.decontam import bitmap, gram_hashes, in_bitmap
from quernel.store import free_name, join_groups, mapped, saved

BANDS, ROWS = 35, 6  #: similarity 0.8 is missed by all bands once in 40,000 times, 0.85 once in 10**7
COARSE = 0.45  #: members of a bucket less similar to its head than this are far from it
BLOCK = 1024  #: nodes of a coarse group that a task takes together with as many others, on average
CELLS = 1 << 18  #: cells of those nodes, on average
SALT = 2000  #: members of a head that a task compares with it
DARTS = 1 << 18  #: places where darts are thrown at once
SHINGLE = 5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _times(turn: int, by: np.uint64) -> np.uint64:
    return np.uint64(turn * int(by) & ((1 << 64) - 1))


def units(c: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle of each row, numbered by its occurrence, as a hash; and bounds by row.

    So a multiset becomes a set of unit weights. A text of fewer words than a shingle is one of its own.
    """
    words, n = c.hashes(), np.diff(c.word_bounds)
    rows = c.word_rows()
    grams = gram_hashes(words, size)
    at = np.flatnonzero(rows[: len(grams)] == rows[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    owner, value = rows[at], grams[at]
    for r in np.flatnonzero((n > 0) & (n < size)):
        a, b = c.word_bounds[r : r + 2]
        owner, value = np.append(owner, r), np.append(value, gram_hashes(words[a:b], b - a))
    # a row's shingles are sorted together: the row in the upper bits, 44 bits of the hash below
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    turn = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    bounds = np.searchsorted(key >> np.uint64(44), np.arange(c.rows + 1).astype(np.uint64))
    return mix((key & np.uint64((1 << 44) - 1)) * _A + turn.astype(np.uint64)), bounds


def _unit(h: np.ndarray) -> np.ndarray:
    """Hash to a number in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(cells: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k earliest darts of each row (rows x k); rows without cells are left 0."""
    n = len(bounds) - 1
    weight = np.diff(bounds)
    out = np.zeros((n, k), dtype=np.uint64)
    todo, darts = np.flatnonzero(weight), k * (np.log(k) + 3)
    while len(todo):
        bound = darts / weight[todo]
        got, full = _throw(cells, bounds, todo, bound, k)
        out[todo[full]] = got[full]
        todo, darts = todo[~full], darts * 2
    return out


def _throw(cells: np.ndarray, bounds: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    weight = bounds[rows + 1] - bounds[rows]
    slabs = np.ceil(bound).astype(np.int64)  # ranks [s, s + 1) of a cell are a process of their own
    size = weight * slabs
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(rows)), size)
    within = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    wide = slabs[owner]
    cell = cells[bounds[rows][owner] + within // wide]
    slab = (within % wide).astype(np.uint64)
    seed = mix(cell + slab * _B)
    rank, limit = np.zeros(len(seed)), np.minimum(1.0, bound[owner] - slab)
    best = np.full(len(rows) * k, np.inf)
    thrown = []
    turn = 0
    while len(seed):
        turn += 1
        rank = rank - np.log(_unit(mix(seed + _times(turn, _A))))
        inside = rank < limit
        seed, rank, limit, owner, slab = seed[inside], rank[inside], limit[inside], owner[inside], slab[inside]
        if not len(seed):
            break
        dart = mix(seed ^ _times(turn, _B))
        place = owner * k + (dart % np.uint64(k)).astype(np.int64)
        whole = rank + slab
        np.minimum.at(best, place, whole)
        thrown.append((place, whole, dart))
    value = np.zeros(len(best), dtype=np.uint64)
    for place, whole, dart in thrown:
        won = best[place] == whole
        value[place[won]] = dart[won]
    return value.reshape(len(rows), k), np.isfinite(best).reshape(len(rows), k).all(axis=1)


def _bands(bands: int, rows: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b["text"]):
                for lo, hi in _parts(np.diff(c.word_bounds), k):
                    cells, bounds = units(_rows_of(c, lo, hi))
                    sig = signatures(cells, bounds, k).reshape(hi - lo, bands, rows)
                    key = np.tile(np.arange(bands, dtype=np.uint64), (hi - lo, 1))
                    for j in range(rows):
                        key = mix(key * _A + sig[:, :, j])
                    empty = np.diff(bounds) == 0
                    size = np.where(empty, 0, bands)
                    flat = key[~empty].reshape(-1).view(np.int64)
                    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*(b[x].slice(c.first + lo, hi - lo) for x in ("node", "h1", "h2")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                        names=["node", "h1", "h2", "bands"],
                    )

    return run


def _parts(words: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about DARTS places where darts are thrown; a longer row is alone."""
    places = np.cumsum(np.maximum(words, 2 * k * (np.log(k) + 3)))
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(places, (places[lo - 1] if lo else 0) + DARTS, "right")))
        yield lo, hi
        lo = hi


def _rows_of(c: Chunk, lo: int, hi: int) -> Chunk:
    if lo == 0 and hi == c.rows:
        return c
    a, z = c.bounds[lo], c.bounds[hi]
    u, v = c.word_bounds[lo], c.word_bounds[hi]
    return Chunk(c.first + lo, hi - lo, c.data[a:z], c.bounds[lo : hi + 1] - a, c.starts[u:v] - a, c.ends[u:v] - a, c.word_bounds[lo : hi + 1] - u)


def _sets(bits: np.ndarray):
    """The sorted cells of the rows whose ``probe`` is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bitmap(bits, b["probe"].to_numpy().view(np.uint64))))
            for c in chunks(b["text"]):
                cells, bounds = units(c)
                own = [np.sort(cells[a:z]).tobytes() for a, z in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(b[x].slice(c.first, c.rows) for x in ("first", "h1", "h2")), pa.array(np.diff(bounds), pa.int64()), pa.array(own, pa.binary())],
                    names=["first", "h1", "h2", "n", "cells"],
                )

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of each member with its head, which comes before the members of its salt."""
    at, head = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, node, similar = [], [], []
        for x, salt, member, y, cells in zip(*(batch[c] for c in ("a", "salt", "member", "node", "cells")), strict=True):
            own = np.frombuffer(cells.as_buffer(), np.uint64)
            if not member.as_py():
                at, head = (x.as_py(), salt.as_py()), own.copy()
                continue
            if (x.as_py(), salt.as_py()) != at:
                raise ValueError("a member without its head")
            place = np.searchsorted(head, own)
            place[place == len(head)] = 0
            shared = int((head[place] == own).sum())
            a.append(at[0])
            node.append(y.as_py())
            similar.append(shared / (len(own) + len(head) - shared))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(node, pa.int64()), pa.array(similar, pa.float64())], names=["a", "b", "similar"])


def _compared(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) with their similarity, by their whole sets; a goes once to each SALT or fewer of its b.
    There are ``most`` pairs at most."""
    heads = saved(pairs.groupBy("a").agg(F.count("*").alias("n")), "heads", most)
    salts = F.ceil(F.col("n") / SALT).cast("int")
    dealt = join_groups(pairs, heads, "a", "n", how="inner").select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), F.col("b").alias("node"))
    members = dealt.join(sets.select("node", "cells"), "node").select("a", "salt", F.lit(True).alias("member"), "node", "cells")
    first = heads.join(sets.select(F.col("node").alias("a"), "cells"), "a").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("member"), F.col("a").alias("node"), "cells")
    rows = first.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "node")
    return saved(mapped(rows, _beside, "a long, b long, similar double"), "compared", most)


def _near_groups(coarse: DataFrame, label: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """Links (a, b, similar) that join classes within coarse groups, by comparing blocks of each with each other.

    A group is dealt to blocks of about BLOCK nodes and CELLS cells at most, so a task holds two such blocks
    whatever its size is. Only links that join what isn't joined yet are given, fewer than there are nodes.
    """
    group = extended(label, coarse, most).select("node", F.col("label").alias("grp"))
    placed = _labelled(group, label).join(sets.select("node", F.col("n").alias("size")), "node")
    mixed = placed.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("all"), (F.min("label") != F.max("label")).alias("split")).where("split")
    mixed = saved(mixed.select("grp", "n", "all"), "coarse", most)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / CELLS)).cast("int")
    rows = join_groups(placed, mixed, "grp", "n", how="inner").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.join(sets.select("node", "cells"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "cells")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node").reset_index(drop=True)
        cells = [np.frombuffer(x, np.uint64) for x in b["cells"]]
        size, own = np.array([len(x) for x in cells]), b["own"].to_numpy()
        flat, owner = np.concatenate(cells), np.repeat(np.arange(len(b), dtype=np.int32), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        _, tops = np.unique(b["label"].to_numpy(), return_inverse=True)
        tops, out = tops.tolist(), []
        crossing = len(set(own)) > 1
        root = list(range(max(tops) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in range(len(b)):
            low, high = np.searchsorted(flat, cells[x], "left"), np.searchsorted(flat, cells[x], "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shared = np.bincount(owner[at], minlength=len(b))
            similar = shared / (size + size[x] - shared)
            for y in np.flatnonzero(similar[:x] >= threshold):
                if crossing and own[x] == own[y]:
                    continue  # these two meet where their block is alone
                p, q = find(tops[x]), find(tops[y])
                if p != q:
                    root[p] = q
                    out.append((b["node"][y], b["node"][x], similar[y]))
        return pd.DataFrame(out, columns=["a", "b", "similar"])

    return saved(rows.groupBy("grp", "i", "j").applyInPandas(compare, "a long, b long, similar double"), "near", most)


def _crossed(mixed: DataFrame, may: Column) -> DataFrame:
    """Pairs of each outer member with all members of other classes of its bucket, a hot bucket over salts."""
    salts = F.ceil(F.col("n") / 1000).cast("int")
    outer = mixed.where("label <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    outer = outer.select("key", "salt", F.col("node").alias("q"), F.col("far").alias("fq"), F.col("label").alias("lq"))
    rest = mixed.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).select("key", "salt", "head", "node", "label", "far")
    apart = (F.col("label") != F.col("lq")) & (F.col("node") != F.col("head")) & (F.col("q") != F.col("head"))
    return rest.join(outer, ["key", "salt"]).where(apart & may)


def _followed(rows: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """(node, up) of rows, with the up that ``steps`` has for theirs, if any; an up of many rows is looked up once."""
    heads = rows.groupBy("up").agg(F.count("*").alias("n"))
    heads = heads.join(steps.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").withColumn("top", F.coalesce("top", "up"))
    found = join_groups(rows, saved(heads, "heads", most), "up", "n", how="inner")
    return found.withColumn("up", F.col("top")).select(*rows.columns)


def components(links: DataFrame, most: int) -> DataFrame:
    """(node, label) of each node of the links (a, b): the smallest node that it is connected with.

    Each round, every node moves to the least node around it and on to that one's least, and links go along;
    those that become loops are done, so there are fewer from round to round, and a long chain halves. There are
    ``most`` links at most.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", most)
    steps = []
    while most := edges.count():
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("up")))
        near = saved(ends.groupBy("node").agg(F.min("up").alias("up"), F.count("*").alias("d")), "near", 2 * most)
        steps.append(saved(_followed(near, near, 2 * most), "steps", 2 * most))
        for side in ("a", "b"):
            moved = join_groups(edges, steps[-1].select(F.col("node").alias(side), "up", "d"), side, "d", how="inner")
            edges = moved.withColumn(side, F.col("up")).select("a", "b")
        edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", most)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = steps.pop()
    while steps:
        before = steps.pop()
        found = saved(_followed(before, found, n := before.count()), "steps", n)
    return found.select("node", F.col("up").alias("label"))


def extended(label: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The (node, label) of components() once the links (a, b) count too: only classes that they join are looked at.
    There are ``most`` labels and links at most."""
    ends = _labelled(links.select(F.col("a").alias("node"), "b"), label).select(F.col("label").alias("a"), F.col("b").alias("node"))
    tops = components(_labelled(ends, label).select("a", F.col("label").alias("b")), most)
    tops = tops.select("node", F.col("label").alias("up"))
    moved = _followed(label.select("node", F.col("label").alias("up")), tops, most)
    new = tops.join(label.select("node"), "node", "left_anti")
    return saved(moved.unionByName(new).select("node", F.col("up").alias("label")), "labels", most)


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows with their node's label: the node itself if it has no links."""
    named = label.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(named, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("_label", "node")).drop("_node", "_label")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links.

    Documents are in one class if their texts are equal, or linked, through others if need be, by a weighted
    Jaccard similarity of five-word shingles of ``threshold`` or more. class_id is the smallest doc_id of the
    class; n_links counts the other texts that this one was found similar to, of those it was compared with
    (texts already known to be of one class aren't compared again). Words are runs of letters, digits and
    non-ASCII characters, ASCII letters in lower case. A text of fewer than five words is one shingle; texts
    without a word, empty ones too, are in one class only with equal texts. A null text is alone. doc_id should
    be unique; a row that shares it with another text is placed by its own text. Of texts whose smallest doc_id is
    the same, one stands for it and the others, like a null doc_id, get a stand-in of 2**62 or more, made of the
    text's hash.
    """
    return _classified(docs, key, text, threshold, bands, rows).select(key, "class_id", "n_links")


def _classified(docs: DataFrame, key: str, text: str, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of classes(), with _hash of each one's text: no two texts that aren't linked have one class_id."""
    has = F.col(text).isNotNull()
    own = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(key).cast("long"), F.shiftrightunsigned(F.xxhash64(F.lit("id"), F.col(text)), 2) + (1 << 62)).alias("node"),
        F.when(has, _h1(text)).alias("h1"),
        F.when(has, _h2(text)).alias("h2"),
        F.col(text).cast("string").alias("text"),
    )
    there = own.where("text is not null")
    signed = mapped(there.select("node", "h1", "h2", "text"), _bands(bands, rows), "node long, h1 long, h2 long, bands array<long>")
    by_text = signed.groupBy("h1", "h2").agg(F.first("bands").alias("bands"), F.min("node").alias("node"), F.count("*").alias("copies"))
    texts = _apart(saved(by_text.withColumn("first", F.col("node")), "texts"))
    most = bands * texts.count()
    meets = texts.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = saved(meets.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets", most)
    members = saved(join_groups(meets, buckets, "key", "n", how="inner"), "members", most)
    pairs = saved(members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs", most)
    needed = saved(texts.select("node", "h1", "h2", "first").join(members.select("node").distinct(), "node", "left_semi"), "needed", most)
    # most texts meet no other: a bitmap of fixed size tells in passing which may need their set
    bits = bitmap(needed.select(F.xxhash64("first", "h1").alias("hash")), needed.count())
    maybe = there.select(F.col("node").alias("first"), "h1", "h2", F.xxhash64("node", "h1").alias("probe"), "text")
    made = mapped(maybe, _sets(bits), "first long, h1 long, h2 long, n long, cells binary")
    # repeated rows give the same set
    sets = saved(made.join(needed, ["first", "h1", "h2"]).dropDuplicates(["first", "h1", "h2"]).select("node", "n", "cells"), "sets")
    sizes = sets.select("node", "n")
    like = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    like = like.where(F.least("na", "nb") >= COARSE * F.greatest("na", "nb")).select("a", "b")
    compared = _compared(like, sets, most)
    label = components(compared.where(F.col("similar") >= threshold), most)
    # What is rather like some bucket's head is compared within coarse groups, class against class. Members far
    # from a head meet those of their bucket, unless their distances to it rule a link out: 1 - similarity is a
    # metric, so distances of linked texts to a third one differ by 1 - threshold at most.
    near = _near_groups(compared.where((F.col("similar") >= COARSE) & (F.col("similar") < threshold)).select("a", "b"), label, sets, threshold, most)
    compared = saved(compared.unionByName(near.join(compared.select("a", "b"), ["a", "b"], "left_anti")), "compared", most)
    label = extended(label, near, most)
    far = compared.select(F.col("a").alias("head"), F.col("b").alias("node"), (1 - F.col("similar")).alias("far"))
    placed = members.where("n > 2").drop("n").join(far, ["head", "node"], "left")
    placed = _labelled(placed.withColumn("far", F.when(F.col("node") == F.col("head"), F.lit(0.0)).otherwise(F.coalesce("far", F.lit(2.0)))), label)
    placed = saved(placed, "members", most)
    by_class = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    split = by_class.groupBy("key").agg(F.max_by("label", "c").alias("main"), F.sum("c").alias("n"), F.count("*").alias("k")).where("k > 1")
    split = saved(split.drop("k"), "split", most)
    if split.limit(1).count():
        mixed = saved(join_groups(placed, split, "key", "n", how="inner"), "mixed", most)
        unknown = (F.col("far") > 1.5) | (F.col("fq") > 1.5)
        may = (F.greatest("far", "fq") > 1 - COARSE) & (unknown | (F.abs(F.col("far") - F.col("fq")) <= 1 - threshold + 1e-9))
        met = _crossed(mixed, may).select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")).distinct()
        met = met.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        met = met.where(F.least("na", "nb") >= (threshold - 1e-9) * F.greatest("na", "nb")).select("a", "b")
        met = saved(met.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if met.limit(1).count():
            more = _compared(met, sets, met.count())
            compared = saved(compared.unionByName(more), "compared")
            label = extended(label, more.where(F.col("similar") >= threshold), most)
    links = compared.where(F.col("similar") >= threshold).select("a", "b")
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    found = _labelled(texts.select("node", _hash(), "copies"), label).join(degree, F.col("node") == F.col("a"), "left")
    found = saved(found.select("hash", "label", "n_links", "copies"), "classes", most // bands)
    out = join_groups(own.select("id", "node", _hash()), found, "hash", "copies", noise="node")
    return out.select(
        F.col("id").alias(key), F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("hash").alias("_hash")
    )


def _apart(texts: DataFrame) -> DataFrame:
    """Saved texts (node, h1, h2, first, ...), with a node of its own for all but one of those that have the same."""
    shared = texts.groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("held"), F.count("*").alias("n"))
    shared = saved(shared.where("n > 1"), "shared")
    if not shared.limit(1).count():
        return texts
    other = F.col("held").isNotNull() & (F.col("held") != F.struct("h1", "h2"))
    stand_in = F.shiftrightunsigned(F.xxhash64(F.lit("text"), "h1", "h2"), 2) + (1 << 62)
    found = join_groups(texts, shared, "node", "n", noise="h1")
    return saved(found.withColumn("node", F.when(other, stand_in).otherwise(F.col("node"))).select(*texts.columns), "texts")


def _h1(text: str) -> Column:
    return F.xxhash64(text)


def _h2(text: str) -> Column:
    return F.xxhash64(F.lit(7), F.col(text))


def _hash(h1: str | Column = "h1", h2: str | Column = "h2") -> Column:
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")).alias("hash")


def _place(key: str, hash: Column) -> Column:
    """A doc_id and a text's hash as one string, never null."""
    return F.concat(F.coalesce(hash, F.lit("")), F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Of each class of ``docs`` one row: that of its smallest doc_id, nulls last, and of the smallest text hash
    among those. A null text is in a class with none. Rows of the same doc_id and text count once."""
    found = _classified(docs, key, text, threshold)
    place = F.struct(F.col(key).isNull().alias("bare"), F.col(key).alias("id"), F.col("_hash").alias("hash"))
    kept = found.where("_hash is not null").groupBy("class_id").agg(F.min(place).alias("kept")).select("kept.id", "kept.hash")
    kept = saved(kept.unionByName(found.where("_hash is null").select(F.col(key).alias("id"), F.col("_hash").alias("hash")).distinct()), "kept")
    # one key of both sides, never null, so that texts are moved once
    held = free_name(docs, "place")
    kept = kept.select(_place("id", F.col("hash")).alias(held))
    own = F.when(F.col(text).isNotNull(), _hash(_h1(text), _h2(text)))
    rows = docs.withColumn(held, _place(key, own))
    return rows.join(kept, held, "left_semi").dropDuplicates([held]).select(*docs.columns)
