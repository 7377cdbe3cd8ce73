"""Near duplicates and benchmark overlap by MinHash bands, keeping the first; exact forms; longest common runs.

A row is kept if no kept row before it meets it in a band. That is greedy and depends on order: a dropped row
drops nobody. It is computed by rounds over bands: a row that is first in all its bands is kept, and what meets a
kept row is dropped. Rounds need the smallest place in each band only, so no pairs are made, and a band that holds
a third of all rows costs as much as any other rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.order import keep_first
from quernel.store import among, digest, free_name, hinted, join_groups, looked, mapped, saved

PRIME = (1 << 31) - 1
BASE = 65599
#: (bands, rows) of 128 permutations or fewer, by threshold, with balanced errors of both kinds.
SPLITS = {0.7: (14, 9), 0.9: (5, 25)}


def coefficients(k: int) -> list[tuple[int, int]]:
    """k pairs (a, b) for (a h + b) mod PRIME, from a fixed linear congruence."""
    out, x = [], 1
    for _ in range(k):
        pair = []
        for _ in range(2):
            x = (x * 48271) % PRIME
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


#: Shingles that are hashed at once, and texts whose keys a task remembers.
SPAN, TEXTS = 1 << 13, 50_000


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``size`` characters of each text, one after the other, and where each begins.
    A shorter text is one run."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    prime, bits = np.uint64(PRIME), np.uint64(31)
    powers = [np.uint64(pow(BASE, k, PRIME)) for k in range(size)]
    owner = np.arange(len(texts), dtype=np.uint64) << bits
    key, n = np.empty(0, np.uint64), max(len(codes) - size + 1, 0)
    if n:
        # a run's hash at every place of all texts; a sum of ``size`` products below 2 ** 52
        h = codes[size - 1 :].copy()
        for j in range(size - 1):
            h += codes[j : j + n] * powers[size - 1 - j]
        h = _reduced(h)
        whole, ends = np.ones(len(codes), bool), np.cumsum(length)
        for j in range(1, size):
            whole[ends - j] = False  # such a run would go on in the next text
        key = (np.repeat(owner, length)[:n] | h)[whole[:n]]
    short = np.flatnonzero(length < size)
    if len(short):
        first, h = np.cumsum(length) - length, np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            there = np.flatnonzero(length[short] > j)
            h[there] = _reduced(h[there] * powers[1] + codes[first[short[there]] + j])
        key = np.append(key, owner[short] | h)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key & prime), np.searchsorted(key >> bits, np.arange(len(texts)).astype(np.uint64))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME of numbers below 2 ** 60, by adding their upper bits to the 31 lower ones."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    x = (x & prime) + (x >> bits)
    return np.where(x >= prime, x - prime, x)


def minima(texts: list[str], a: np.ndarray, b: np.ndarray, size: int = 5) -> np.ndarray:
    """Least (a h + b) mod PRIME over each text's shingles: texts x permutations.

    Remainders r are compared as fractions of 2 ** 64: h times a / PRIME, plus b / PRIME, both rounded up, and kept to 64
    bits, which drops whole multiples of PRIME. That is off by at most h + 1 < 2 ** 31 + 1, and neighbouring remainders are
    over 2 ** 33 apart, so the least fraction is that of the least r, and gives it exactly.
    """
    h, first = shingles(texts, size)
    a, b = (np.array([(int(x) << 64) // PRIME + 1 for x in own], np.uint64)[:, None] for own in (a, b))
    out = np.full((len(a), len(texts)), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), SPAN):
        part = h[lo : lo + SPAN]
        low = int(np.searchsorted(first, lo, "right")) - 1
        high = int(np.searchsorted(first, lo + len(part), "left"))
        starts = np.maximum(first[low:high] - lo, 0)
        y = np.empty((9, len(part)), np.uint64)
        for k in range(0, len(a), 9):
            own = slice(k, min(k + 9, len(a)))
            x = np.multiply(a[own], part[None], out=y[: own.stop - k])
            x += b[own]
            np.minimum(out[own, low:high], np.minimum.reduceat(x, starts, axis=1), out=out[own, low:high])
    prime, half, lower = np.uint64(PRIME), np.uint64(32), np.uint64((1 << 32) - 1)
    return ((out >> half) * prime + ((out & lower) * prime >> half) >> half).T


def _signatures(bands: int, rows: int, size: int):
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(bands * rows), strict=True))

    def keys(texts: list[str]) -> list[list[bytes]]:
        # the whole band goes in: unequal bands must not share a bucket
        own = minima(texts, a, b, size).astype("<u4").reshape(len(texts), bands, rows)
        return [[hashlib.md5(bytes([i]) + t[i].tobytes()).digest() for i in range(bands)] for t in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[bytes]] = {}
        for batch in batches:
            texts = batch["text"].to_pylist()
            prints = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            if len(known) > TEXTS:
                known.clear()
            todo, held = {p: t for p, t in zip(prints, texts, strict=True) if p is not None and p not in known}, 0
            group: list[bytes] = []
            for p, t in todo.items():
                group.append(p)
                held += len(t)
                if held > 1 << 17:
                    known.update(zip(group, keys([todo[x] for x in group]), strict=True))
                    group, held = [], 0
            if group:
                known.update(zip(group, keys([todo[x] for x in group]), strict=True))
            found = [None if p is None else known[p] for p in prints]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["grp"], pa.array(found, pa.list_(pa.binary()))], names=["node", "grp", "bands"])

    return run


def banded(texts: DataFrame, threshold: float = 0.7, size: int = 5) -> DataFrame:
    """(node, bucket) of each band of each text of (node, grp, text): nulls have none. A bucket is the MD5 of the
    band's place and all its minima, and of the group if there is one."""
    bands, rows = SPLITS[threshold]
    run = mapped(texts.select("node", "grp", "text"), _signatures(bands, rows, size), "node long, grp string, bands array<binary>")
    within = F.unhex(F.md5(F.concat("band", F.col("grp").cast("binary"))))
    return run.select("node", "grp", F.explode("bands").alias("band")).select("node", F.when(F.col("grp").isNull(), F.col("band")).otherwise(within).alias("bucket"))


#: Rounds after which rows still open are finished in order, once there are no more than so many of them.
ROUNDS, OPEN = 4, 100_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes kept, of (node, bucket) in order of node."""
    at, own, held = None, [], set()
    for b in batches:
        kept = []
        for node, bucket in zip(b["node"].to_pylist(), b["bucket"].to_pylist(), strict=True):
            if node != at:
                if own and held.isdisjoint(own):
                    kept.append(at)
                    held.update(own)
                at, own = node, []
            own.append(bucket)
        yield pa.RecordBatch.from_pydict({"node": pa.array(kept, pa.int64())})
    yield pa.RecordBatch.from_pydict({"node": pa.array([at] if own and held.isdisjoint(own) else [], pa.int64())})


def greedy(meets: DataFrame) -> DataFrame:
    """The nodes of (node, bucket) that are kept, in order of node. A bucket with one row decides nothing, so only rows of
    the others go through rounds; a node that has none of these is kept."""
    left = saved(meets.distinct(), "meets")
    shared = saved(left.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = saved(join_groups(left, shared, "bucket", "n", how="inner").select("node", "bucket"), "met")
    nodes = saved(met.select("node").distinct(), "nodes")
    alone = saved(left.select("node").distinct().join(hinted(nodes), "node", "left_anti"), "alone")
    return alone.unionByName(rounds(met))


def rounds(left: DataFrame) -> DataFrame:
    """greedy() of distinct rows that are saved.

    Each round keeps what is first in all its buckets, and drops what meets that. A long chain takes half as many
    rounds as it has rows, so from the fourth on a rest of a bounded number of slim rows is gone through in order.
    """
    kept, turn = left.select("node").limit(0), 0
    while n := left.count():
        if turn >= ROUNDS and n <= OPEN:
            rest = left.coalesce(1).sortWithinPartitions("node")
            return kept.unionByName(saved(mapped(rest, _in_order, "node long"), "kept"))
        low = saved(left.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")), "low", n)
        beside = saved(join_groups(left, low, "bucket", "n", how="inner").select("node", "bucket", "low"), "beside", n)
        first = beside.groupBy("node").agg(F.min(F.col("node") == F.col("low")).alias("first"))
        new = saved(first.where("first").select("node"), "kept", n)
        kept = new if not turn else kept.unionByName(new)
        # a kept row is the smallest of its buckets: all rows of these are done
        done = beside.join(hinted(new.select(F.col("node").alias("low"))), "low", "left_semi").select("node").distinct()
        left = saved(beside.select("node", "bucket").join(done, "node", "left_anti"), "meets", n)
        turn += 1
    return kept


def field_texts(df: DataFrame, fields: list[str], order: str, group: str | None = None) -> DataFrame:
    """(node, grp, text) of each field of each row: what banded() signs."""
    within = F.col(group).cast("string") if group else F.lit(None).cast("string")
    own = [F.struct(F.col(order).cast("long").alias("node"), within.alias("grp"), F.col(f).cast("string").alias("text")) for f in fields]
    return df.select(F.explode(F.array(*own)).alias("its_text")).select("its_text.*")


def near_dedup(df: DataFrame, fields: list[str], order: str, reference: DataFrame | None = None, threshold: float = 0.7, group: str | None = None, compat: bool = False, mark: str | None = None) -> DataFrame:
    """The rows kept, first come first kept by the whole-number column ``order`` (unique, not null).

    A row stays if none of its ``fields`` meets a field of a row that stays before it, or a text of
    ``reference`` (texts in its column ``text``). Fields of one row aren't compared with each other. With
    ``group``, only rows of equal group are compared. Meeting in a band counts, without a check of the
    similarity itself. Null fields meet nothing, and a row without any text stays. A text of fewer characters
    than a shingle meets equal ones; with ``compat``, all such texts meet each other. With ``mark``, all rows come, and
    a column of that name says which are kept.
    """
    texts = field_texts(df, fields, order, group)
    short = F.when(F.length("text") < 5, F.lit("")).otherwise(F.col("text"))
    texts = texts.withColumn("text", short) if compat else texts
    meets = banded(texts, threshold)
    if reference is not None:
        held = reference.select(F.lit(0).cast("long").alias("node"), F.lit(None).cast("string").alias("grp"), F.col("text"))
        held = held.withColumn("text", short) if compat else held
        meets = saved(meets, "meets")
        known = saved(banded(held, threshold).select("bucket").distinct(), "reference")
        hit = saved(looked(meets, known, ["bucket"], "left_semi").select("node").distinct(), "hit")
        meets = meets.join(hinted(hit), "node", "left_anti")
    kept = greedy(meets)
    bare = df.where(reduce(lambda x, y: x & y, [F.col(f).isNull() for f in fields])).select(F.col(order).cast("long").alias("node"))
    return among(df, F.col(order).cast("long"), kept.unionByName(bare), mark)


def exact_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys (nulls are equal) the one of smallest order, null first."""
    return keep_first(df, keys, [order])


def exact_counts(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """(order, name): the smallest order of each group of equal keys (nulls are equal), and its rows. Keys go by digest,
    so no long text is moved."""
    own = F.sha2(F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    return df.groupBy(own.alias("key")).agg(F.min(order).alias(order), F.count("*").alias(name)).select(order, name)


def unseen(df: DataFrame, key: Column, reference: DataFrame, reference_key: Column) -> DataFrame:
    """Rows whose key (a sorted set of terms, lines in order, a text) is not among the reference's; a null is in none."""
    own = free_name(df, "own_key")
    known = saved(reference.select(digest(reference_key).alias(own)).where(F.col(own).isNotNull()).distinct(), "known")
    return looked(df.withColumn(own, digest(key)), known, [own], "left_anti").drop(own)


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one whole number for all of ``b``."""
    place: dict[str, int] = {}
    for i, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & place.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


_WORDS = "[a-z0-9]+"
#: Counts of reference words by hash, which every task has: 4 MB, whatever the reference holds.
COUNTS = 1 << 20


def words_of(text: Column) -> Column:
    """Runs of lower-case ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0))


def _prefixes(rarity: np.ndarray, threshold: float, common: bool):
    """(id, size, token, at) of each text of (id, hashes): its rarest words, as many as must hold one that it shares
    with any text it is over the threshold with.

    F is 2 LCS / (m + n), so F > t needs LCS > t (m + n) / 2 >= t m / (2 - t) =: o, as n >= m t / (2 - t). Two lists that
    share more than o words share one of the first m - o of each, in one order for all. A word's k-th place in its
    list is a token of its own, as lists may repeat words. With ``common``, tokens that the reference can't have are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, sizes, tokens, places = [], [], [], []
            for row, hashes in enumerate(b["hashes"]):
                h = hashes.values.to_numpy().view(np.uint64)
                n = rarity[(h & np.uint64(COUNTS - 1)).astype(np.int64)]
                order = np.lexsort((h, n))
                h, n = h[order], n[order]
                place = np.arange(len(h))
                turn = place - np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), place, 0))  # how often the word came before
                at = place[: len(h) - math.floor(threshold * len(h) / (2 - threshold))]
                at = at[n[at] > 0] if common else at
                owner.append(np.full(len(at), row))
                sizes.append(np.full(len(at), len(h), np.int32))
                tokens.append((h[at] * np.uint64(0x9E3779B97F4A7C15) + turn[at].astype(np.uint64)).view(np.int64))
                places.append(at.astype(np.int32))
            if owner:
                columns = [b["id"].take(pa.array(np.concatenate(owner))), *[pa.array(np.concatenate(x)) for x in (sizes, tokens, places)]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "token", "at"])

    return run


def _rarity(known: DataFrame) -> np.ndarray:
    """How many of the reference's words have each of COUNTS hashes, which is all that the driver and the tasks get."""
    at = F.explode(F.transform("hashes", lambda h: h.bitwiseAND(F.lit(COUNTS - 1).cast("long"))))
    got = known.select(at.alias("at")).groupBy("at").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(COUNTS, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _over(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rouge = []
            for w, r in zip(b["w"], b["r"], strict=True):
                x, y = w.as_py(), r.as_py()
                rouge.append(2 * common_length(x, y) / (len(x) + len(y)))
            ok = pa.array([x > threshold for x in rouge], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["id"].filter(ok), pa.array(rouge, pa.float64()).filter(ok)], names=["id", "rouge"])

    return run


#: Reference texts with one token that are one row of the joined side.
TOGETHER = 1000


def rouge_candidates(lists: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (id, its_id) of texts and reference texts that can be over the threshold: both tables have (id,
    hashes), the hashes of their words in order, and ``known`` is saved."""
    kinds = "id {}, size int, token long, at int"
    longest, shortest = known.agg(F.max(F.size("hashes")), F.min(F.size("hashes"))).first()
    far = threshold / (2 - threshold)
    fit = lists.where(F.size("hashes").between(F.lit((shortest or 1) * far), F.lit((longest or 0) / far if far else math.inf)))
    rarity = _rarity(known)
    ours = saved(mapped(fit, _prefixes(rarity, threshold, True), kinds.format(dict(lists.dtypes)["id"])), "our_prefixes")
    theirs = saved(mapped(known, _prefixes(rarity, threshold, False), kinds.format("long")), "their_prefixes")
    # a token that many reference texts have is cut into blocks, and each of ours goes to all of them
    often = ours.groupBy("token").agg(F.count("*").alias("n")).join(theirs.groupBy("token").agg(F.count("*").alias("m")), "token")
    often = saved(often.select("token", "n", F.ceil(F.col("m") / TOGETHER).cast("int").alias("blocks")), "tokens")
    block = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long"))
    packed = looked(theirs, often, ["token"], "inner").withColumn("key", F.xxhash64("token", block.alias("block")))
    packed = packed.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct(F.col("id").alias("its_id"), F.col("size").alias("its_size"), F.col("at").alias("its_at"), F.col("token").alias("its_token"))).alias("theirs"))
    sent = join_groups(ours, often, "token", "n", how="inner").drop("n")
    keyed = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).withColumn("key", F.xxhash64("token", "block"))
    met = join_groups(keyed, saved(packed, "theirs"), "key", "n", how="inner").select("id", "size", "at", "token", F.explode("theirs").alias("t"))
    both = met.select("id", "size", "at", "token", "t.*").where("token = its_token")
    # LCS is at most the shorter list, and at most what is left from the first shared token on
    most = F.least(F.col("size") - F.col("at"), F.col("its_size") - F.col("its_at"))
    return both.where(2 * most > F.lit(threshold) * (F.col("size") + F.col("its_size"))).select("id", "its_id").distinct()


def rouge_l(texts: DataFrame, reference: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rouge): the largest F-measure of longest common word runs against a stated reference set, a row for each
    row of ``texts``: rouge_over() without a threshold, so all pairs that share a word are compared. Null texts, texts
    without words and those that share none have 0."""
    return rouge_over(texts, reference, key, text, 0.0).withColumn("rouge", F.coalesce("rouge", F.lit(0.0)))


def rouge_over(texts: DataFrame, reference: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, rouge): the largest F-measure of longest common word runs against a stated reference set where that is over
    ``threshold``, else null; a row for each row of ``texts``.

    Words are runs of lower-case letters and digits. Only pairs that can be over the threshold are compared: those that
    share a rare word near enough to the front of both lists, words ordered by how often the reference has them, with
    lengths that allow it. Equal texts are compared once, and words are moved only of texts in such pairs.
    Null texts and texts without words have null, as have all if the reference is empty.
    """
    hashes = F.transform("w", lambda x: F.xxhash64(x)).alias("hashes")
    known = reference.select(words_of(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    known = saved(known.select(F.monotonically_increasing_id().alias("id"), "w", hashes), "reference")
    own = texts.select(F.col(key).alias("key"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("id"), F.col(text).alias("text"))
    lists = own.select("id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    pairs = saved(rouge_candidates(lists.select("id", hashes), known.select("id", "hashes"), threshold), "pairs")
    some = looked(own.select("id", "text"), saved(pairs.select("id").distinct(), "compared"), ["id"], "left_semi")
    both = pairs.join(some.groupBy("id").agg(words_of(F.first("text")).alias("w")), "id")
    both = looked(both, known.select(F.col("id").alias("its_id"), F.col("w").alias("r")), ["its_id"], "inner")
    over = mapped(both.select("id", "w", "r"), _over(threshold), "id binary, rouge double").groupBy("id").agg(F.max("rouge").alias("rouge"))
    return looked(own.select("key", "id"), saved(over, "over"), ["id"]).select(F.col("key").alias(key), "rouge")
