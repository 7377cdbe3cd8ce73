"""Row order made explicit: numbering, shuffling, slicing, first rows, quotas, cyclic pairing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.store import free_name, hinted, looked, saved

_LOCAL = (1 << 33) - 1  #: the part of monotonically_increasing_id() that counts within a partition


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Rows numbered from 0 without gaps, in ``order``, within each group of equal ``by`` columns.

    Rows are sorted by ranges, so a group of any size spreads over tasks: each range counts its rows of each
    group, and the counts of earlier ranges are added. Nothing of a group is gathered in one place. Ties in
    ``order`` are numbered as they come; give a total order where that matters.
    """
    df = df.drop(name)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    part, at, n, first, before = (free_name(df, x) for x in ("its_part", "its_at", "its_n", "its_first", "its_before"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = saved(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))}), "ranges")
    counts = placed.groupBy(part, *by).agg(F.count("*").alias(n), F.min(at).alias(first))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    offsets = saved(offsets.select(part, first, before, *by), "offsets")
    own_part, own_by = free_name(df, "own_part"), [free_name(df, f"own_by{i}") for i in range(len(by))]
    small = hinted(offsets.select(F.col(part).alias(own_part), first, before, *[F.col(c).alias(o) for c, o in zip(by, own_by, strict=True)]))
    same = F.col(part) == F.col(own_part)
    for c, o in zip(by, own_by, strict=True):
        same &= F.col(c).eqNullSafe(F.col(o))
    joined = placed.join(small, same).withColumn(name, F.col(before) + F.col(at) - F.col(first))
    return joined.select(*df.columns, name)


#: Up to so many rows of a group, Spark keeps no more of each in any task before it moves them.
GROUP_LIMIT = 1000


def first_of_each(df: DataFrame, by: list[str], order: list[Column | str], most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each group of equal ``by`` columns (nulls are equal), numbered from 0 in ``order``.

    The limit is put below the shuffle: each task passes on the first rows of each group that it has, so at most
    ``most`` x groups x tasks rows are moved, and a group of any size ends as that many in one place. Beyond
    GROUP_LIMIT all rows are numbered by ranges. Ties in ``order`` are cut as they come. An old column ``name`` goes.
    """
    df = df.drop(name)
    if most > GROUP_LIMIT:
        return numbered(df, by, order, name).where(F.col(name) < most)
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, turn).where(F.col(name) <= most).withColumn(name, (F.col(name) - 1).cast("long"))


def first_rows(df: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of all: few by the heads of tasks, merged once; many by ranges."""
    if most <= GROUP_LIMIT:
        return df.orderBy(*order).limit(most)
    turn = free_name(df, "its_turn")
    return numbered(df, [], order, turn).where(F.col(turn) < most).drop(turn)


def seeded_key(seed: int | str, *columns: Column | str) -> Column:
    """A text that orders rows at random, the same for the same seed on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).cast("binary"))


def shuffled(df: DataFrame, seed: int, key: str, name: str = "index") -> DataFrame:
    """Rows with a dense index of a random order that seed and key give; an old column of that name goes."""
    return numbered(df.drop(name), [], [seeded_key(seed, key), F.col(key)], name)


def sliced(df: DataFrame, start: int, end: int, name: str = "index") -> DataFrame:
    return df.where((F.col(name) >= start) & (F.col(name) < end))


def sharded(df: DataFrame, shards: int, n: int, start: int = 0, most: int | None = None, name: str = "index") -> DataFrame:
    """Rows from ``start`` on (``most`` of them at most) with ``shard``, equal runs of whole size; the rows that
    are over go to the last shard, so none is lost."""
    end = n if most is None else min(n, start + most)
    size = max(1, (end - start) // shards)
    run = F.floor((F.col(name) - start) / size)
    return sliced(df, start, end, name).withColumn("shard", F.least(run, F.lit(shards - 1)).cast("int"))


def keep_first(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """Of the rows with equal keys (nulls are equal), the first in ``order``, or the last.

    An aggregate with partial results, so a hot key needs no task of its own.
    """
    rest, row = [c for c in df.columns if c not in keys], free_name(df, "its_row")
    if not rest:
        return df.distinct()
    best = (F.max_by if last else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    got = df.groupBy(*keys).agg(best.alias(row))
    return got.select(*keys, *[F.col(f"{row}.`{c}`").alias(c) for c in rest]).select(*df.columns)


def quota(df: DataFrame, have: DataFrame, by: str, target: int, order: list[Column | str], most: int = 10) -> DataFrame:
    """Of each group up to ``most`` rows, the first in order, but no more than ``target`` less its ``have`` (by, n)."""
    turn, own, held = (free_name(df, x) for x in ("its_turn", "own_by", "its_have"))
    placed = first_of_each(df, [by], order, most, turn)
    counted = placed.join(have.select(F.col(by).alias(own), F.col("n").alias(held)), F.col(by).eqNullSafe(F.col(own)), "left")
    need = F.least(F.lit(target) - F.coalesce(held, F.lit(0)), F.lit(most))
    return counted.where(F.col(turn) < need).select(*df.columns)


def one_each(df: DataFrame, by: list[str], seed: int, key: str) -> DataFrame:
    """One row of each group, chosen at random by the seed."""
    draw = free_name(df, "its_draw")
    return keep_first(df.withColumn(draw, seeded_key(seed, key)), by, [draw, key]).drop(draw)


def cyclic(df: DataFrame, pool: DataFrame, index: str = "index", pool_index: str = "i") -> DataFrame:
    """Row n gets row (n + 1) mod size of the pool, so the first gets row 1 and row 0 comes last. The pool's columns
    replace those of the same name."""
    n = pool.count()
    if not n:
        return df.limit(0).crossJoin(pool.limit(0))
    turn, at = free_name(df, "its_turn"), free_name(df, "its_at")
    drawn = pool.withColumnRenamed(pool_index, at)
    df = df.drop(*[c for c in drawn.columns if c != at])
    return df.withColumn(turn, F.pmod(F.col(index) + 1, F.lit(n))).join(hinted(drawn), F.col(turn) == F.col(at)).drop(turn, at)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``: what a resumed run still has to do. A null key is never done."""
    return looked(df, done.select(key).distinct(), [key], "left_anti")


def under_one_another(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables under one another, columns by name with nulls where one has none, and ``name`` to say which it was."""
    own = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def stacked(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The values of several columns as rows of one."""
    return df.select(F.explode(F.array(*columns)).alias(name))


def short_enough(limits: dict[str, int], strict: bool = False) -> Column:
    """Whether each named text is no longer than its limit (shorter, if ``strict``)."""
    tests = [F.length(c) < n if strict else F.length(c) <= n for c, n in limits.items()]
    out = F.lit(True)
    for t in tests:
        out &= t
    return out
