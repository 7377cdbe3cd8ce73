"""Where intermediate tables go, and how a hot key is joined."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds over 1/HEAVY of all rows, so there are fewer than HEAVY such keys.
HEAVY = 1000


#: Most bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (tests) a folder of this machine is set and used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("quernel.own.checkpoint.dir", None)
        if not found:
            master = spark.conf.get("spark.master", "")
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="quernel-")
            spark.sparkContext.setCheckpointDir(found)
            spark.conf.set("quernel.own.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, among those of this application."""
    return f"{shared_dir(spark)}/quernel/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"


def forget(spark: SparkSession, application: str | None = None) -> None:
    """Delete all intermediate tables of an application that is over, or of this one: results that read them must have
    been written by then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quernel/{application or spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame | None) -> None:
    """Delete the files of a table that saved() gave, which nothing reads any more. Only tables of this application go."""
    if table is None:
        return
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        if at.getParent().toString().endswith(f"/quernel/{spark.sparkContext.applicationId}"):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Slim rows (a few numbers each) that one file of an intermediate table may hold.
FILE_ROWS = 1_000_000


def saved(df: DataFrame, name: str, rows: int | None = None, texts: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage and survives the loss of executors; the files stay until forget(). For a table
    of at most ``rows`` slim rows there are no more files than it needs, or than there are cores. One that is mostly
    ``texts`` is packed closer, at the fastest level.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(4, spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    packed = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"} if texts else {}
    df.write.options(**packed).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table just read, its rows dealt out evenly if it has fewer parts than there are cores (it is small, or one
    file that can't be split): what follows is work for all of them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, such that ``df`` has no such column in either case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow() with batches bounded in bytes, so long texts don't fill a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) != str(BATCH_BYTES):  # it is read when a plan is run, so it stays for the session
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def beside(batch: pa.RecordBatch, **texts: list[str | None]) -> pa.RecordBatch:
    """A batch with string columns after its own, which stay as they are."""
    own = [pa.array(x, pa.string()) for x in texts.values()]
    return pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *texts])


#: No key of so few rows is heavy, whatever its share.
LIGHT = 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, how: str = "left", noise: str | None = None) -> DataFrame:
    """Join many ``rows`` to one row of ``groups`` for each key, whatever share of the rows one key holds.

    ``groups`` is saved already and its column ``count`` has the number of rows with that key; its other columns have
    names that ``rows`` lacks. Keys over 1/HEAVY of the counted rows are fewer than HEAVY by arithmetic, so those are
    broadcast; a row that found its group there goes on under a key of its own (from the column ``noise``), so it weighs
    on no task in the shuffled join that serves all other keys. Where no key is heavy, that join is all.
    """
    total, most = groups.agg(F.sum(count), F.max(count)).first()
    limit = max((total or 0) / HEAVY, LIGHT)
    values = [c for c in groups.columns if c != key]
    lk, lv, hk, hv, jk, v = (free_name(rows, x) for x in ("its_lk", "its_lv", "its_hk", "its_hv", "its_jk", "its_v"))
    light = groups.where(F.col(count) <= limit).select(F.col(key).alias(lk), F.struct(*values).alias(lv))
    near, found, heavy_keys = rows, F.lit(None), (most or 0) > limit
    if heavy_keys:
        heavy = groups.where(F.col(count) > limit).select(F.col(key).alias(hk), F.struct(*values).alias(hv))
        near, found = rows.join(F.broadcast(heavy), F.col(key) == F.col(hk), "left"), F.col(hk)
    if how == "inner":
        out = near.where(found.isNull()).join(light, F.col(key) == F.col(lk)).select(*rows.columns, *[F.col(f"{lv}.{c}").alias(c) for c in values])
        if not heavy_keys:
            return out
        return near.where(found.isNotNull()).select(*rows.columns, *[F.col(f"{hv}.{c}").alias(c) for c in values]).unionByName(out)
    spread = F.col(noise) if noise else F.monotonically_increasing_id()
    kind = rows.schema[key].dataType.simpleString()
    own = spread.cast("string").cast(kind) if kind in ("string", "binary") else F.xxhash64(spread)
    near = near.withColumn(jk, F.when(found.isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    out = near.join(light, F.col(jk) == F.col(lk), "left")
    held = F.when(F.col(key).isNotNull() & F.col(lk).eqNullSafe(F.col(key)), F.col(lv))
    held = held if not heavy_keys else F.when(F.col(hk).isNotNull(), F.col(hv)).otherwise(held)
    return out.withColumn(v, held).select(*rows.columns, *[F.col(f"{v}.{c}").alias(c) for c in values])


def digest(*columns: Column | str) -> Column:
    """A key of 16 bytes for equal values of any type; null where one of them is."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    some = reduce(lambda a, b: a & b, [c.isNotNull() for c in own])
    return F.when(some, F.unhex(F.md5(F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(own)])).cast("binary"))))


def looked(rows: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join many ``rows`` to at most one row of ``small`` for each key, whatever share of the rows one key holds.

    ``how``: left, inner, left_semi or left_anti; a key with a null meets nothing. Few rows of ``small`` (counted) are
    broadcast; else the rows are counted by key and joined as join_groups() does. Columns that ``small`` brings
    replace those of the same name.
    """
    values = [c for c in small.columns if c not in on]
    rows = rows.drop(*values) if how in ("left", "inner") else rows
    if (few := hinted(small)) is not small:
        return rows.join(few, on, how).select(*rows.columns, *(values if how in ("left", "inner") else []))
    key, n, found = (free_name(rows, free_name(small, x)) for x in ("its_key", "its_n", "its_found"))
    keyed = rows.withColumn(key, digest(*on))
    own = small.select(digest(*on).alias(key), *values, F.lit(True).alias(found))
    groups = saved(keyed.groupBy(key).agg(F.count("*").alias(n)).join(own, key), "groups")
    if how in ("left_semi", "left_anti"):
        groups = groups.select(key, n, found)
    out = join_groups(keyed, groups, key, n, how="inner" if how in ("inner", "left_semi") else "left")
    out = out.where(F.col(found).isNull()) if how == "left_anti" else out
    return out.select(*rows.columns, *(values if how in ("left", "inner") else []))


#: Most words of 64 ids each that are broadcast, two numbers a word.
MAX_WORDS = 500_000


def among(rows: DataFrame, key: Column, ids: DataFrame, mark: str | None = None) -> DataFrame:
    """The rows whose whole number ``key`` is among ``ids`` (one column, long); with ``mark``, all rows, and a column of
    that name that says so.

    Ids go as bits, 64 of neighbouring ids to a word, so those of a dense range are broadcast up to many millions, and the
    rows stay where they are. Beyond MAX_WORDS words (counted) both sides are shuffled by word.
    """
    rows = rows if mark is None else rows.drop(mark)
    word, bits = (free_name(rows, x) for x in ("its_word", "its_bits"))
    low = lambda x: x.bitwiseAND(F.lit(63).cast("long")).cast("int")
    own = ids.toDF("id").where("id is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low(F.col("id")))
    words = saved(own.groupBy(F.shiftright("id", 6).alias(word)).agg(F.bit_or(bit).alias(bits)), "words")
    words = F.broadcast(words) if words.count() <= MAX_WORDS else words
    same = (F.shiftright(key, 6) == F.col(word)) & (F.bit_get(F.col(bits), low(key)) == 1)
    if mark is None:
        return rows.join(words, same, "left_semi")
    return rows.join(words, same, "left").withColumn(mark, F.col(word).isNotNull()).drop(word, bits)


#: Most rows, and most bytes of texts in them, of a table that is broadcast; both are counted first.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 50_000, 16 << 20


def hinted(small: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast only if its counted rows and bytes are few; else it is shuffled."""
    kinds = dict(small.dtypes)
    if any(k.startswith(("array", "map", "struct")) for k in kinds.values()):
        return small
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, k in kinds.items() if k in ("string", "binary")), F.lit(0).cast("long"))
    n, held = small.limit(MAX_BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(small) if n <= MAX_BROADCAST_ROWS and (held or 0) <= MAX_BROADCAST_BYTES else small
