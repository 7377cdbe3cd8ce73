"""A near-duplicate index that lasts: bands of the texts that were kept, on disk, added to batch by batch.

The index is a folder of parts and a log. A part is a table of (bucket, node), written once, hashed by bucket into a
fixed number of files and sorted in them, so a lookup shuffles the new batch's buckets to where the part's are and never
the part. A log entry names a batch, its part and its answer; it is written last and by one rename, and what no entry
names does not count. So a batch that fails half-way leaves the index as it was, and one that is run again is answered
from the log. When there are many parts, they are merged into one.

A kept row is the only kept one in each of its buckets, so a bucket is in the index once, however many rows met in it.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.dedup import banded, field_texts, rounds
from quernel.store import free_name, hinted, join_groups, saved

_BANDS, _KEPT = "bucket binary, node long", "node long"


@dataclass(frozen=True)
class Entry:
    """What the log knows of a batch: its turn, where its bands and its answer are (under the index's folder)."""

    turn: int
    batch: str
    part: str
    kept: str
    rows: int


class NearIndex:
    """``folder`` is one that driver and executors share. ``threshold`` and ``slots`` (files of a part) are those of its
    first use; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.7, slots: int = 64, most_parts: int = 8):
        self.spark, self.folder, self.most_parts = spark, folder.rstrip("/"), most_parts
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        held = self._read("index.json")
        if held is None:
            held = {"threshold": threshold, "slots": slots}
            self._write("index.json", held)
        self.threshold, self.slots = held["threshold"], held["slots"]

    # The log: small files, each written under another name and then renamed

    def _read(self, name: str) -> dict | None:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        draft = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        target = self._path(f"{self.folder}/{name}")
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{self.folder}/{name} was written meanwhile")

    def log(self) -> list[Entry]:
        """Batches in the order they were added."""
        at = self._path(f"{self.folder}/log")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted((Entry(**self._read(f"log/{n}")) for n in names if n.endswith(".json") and not n.startswith(".")), key=lambda e: e.turn)

    def _parts(self, log: list[Entry]) -> list[str]:
        """The parts that count: those of batches, or what the last merge made of them and those after it."""
        merged = self._read("merged.json")
        done = set(merged["of"]) if merged else set()
        own = [e.part for e in log if e.part not in done and e.rows]
        return ([merged["part"]] if merged and merged["part"] else []) + own

    # Parts

    def _table(self, part: str) -> DataFrame:
        """A part as a bucketed table, which this session may not know yet."""
        name = f"near_index_{re.sub('[^a-z0-9]', '_', part)}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({_BANDS}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.slots} BUCKETS LOCATION '{self.folder}/{part}'")
        return self.spark.table(name)

    def _put(self, bands: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        name = f"near_index_{re.sub('[^a-z0-9]', '_', part)}"
        own = bands.select("bucket", "node").repartition(self.slots, "bucket")
        own.write.bucketBy(self.slots, "bucket").sortBy("bucket").option("path", f"{self.folder}/{part}").format("parquet").saveAsTable(name)
        return part

    def _known(self, counts: DataFrame, parts: list[str]) -> DataFrame:
        """Those of the distinct buckets of (bucket, n) that a part has. Either side's buckets are distinct, so a hot one
        weighs no more than others; few of them are broadcast, more are dealt out as the parts are."""
        out = counts.limit(0)
        for part in parts:
            out = out.unionByName(counts.join(self._table(part).select("bucket"), "bucket"))
        return out.groupBy("bucket").agg(F.max("n").alias("n"))

    # Use

    def check(self, df: DataFrame, fields: list[str], order: str) -> DataFrame:
        """The rows of which no field meets the index; nothing is added, and rows aren't compared with each other."""
        bands = saved(banded(field_texts(df, fields, order), self.threshold), "bands")
        node = free_name(df, "its_node")
        hit = self._hit(bands, self._parts(self.log())).select(F.col("node").alias(node))
        return df.join(hinted(hit), F.col(order).cast("long").eqNullSafe(F.col(node)), "left_anti")

    def _hit(self, bands: DataFrame, parts: list[str]) -> DataFrame:
        counts = saved(bands.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
        known = saved(self._known(counts, parts), "known")
        return saved(join_groups(bands, known, "bucket", "n", how="inner").select("node").distinct(), "hit")

    def _gone(self, bands: DataFrame, parts: list[str]) -> DataFrame:
        """The nodes of a batch that aren't kept. Only buckets that a part has, or that several rows have, can decide that,
        so only their rows are moved."""
        counts = saved(bands.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
        known = self._known(counts, parts).withColumn("known", F.lit(True))
        both = known.unionByName(counts.where("n > 1").withColumn("known", F.lit(False)))
        shared = saved(both.groupBy("bucket").agg(F.max("n").alias("n"), F.max("known").alias("known")), "shared")
        met = saved(join_groups(bands, shared, "bucket", "n", how="inner").select("node", "bucket", "known"), "met")
        hit = saved(met.where("known").select("node").distinct(), "hit")
        rest = saved(met.select("node", "bucket").join(hinted(hit), "node", "left_anti").distinct(), "rest")
        stay = saved(rounds(rest), "stay")
        return met.select("node").distinct().join(hinted(stay), "node", "left_anti")

    def add(self, df: DataFrame, batch: str, fields: list[str], order: str, all_rows: bool = False) -> DataFrame:
        """Add a batch and give the rows of it that are kept: first come first kept by ``order`` (a whole number, unique
        in the batch, not null), after all batches before it.

        Only the batch is signed. Its rows that meet the index go; of the others near_dedup()'s greedy rule keeps the
        first ones, whose bands go into the index. ``all_rows`` keeps all (a reference set to stay away from).
        ``batch`` names it: a name that the log has is answered from the log, whatever ``df`` holds, and nothing
        changes. Null fields meet nothing; rows without any text are kept, and add nothing to the index.
        """
        log = self.log()
        done = next((e for e in log if e.batch == batch), None)
        if done is None:
            # a batch is often a range of the input, all in a few of its files: its texts are dealt out over all cores
            texts = field_texts(df, fields, order).repartition(2 * self.spark.sparkContext.defaultParallelism, "node")
            signed = banded(texts, self.threshold)
            bands = saved(signed.distinct() if len(fields) > 1 else signed, "bands")
            parts = self._parts(log)
            kept = df.select(F.col(order).cast("long").alias("node"))
            if all_rows:
                mine = saved(bands.groupBy("bucket").agg(F.min("node").alias("node")), "mine")
            else:
                gone = hinted(saved(self._gone(bands, parts), "gone"))
                kept, mine = (x.join(gone, "node", "left_anti") for x in (kept, bands))
            answer = f"kept-{uuid.uuid4().hex}"
            kept.write.parquet(f"{self.folder}/{answer}")
            part = self._put(mine) if bands.limit(1).count() else ""
            rows = self._table(part).count() if part else 0
            done = Entry(len(log), batch, part if rows else "", answer, rows)
            self._write(f"log/{len(log):08d}.json", done.__dict__)
            if len(parts) + 1 > self.most_parts:
                self.merge()
        node = free_name(df, "its_node")
        stay = self.spark.read.schema(_KEPT).parquet(f"{self.folder}/{done.kept}").select(F.col("node").alias(node))
        return df.join(hinted(stay), F.col(order).cast("long") == F.col(node), "left_semi")

    def merge(self) -> None:
        """All parts as one. The old ones stay until vacuum(), as readers may be at them."""
        log = self.log()
        parts = self._parts(log)
        if len(parts) > 1:
            whole = self._table(parts[0])
            for p in parts[1:]:
                whole = whole.unionByName(self._table(p))
            # a reference set may have a bucket that an earlier part has
            part = self._put(whole.groupBy("bucket").agg(F.min("node").alias("node")))
            old = self._path(f"{self.folder}/merged.json")
            self._write("merged.next", {"part": part, "of": [e.part for e in log]})
            self._fs.delete(old, False)
            self._fs.rename(self._path(f"{self.folder}/merged.next"), old)

    def vacuum(self) -> list[str]:
        """Delete what nothing names: parts that were merged, and what failed batches left. No writer may be at work."""
        log = self.log()
        named = {*self._parts(log), *(e.kept for e in log)}
        gone = []
        for x in self._fs.listStatus(self._path(self.folder)):
            name = x.getPath().getName()
            if re.match(r"(part|kept)-|\.[0-9a-f]{32}$", name) and name not in named:
                self._fs.delete(x.getPath(), True)
                self.spark.sql(f"DROP TABLE IF EXISTS near_index_{re.sub('[^a-z0-9]', '_', name.lstrip('.'))}")
                gone.append(name)
        return gone
