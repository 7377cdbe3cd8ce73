"""Answers that outlive the task that asked for them: an append-only log, looked at before a model is.

Each answer is a line of its own, written as it arrives under the fingerprint of its request. A run first joins its
requests with the log and asks for the rest alone; those are dealt out by fingerprint, and a task that is run again reads
what its earlier attempts have written before it asks. A line that was cut off is passed over.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.store import beside, free_name, looked, mapped, saved

#: Answers in a file; on stores that show a file only once it is closed, a lost task loses so many at most.
ROLL = 64
_LINE = "request string, response string"


def fingerprint(messages: str, most: Column, temperature: float, engine: str) -> Column:
    """One request: its messages, and what the model is asked with."""
    return F.sha2(F.to_json(F.struct(F.col(messages).alias("m"), most.cast("long").alias("n"), F.lit(float(temperature)).alias("t"), F.lit(engine).alias("e"))), 256)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """(request, response), one row for each request that was answered."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _LINE)
    lines = spark.read.schema(_LINE).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(folder)
    return lines.where("request is not null and response is not null").groupBy("request").agg(F.min("response").alias("response"))


class _Writer:
    """Lines of one task attempt, in files of ROLL lines."""

    def __init__(self, folder: str):
        self.files, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.lock, self.stream, self.lines = threading.Lock(), None, 0

    def earlier(self) -> dict[str, str]:
        """What other attempts of this task have written."""
        out = {}
        for info in self.files.get_file_info(pa.fs.FileSelector(self.folder)):
            with self.files.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n"):
                    try:
                        x = json.loads(line)
                        out[x["request"]] = x["response"]
                    except (ValueError, KeyError):  # cut off, or empty
                        continue
        return out

    def put(self, request: str, response: str) -> None:
        line = json.dumps({"request": request, "response": response}).encode() + b"\n"
        with self.lock:
            if self.stream is None:
                self.stream = self.files.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
            self.stream.write(line)
            self.stream.flush()
            self.lines += 1
            if self.lines % ROLL == 0:
                self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def logged(df: DataFrame, messages: str, most: Column, call: Callable, folder: str, engine: str, temperature: float, threads: int) -> DataFrame:
    """All rows with ``response`` and ``error``, by ``call(messages, most)``, each distinct request asked once.

    Equal requests have one answer. What fails isn't logged, so it is asked again in the next run. ``folder`` is one
    that driver and executors share.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("response", "error")]
    request = free_name(df, "its_request")
    keyed = saved(df.select(*names).withColumn(request, fingerprint(messages, most, temperature, engine)), "requests")
    once = keyed.groupBy(F.col(request).alias("request")).agg(F.first(messages).alias("talk"), F.first(most.cast("long")).alias("most"))
    known = saved(read_log(spark, folder), "known")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    open_ = looked(once, known.select("request"), ["request"], "left_anti")
    place = F.pmod(F.xxhash64("request"), F.lit(parts)).cast("int")
    dealt = saved(open_.withColumn("place", place), "open").repartitionById(parts, F.col("place"))
    run = f"{folder}/run-{uuid.uuid4().hex}"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers: dict[int, tuple[_Writer, dict[str, str]]] = {}

        def one(place: int, request: str, talk, most: int) -> tuple[str | None, str | None]:
            writer, earlier = writers[place]
            if request in earlier:
                return earlier[request], None
            response, error = call(talk, most)
            if response is not None:
                writer.put(request, response)
            return response, error

        try:
            with ThreadPoolExecutor(threads) as pool:
                for b in batches:
                    places = b["place"].to_pylist()
                    for place in set(places):
                        if place not in writers:
                            writer = _Writer(f"{run}/{place}")
                            writers[place] = (writer, writer.earlier())
                    got = list(pool.map(one, places, *[b[c].to_pylist() for c in ("request", "talk", "most")]))
                    yield beside(b.select(["request"]), response=[g[0] for g in got], error=[g[1] for g in got])
        finally:
            for writer, _ in writers.values():
                writer.close()

    new = saved(mapped(dealt, ask, "request string, response string, error string"), "answers")
    all_ = known.withColumn("error", F.lit(None).cast("string")).unionByName(new)
    told = all_.select(F.col("request").alias(request), "response", "error")
    return looked(keyed, told, [request]).drop(request)
