"""Trees of record files as Spark data sources: one that opens only the files a filter asks for, and one that writes
named files all at once or not at all.
"""

from __future__ import annotations

import json
import operator
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.operators.order import numbered
from quernel.store import free_name

#: Fixed form of a result file's place: experiment / checkpoint with its step / benchmark.
RESULT_FILE = re.compile(r"([^/]+)/([^/]+)/([^/]+)_0_1\.jsonl_results\.jsonl$")
_STEP = re.compile(r"step=(\d+)")
RESULTS = "task_id string, completion string, passed boolean, exp string, step int, benchmark string"
#: Rows of a batch.
ROWS = 4096

_TESTS = {
    D.EqualTo: operator.eq, D.EqualNullSafe: operator.eq, D.In: lambda a, b: a in b, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge,
    D.LessThan: operator.lt, D.LessThanOrEqual: operator.le,
}


@dataclass
class OneFile(D.InputPartition):
    path: str
    exp: str
    step: int | None
    benchmark: str


class ResultTree(D.DataSource):
    """Results under ``path``/<exp>/<checkpoint with step=N>/<benchmark>_0_1.jsonl_results.jsonl."""

    @classmethod
    def name(cls) -> str:
        return "result_tree"

    def schema(self) -> str:
        return RESULTS

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return ResultReader(self.options["path"])


class ResultReader(D.DataSourceReader):
    """A partition for each file. Filters on exp, step and benchmark are met by the choice of files."""

    def __init__(self, root: str):
        self.root, self.tests = root, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            test = _TESTS.get(type(f))
            if test is not None and len(f.attribute) == 1 and f.attribute[0] in ("exp", "step", "benchmark"):
                self.tests.append((f.attribute[0], test, f.value))
            elif isinstance(f, D.IsNotNull) and f.attribute in (("exp",), ("benchmark",)):
                continue  # they never are
            else:
                yield f

    def _asked(self, file: OneFile) -> bool:
        for name, test, value in self.tests:
            own = getattr(file, name)
            if own is None and test is not operator.eq or own is None and value is not None or not test(own, value):
                return False
        return True

    def partitions(self) -> list[OneFile]:
        files, root = pa.fs.FileSystem.from_uri(self.root)
        out = []
        for info in files.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            if info.is_file and (found := RESULT_FILE.search(posixpath.relpath(info.path, root))) and found.start() == 0:
                step = _STEP.search(found[2])
                file = OneFile(info.path, found[1], int(step[1]) if step else None, found[3])
                if self._asked(file):
                    out.append(file)
        return out or [OneFile("", "", None, "")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("task_id", pa.string()), ("completion", pa.string()), ("passed", pa.bool_()), ("exp", pa.string()), ("step", pa.int32()), ("benchmark", pa.string())])
        if not partition.path:
            yield pa.RecordBatch.from_pylist([], kind)
            return
        place = {"exp": partition.exp, "step": partition.step, "benchmark": partition.benchmark}
        rows: list[dict] = []
        with pa.fs.FileSystem.from_uri(self.root)[0].open_input_stream(partition.path) as raw, pa.input_stream(raw) as stream:
            for line in _lines(stream):
                row = _result(line)
                if row is not None:
                    rows.append(row | place)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, kind)


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    left = b""
    while part := stream.read(1 << 20):
        *whole, left = (left + part).split(b"\n")
        yield from whole
    yield left


def _result(line: bytes) -> dict | None:
    """A record, or None for a line that is blank or isn't one."""
    try:
        x = json.loads(line)
    except ValueError:
        return None
    if not isinstance(x, dict):
        return None
    row = {"task_id": x.get("task_id"), "completion": x.get("completion"), "passed": x.get("passed")}
    fits = all(row[k] is None or isinstance(row[k], kind) for k, kind in (("task_id", str), ("completion", str), ("passed", bool)))
    return row if fits and any(v is not None for v in row.values()) else None


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """All results of a tree, with exp, step and benchmark from the path; a filter on these opens only its files. Lines
    that aren't records of the schema are passed over. ``root`` is a URI that driver and executors reach."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultTree)
    return spark.read.format("result_tree").load(root)


# Named files ----------------------------------------------------------------------------------------------

@dataclass
class Written(D.WriterCommitMessage):
    """Files of one task: name, and rows."""

    files: dict[str, int]


class NamedFiles(D.DataSource):
    """Writes each row as a line of JSON to the file that its column ``file`` names, under ``path``. ``expected``: JSON
    list of names that have to be there, empty if no row has them."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceArrowWriter:
        return NamedWriter(self.options["path"], json.loads(self.options.get("expected", "[]")), overwrite)


class NamedWriter(D.DataSourceArrowWriter):
    """Tasks write to a draft folder beside the target; committing renames it once all tasks are done, and aborting
    deletes it. A task that is run again writes drafts of its own."""

    def __init__(self, path: str, expected: list[str], overwrite: bool):
        self.path, self.expected, self.overwrite = path.rstrip("/"), expected, overwrite
        self.draft = f"{self.path}.draft-{uuid.uuid4().hex}"

    def _open(self, uri: str) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._open(self.draft)
        attempt, counts, streams = uuid.uuid4().hex, {}, {}
        try:
            for b in iterator:
                for row in b.to_pylist():
                    name = row.pop("file")
                    if name not in streams:
                        for old in streams.values():  # rows come file by file, so one is open at a time
                            old.close()
                        if name in counts:
                            raise ValueError(f"rows of {name} are not together")
                        files.create_dir(posixpath.dirname(f"{root}/{attempt}/{name}"), recursive=True)
                        streams = {name: files.open_output_stream(f"{root}/{attempt}/{name}")}
                        counts[name] = 0
                    streams[name].write(json.dumps(row, ensure_ascii=False, default=str).encode("utf-8", "surrogatepass") + b"\n")
                    counts[name] += 1
        finally:
            for s in streams.values():
                s.close()
        return Written({f"{attempt}/{name}": n for name, n in counts.items()})

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._open(self.draft)
        target = self._open(self.path)[1]
        done: set[str] = set()
        for file in (f for m in messages if m is not None for f in m.files):
            name = file.partition("/")[2]
            if name in done:
                raise ValueError(f"more than one task has rows of {name}")
            done.add(name)
            files.create_dir(posixpath.dirname(f"{root}/whole/{name}"), recursive=True)
            files.move(f"{root}/{file}", f"{root}/whole/{name}")
        files.create_dir(f"{root}/whole", recursive=True)
        for name in set(self.expected) - done:
            with files.open_output_stream(f"{root}/whole/{name}"):
                pass
        if files.get_file_info(target).type != pa.fs.FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(self.path)
            files.move(target, f"{root}/old")
        files.create_dir(posixpath.dirname(target), recursive=True)
        files.move(f"{root}/whole", target)
        files.delete_dir(root)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = self._open(self.draft)
        if files.get_file_info(root).type != pa.fs.FileType.NotFound:
            files.delete_dir(root)


def write_named(df: DataFrame, path: str, expected: list[str] | None = None, overwrite: bool = False, order: list | None = None) -> None:
    """Each row to the file that its column ``file`` names (relative to ``path``), as a line of JSON, in ``order``.

    No file is there before all are, and a job that fails leaves none. Rows of a file go through one task, as a stream.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    dealt = df.repartition(F.col("file")).sortWithinPartitions("file", *(order or []))
    kept = dealt.select("file", *[c for c in df.columns if c != "file"])
    kept.write.format("named_files").option("expected", json.dumps(expected or [])).mode("overwrite" if overwrite else "append").save(path)


def write_named_shards(df: DataFrame, path: str, shards: int, order: list) -> None:
    """``path``/shard-00000.jsonl and so on: equal runs of rows in order, exactly one file for each of ``shards``."""
    at = free_name(df, "its_index")
    placed = numbered(df.drop("file"), [], order, at)
    size = -(-placed.count() // shards) or 1
    shard = F.floor(F.col(at) / size).cast("int")
    named = placed.withColumn("file", F.concat(F.lit("shard-"), F.lpad(shard.cast("string"), 5, "0"), F.lit(".jsonl")))
    hidden = [c for c in named.columns if c != at]
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    dealt = named.repartitionById(shards, shard).sortWithinPartitions("file", at).select("file", *[c for c in hidden if c != "file"])
    expected = [f"shard-{i:05d}.jsonl" for i in range(shards)]
    dealt.write.format("named_files").option("expected", json.dumps(expected)).mode("append").save(path)
