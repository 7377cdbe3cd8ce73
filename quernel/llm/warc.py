"""WARC archives written and read by Spark tasks, with a two-level capture index.

Records are gzip members, so each can be read alone by its offset. The index sorts captures by a key of the
URL with its host reversed, in blocks of lines that are compressed each; a sparse directory holds the first
key of each block. A lookup searches the directory, then the one block, by halving, and reads one range.
Files are reached through Arrow's file systems, so the folder may be any that those know.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.store import join_groups, mapped, new_path, saved

BLOCK_LINES = 2000
FILE_BYTES = 256 << 20  #: a new archive file is begun beyond this
_CAPTURE = "url_key string, page_id long, file string, offset long, length long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Output:
    """A file that appears under its name only when it is whole, so attempts of a task don't mix."""

    def __init__(self, folder: str, name: str) -> None:
        self.system, root = opened(folder)
        self.name, self.root, self.size = f"{root}/{name}", root, 0
        self.own = f"{self.name}.{uuid.uuid4().hex}"
        self.system.create_dir(root, recursive=True)
        self.stream = self.system.open_output_stream(self.own, compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.own, self.name)


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def url_key(url: str | None) -> str:
    """Host reversed, then path and query: ``https://a.b.org/x?y`` gives ``org,b,a)/x?y``. A null URL gives ''."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return "".join(f"%{ord(x):02X}" if ord(x) <= 32 else x for x in url)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    key += ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(f"%{ord(x):02X}" if ord(x) <= 32 else x for x in key)


def url_keys(url: Column | str) -> Column:
    def keys(x: pd.Series) -> pd.Series:
        return x.map(url_key)

    return F.pandas_udf(keys, "string")(url)


def _record_id(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit whose payload is in the one referred to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row; give (url_key, page_id, file, offset, length) of each, saved.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those of the largest page_id are responses and
    the others revisit it; rows with smaller payloads are all responses. A null payload is empty. A row with a
    null page_id is a revisit if another has one, else a response. Repeated rows get a record each.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    groups = rows.where(F.length("body") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1 and response is not null"), "equal-payloads")
    joined = join_groups(rows, groups, "digest", "n", noise="page_id").withColumn(
        "revisit", F.coalesce(~F.col("response").eqNullSafe(F.col("page_id")), F.lit(False)) & F.col("response").isNotNull()
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, out = TaskContext.get().partitionId(), 0, None
        for b in batches:
            got = []
            for i, link, body, response, revisit in zip(*(b[c].to_pylist() for c in ("page_id", "url", "body", "response", "revisit")), strict=True):
                if out is None or out.size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    out, turn = _Output(folder, f"archive-{part:05d}-{turn:04d}.warc.gz"), turn + 1
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                at, size = out.write(_gzip(record(i, link, body, digest, response, revisit)))
                got.append((url_key(link), i, out.name.rpartition("/")[2], at, size))
            yield _rows(got, _CAPTURE)
        if out is not None:
            out.close()

    ordered = joined.select("page_id", "url", "body", "response", "revisit", "digest").sortWithinPartitions("page_id", "digest", "url")
    return saved(mapped(ordered, write, _CAPTURE), "captures")


def _rows(got: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*got, strict=True)) if got else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _order(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, int, int]]:
    """Sort captures into index parts of compressed blocks, each with its sparse directory.

    Gives (first key, first page_id, part) of each part, in order: as many as there are partitions.
    """
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, block, directory = TaskContext.get().partitionId(), None, [], []

        def flush() -> None:
            key, i = block[0].split("\t", 2)[:2]
            at, size = out.write(_gzip("\n".join(block).encode()))
            directory.append(f"{key}\t{i}\t{at}\t{size}")
            block.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or _Output(folder, f"index-{part:05d}.gz")
                block.append("\t".join((row[0], str(_order(row[1])), *map(str, row[2:]))))
                if len(block) >= BLOCK_LINES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        sparse = _Output(folder, f"directory-{part:05d}.gz")
        sparse.write(_gzip("\n".join(directory).encode()))
        sparse.close()
        key, i = directory[0].split("\t")[:2]
        yield _rows([(key, int(i), part)], "key string, id long, part int")

    made = captures.repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return sorted(tuple(r) for r in saved(mapped(made, write, "key string, id long, part int"), "parts").collect())


class _Index:
    """One part: its directory in memory, blocks read as they are needed."""

    def __init__(self, folder: str, part: int) -> None:
        system, root = opened(folder)
        with system.open_input_file(f"{root}/directory-{part:05d}.gz") as f:
            lines = [x.split("\t") for x in zlib.decompress(f.read(), 31).decode().split("\n")]
        self.first = [(x[0], int(x[1])) for x in lines]
        self.place = [(int(x[2]), int(x[3])) for x in lines]
        self.file = system.open_input_file(f"{root}/index-{part:05d}.gz")
        self.at, self.lines = -1, []

    def block(self, at: int) -> list[tuple]:
        if at != self.at:
            offset, size = self.place[at]
            text = zlib.decompress(self.file.read_at(size, offset), 31).decode()
            self.at, self.lines = at, [(x[0], int(x[1]), x[2], int(x[3]), int(x[4])) for x in (y.split("\t") for y in text.split("\n"))]
        return self.lines

    def find(self, want: tuple[str, int]) -> Iterator[tuple]:
        at = max(bisect.bisect_left(self.first, want) - 1, 0)
        while at < len(self.first) and self.first[at] <= want:
            lines = self.block(at)
            i = bisect.bisect_left(lines, want)
            while i < len(lines) and lines[i][:2] == want:
                yield lines[i]
                i += 1
            at += 1


def lookup(wanted: DataFrame, folder: str, parts: list[tuple[str, int, int]]) -> DataFrame:
    """All captures of the (url_key, page_id) rows of ``wanted``, which are taken once each."""
    starts = [p[:2] for p in parts]
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = None, None
        for b in batches:
            got = []
            for key, i in zip(b["url_key"].to_pylist(), b["page_id"].to_pylist(), strict=True):
                want = (key, _order(i))
                part = bisect.bisect_right(starts, want) - 1
                if part < 0:
                    continue
                if part != last:
                    index, last = _Index(folder, parts[part][2]), part
                got += [(k, i, *rest) for k, _, *rest in index.find(want)]
            yield _rows(got, _CAPTURE)

    if not parts:
        return wanted.sparkSession.createDataFrame([], _CAPTURE)
    once = wanted.select("url_key", F.col("page_id").cast("long").alias("page_id")).distinct()
    return mapped(once.repartitionByRange(tasks, "url_key", "page_id").sortWithinPartitions("url_key", "page_id"), find, _CAPTURE)


def parse(data: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To")), "payload": None if revisit else payload,
    }


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Range reads of the captures' records. A response's size and digest are those of the payload read;
    a revisit's are those it states. With ``payload``, a column of that name (null for revisits)."""
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _RECORD + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        last, f = None, None
        for b in batches:
            got = []
            for name, at, size in zip(*(b[c].to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name != last:
                    last, f = name, system.open_input_file(f"{root}/{name}")
                found = parse(zlib.decompress(f.read_at(size, at), 31))
                got.append(tuple(found[n] for n in names))
                if payload and len(got) >= 500:
                    yield _rows(got, schema)
                    got = []
            yield _rows(got, schema)

    return mapped(captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset"), read, schema)


def archived(pages: DataFrame, folder: str | None = None, payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives, index them, look every page up again, and read its record."""
    folder = folder or new_path(pages.sparkSession, "archives")
    captures = write_archives(pages, folder)
    parts = build_index(captures, folder)
    wanted: Column = url_keys("url")
    found = lookup(pages.select(wanted.alias("url_key"), "page_id"), folder, parts)
    return read_records(saved(found, "found"), folder, payload)
