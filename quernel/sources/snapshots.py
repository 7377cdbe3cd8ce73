"""Snapshots of stages that notice what they were made of.

A snapshot lies under a digest of what its rows follow from: the plan, the schema, the input files with their sizes and
times, and a version that the caller states. It is used again only if all of these are the same; what was made of
anything else is made anew, beside it. A pointer names a stage's present snapshot, and a sweep deletes what no
pointer names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder of any file system that Spark reaches, seen from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def has(self, name: str = "") -> bool:
        return self._files.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._files.listStatus(self.at(name))) if self.has(name) else []

    def sizes(self, name: str = "") -> dict[str, tuple[int, int]]:
        """Length and time of each file right under a folder, or of a file."""
        return {x.getPath().toString(): (x.getLen(), x.getModificationTime()) for x in self._files.listStatus(self.at(name))}

    def read(self, name: str) -> dict | None:
        if not self.has(name):
            return None
        stream = self._files.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Under another name first, then by a rename, so a reader finds all of it or what was there before."""
        draft = f".draft-{uuid.uuid4().hex}"
        stream = self._files.create(self.at(draft))
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        self._files.mkdirs(self.at(name).getParent())
        if self.has(name):
            self._files.delete(self.at(name), False)
        if not self._files.rename(self.at(draft), self.at(name)):
            raise OSError(f"{self.root}/{name} could not be written")

    def delete(self, name: str) -> None:
        self._files.delete(self.at(name), True)


def plan_text(df: DataFrame) -> str:
    """The plan with its numbering evened out, whole."""
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name, None)
    conf.set(name, str(1 << 20))
    try:
        text = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    return re.sub(r"#\d+L?", "#", text)


def inputs(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Size and time of each file that the rows are read from; folders are listed once each."""
    found, out = df.inputFiles(), {}
    folders: dict[str, set[str]] = {}
    for f in found:
        folders.setdefault(f.rpartition("/")[0], set()).add(f)
    for folder, files in folders.items():
        listed = {k.rpartition("/")[2]: v for k, v in Folder(df.sparkSession, folder).sizes().items()}
        out |= {f: listed.get(re.sub("%20", " ", f.rpartition("/")[2]), (-1, -1)) for f in files}
    return out


#: Rows that plans hold themselves, or get from the driver: a plan's text doesn't tell them apart.
_UNSEEN = ("LocalRelation", "LogicalRDD", "ExternalRDD")


def manifest(df: DataFrame, version: str | None) -> dict | None:
    """What the rows follow from; None if that can't be told, as rows come from the driver and no version is stated."""
    plan = plan_text(df)
    if version is None and any(x in plan for x in _UNSEEN):
        return None
    return {"plan": hashlib.sha256(plan.encode()).hexdigest(), "schema": df.schema.json(), "inputs": {k: list(v) for k, v in sorted(inputs(df).items())}, "version": version}


def snapshot(df: DataFrame, folder: str, stage: str, version: str | None = None) -> DataFrame:
    """The rows of a stage, from its snapshot if that was made of the same plan, schema, input files and version; else it
    is made and becomes the stage's present one.

    The code of Python functions is not in a plan, and rows from the driver are not told apart: state a ``version`` that
    changes with them. Without one, a plan with rows from the driver is always run.
    """
    spark, at = df.sparkSession, Folder(df.sparkSession, folder)
    made = manifest(df, version)
    name = f"{stage}/{hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()[:32] if made else uuid.uuid4().hex}"
    if made is None or at.read(f"{name}/manifest.json") != made:
        at.delete(name)  # what a run that was cut off has left
        df.write.parquet(f"{folder}/{name}/rows")
        at.write(f"{name}/manifest.json", made or {})
    if at.read(f"{stage}/present.json") != {"name": name}:
        at.write(f"{stage}/present.json", {"name": name})
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}/rows")


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Delete the snapshots that no stage's pointer names, and drafts. No run may be at work in the folder."""
    at, gone = Folder(spark, folder), []
    for stage in at.names():
        if stage.startswith(".draft-"):
            at.delete(stage)
            gone.append(stage)
            continue
        present = (at.read(f"{stage}/present.json") or {}).get("name")
        for name in at.names(stage):
            if name != "present.json" and f"{stage}/{name}" != present:
                at.delete(f"{stage}/{name}")
                gone.append(f"{stage}/{name}")
    return gone
