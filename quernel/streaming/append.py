"""Records that go on arriving: an append-only sink that can be resumed.

Structured Streaming keeps the offsets, so a restarted run goes on where the last one ended, and each batch is
written under its own number, so a batch that is run twice is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def append_new(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Read the files of JSON lines that are new in ``source``, run ``stage`` on each batch, and add it to ``sink``."""

    def write(batch: DataFrame, number: int) -> None:
        rows = stage(batch) if stage is not None else batch
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{sink}/batch={number}")

    read = spark.readStream.schema(schema).json(source)
    return read.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
