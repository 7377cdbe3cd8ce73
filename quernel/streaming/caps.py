"""Numbers and caps of rows within groups, over a stream: what was counted in earlier batches is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernel.store import free_name, mapped


def _heads(by: list[str], order: list[str], most: int):
    """Of a task's rows the first ``most`` of each group, so that a group of any size comes to its state as few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            part = pa.Table.from_batches([b])
            held = part if held is None else pa.concat_tables([held, part])
            held = _first(held, by, order, most)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def _first(rows: pa.Table, by: list[str], order: list[str], most: int) -> pa.Table:
    keys = rows.select(list(dict.fromkeys([*by, *order]))).to_pandas()
    keys = keys.sort_values(order, kind="stable", na_position="first")
    turn = keys.groupby(by, dropna=False, sort=False).cumcount()
    return rows.take(pa.array(sorted(turn.index[turn < most])))


def capped(stream: DataFrame, by: str, order: str, most: int, name: str = "turn") -> DataFrame:
    """The first ``most`` rows of each group of equal ``by`` (nulls are a group), numbered from 0 in the column ``name``
    (an old one goes), over all that has come: rows of earlier batches go first, then ``order`` (null first).

    A group's state is one number, so it takes the same room whatever has passed; a restarted query goes on from its
    checkpoint. Each task passes on at most ``most`` rows of a group, and only groups that a batch has rows of are
    touched. Also works on a table that is no stream, as one batch.
    """
    df = stream.drop(name)
    names = df.columns
    key = free_name(df, "its_group")
    slim = mapped(df, _heads([by], [order], most), df.schema)
    keyed = slim.withColumn(key, F.to_json(F.struct(F.col(by).alias("k"))))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def cap(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        held: pd.DataFrame | None = None
        for part in parts:
            held = part if held is None else pd.concat([held, part])
            held = held.sort_values(order, kind="stable", na_position="first").head(most - n)
        if held is not None and len(held):
            out = held[names].assign(**{name: range(n, n + len(held))})
            state.update((n + len(out),))
            yield out

    if not stream.isStreaming:
        first = lambda part: part.sort_values(order, kind="stable", na_position="first").head(most)[names]
        return keyed.groupBy(key).applyInPandas(lambda part: first(part).assign(**{name: range(min(most, len(part)))}), schema)
    return keyed.groupBy(key).applyInPandasWithState(cap, schema, "n long", "append", GroupStateTimeout.NoTimeout)
