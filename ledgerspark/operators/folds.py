"""Folds in order over groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold(rows: DataFrame, key: str, order: list[str], uses: list[str], step: Callable[..., tuple[Any, tuple]], new: str) -> DataFrame:
    """rows with the columns `new`, from going through each key's rows in order (nulls first).

    step(state, *values of uses) gives the next state and the new columns' values; a key's first state is None. Rows are
    sorted on disk where they must be and pass as a stream that holds one state, so a key may have any number of rows.
    Null is a key. Rows of one key are one task's, as each waits for the one before.
    """
    more = T.StructType.fromDDL(new)
    types = [to_arrow_type(f.dataType) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            made = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *uses)), strict=True):
                if k != current:
                    current, state = k, None
                state, out = step(state, *values)
                made.append(out)
            columns = zip(*made, strict=True) if made else [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *more.names])

    placed = rows.repartition(key).sortWithinPartitions(key, *order)
    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields]))
