"""Sequential folds by key: rows stream through a task in order, and a key's state is all that is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], step: Callable[[Any, dict], tuple[Any, dict]], add: str) -> DataFrame:
    """`df` with the columns `add` (DDL) that `step(state, row) -> (state, {column: value})` gives, row after row of each key.

    The state starts as None. Spark partitions by key and sorts within; a key with very many rows streams through its
    task in constant memory, as each row depends on the one before.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(add).fields])
    arrow_schema = to_arrow_schema(schema)
    added = StructType.fromDDL(add).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            out: list[list] = [[] for _ in added]
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, None
                state, values = step(state, row)
                for column, name in zip(out, added, strict=True):
                    column.append(values[name])
            columns = [*batch.columns, *out]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
