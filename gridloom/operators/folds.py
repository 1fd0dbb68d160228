"""Folds over one group's rows at a time, where what stays depends on what stayed before.

Groups are made by one shuffle and a sort within partitions; a Python worker then walks them as they come, in Arrow batches, so that a group of a few
rows costs a few microseconds and not a data frame. One group is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType


def fold_groups(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """fold gets the rows of a group, as tuples in the order of ``df``'s columns, sorted by ``order``; what it gives are rows of ``schema``."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, at = to_arrow_schema(kind), [df.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                now = tuple(row[i] for i in at)
                if now != key and rows:
                    out += fold(rows)
                    rows = []
                key = now
                rows.append(row)
            if len(out) > 5000:
                yield _batch(out, arrow)
                out = []
        if rows:
            out += fold(rows)
        if out:
            yield _batch(out, arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def with_number(df: DataFrame, name: str) -> StructType:
    """The schema of ``df`` with a whole number added."""
    return StructType([*df.schema.fields, StructField(name, IntegerType())])
