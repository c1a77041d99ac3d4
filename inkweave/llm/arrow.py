"""Arrow batches of Python rows: the one way in which the text operators leave the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows held back before a batch goes out; bounds the memory of a Python worker.
OUT_ROWS = 5000


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` turns the rows of a partition (tuples, lazily) into rows of ``schema``."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for row in fn(rows(batches)):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield out()
                held.clear()
        if held:
            yield out()

    return df.mapInArrow(run, struct)
