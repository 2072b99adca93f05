"""Rows from file contents, in Arrow batches of limited size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_PER_BATCH = 4096
BYTES_PER_BATCH = 4 << 20  # of the values of its rows that are bytes


def explode_rows(
    df: DataFrame, rows_of: Callable[[dict], Iterable[dict]], schema: StructType
) -> DataFrame:
    """For each row of ``df`` the rows that ``rows_of`` yields for it.

    Input rows are taken one at a time and output is sent on whenever a batch is full, so
    memory holds one input row and one batch, however many rows a file has and however long
    their bytes are.
    """
    arrow_schema = to_arrow_schema(schema)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[dict] = []
        size = 0
        for incoming in batches:
            for i in range(incoming.num_rows):
                for row in rows_of(incoming.slice(i, 1).to_pylist()[0]):
                    pending.append(row)
                    size += sum(len(v) for v in row.values() if isinstance(v, bytes))
                    if len(pending) >= ROWS_PER_BATCH or size >= BYTES_PER_BATCH:
                        yield batch(pending)
                        pending, size = [], 0
        if pending:
            yield batch(pending)

    return df.mapInArrow(run, schema)
