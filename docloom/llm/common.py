"""Shared pieces: Arrow batches, text columns and size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialize, scratch, shared_root, table

__all__ = ["materialize", "per_batch", "pieces", "scratch", "shared_root", "small_or_none", "table", "text_bytes", "text_strings"]


#: About so many bytes of a batch are worked on at once, so that Python's copies of them stay small.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in order, in smaller batches; a worker that stays gives back what Arrow no longer needs."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)
        del batch  # before the next one comes
    pa.default_memory_pool().release_unused()


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Apply a function of one Arrow batch to all rows, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(function, pieces(batches))

    return df.mapInArrow(run, schema)


def small_or_none(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a table for broadcast if it has at most max_rows rows, which are counted; else leave the join to the shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, with nulls as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a column, with nulls as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
