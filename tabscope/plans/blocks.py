"""Columns of numbers dealt out as blocks: a row per part and block of rows, the numbers in it as bytes.

A shuffle of blocks carries the bytes of the numbers and little else, and Spark handles few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_PER_BLOCK = 1 << 18  # rows of a task that are dealt out at once


def _dealt(batches: Iterator[pa.RecordBatch], number: Callable, rows: int) -> Iterator[tuple]:
    """(parts, where each begins, columns in the order of the parts) of so many rows at a time."""

    def deal(held: list) -> tuple:
        columns = [np.concatenate(c) for c in zip(*held)]
        parts = np.asarray(number(*columns), np.int64)
        order = np.argsort(parts, kind="stable")
        order = order[np.searchsorted(parts[order], 0) :]
        names, starts = np.unique(parts[order], return_index=True)
        return names, starts, [c[order] for c in columns]

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield deal(held)
            held, n = [], 0
    if n:
        yield deal(held)


def numbers(column: pa.ChunkedArray | pa.Array, kind: str = "float64") -> np.ndarray:
    """The numbers in the blocks of a column, one block after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def as_blocks(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The values as blocks that begin at the given places, of which the first is 0."""
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def deal_blocks(rows: DataFrame, name: str, number: Callable, kept: list[str]) -> DataFrame:
    """(name, kept...): blocks of the kept columns, by the whole number that ``number`` gives each row.

    ``number`` takes arrays of all columns of the rows, which are numbers and not NULL; rows whose number is
    below 0 are left out.
    """
    places, size = [rows.columns.index(c) for c in kept], ROWS_PER_BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, starts, columns in _dealt(batches, number, size):
            blocks = [as_blocks(columns[i], starts) for i in places]
            yield pa.RecordBatch.from_arrays([pa.array(names), *blocks], [name, *kept])

    return rows.mapInArrow(work, ", ".join([f"`{name}` long", *[f"`{c}` binary" for c in kept]]))


def extents(rows: DataFrame, name: str, number: Callable, value: str) -> DataFrame:
    """(name, low, high, n): least and greatest value and number of rows, for each block of ``deal_blocks``."""
    place, size = rows.columns.index(value), ROWS_PER_BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, starts, columns in _dealt(batches, number, size):
            if not len(names):
                continue
            v = columns[place]
            found = [names, np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts), np.diff(np.append(starts, len(v)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], [name, "low", "high", "n"])

    return rows.mapInArrow(work, f"`{name}` long, low double, high double, n long")
