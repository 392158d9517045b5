"""Which columns have few distinct values, and which have no value twice: exact, without counting all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.plans.kinds import clean


def few_values(df: DataFrame, columns: list[str], limit: int) -> dict[str, int]:
    """The number of distinct non-NULL values of each column that has at most ``limit``.

    A task stops looking at a column once it has seen more, so it sends at most limit + 1 values of it.
    """
    if not columns:
        return {}
    data = clean(df, columns).select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in columns]
        for batch in batches:
            for own, values in zip(seen, batch.columns):
                if len(own) <= limit:
                    new = pc.unique(values.drop_null())
                    own.update(new.slice(0, 2 * limit + 2).to_pylist() if len(new) > limit else new.to_pylist())
        rows = [(i, v) for i, own in enumerate(seen) for v in sorted(own)[: limit + 1]]
        places, values = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(values, pa.string())], ["pos", "value"]
        )

    found = data.mapInArrow(work, "pos int, value string").distinct().groupBy("pos").agg(F.count("*").alias("n"))
    # One row per column.
    counts = {r["pos"]: r["n"] for r in found.collect()}
    return {c: counts.get(i, 0) for i, c in enumerate(columns) if counts.get(i, 0) <= limit}


def without_repeats(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns in which no batch of any task holds a value twice; the others are not unique."""
    if not columns:
        return []
    data = clean(df, columns).select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated: set[int] = set()
        for batch in batches:
            for i, values in enumerate(batch.columns):
                if i not in repeated and len(pc.unique(values)) < len(values):
                    repeated.add(i)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(repeated), pa.int32())], ["pos"])

    repeated = {r["pos"] for r in data.mapInArrow(work, "pos int").distinct().collect()}
    return [c for i, c in enumerate(columns) if i not in repeated]
