"""Pearson correlation of column pairs over the rows where both are present, by tiles of the product matrix.

Columns are cut into blocks. A tile is a pair of blocks: it reads only their columns, and each task
multiplies the two blocks of its rows, batch by batch, into sums of one tile's size, which are added up by
pair in one shuffle. So the memory of a task and what it sends do not grow with the width of the table, and
one way serves two columns as well as thousands. The sums of a pair stay rows of a table from start to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.local import local_table
from tabscope.plans.moments import basic_stats
from tabscope.plans.scratch import materialise

COLUMNS_PER_BLOCK = 256  # six sums for each of its pairs: 3 MB a tile
ROWS_PER_PRODUCT = 8192
ROUNDING = 1e-14  # what rounding alone can leave of a constant column's spread

SCHEMA = "col_a string, col_b string, n long, r double"
_SUMS = ["n", "sa", "sb", "aa", "bb", "ab"]
_TILE = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For all pairs of columns: rows with both, sums, sums of squares and of products over these."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    if here.all() and there.all():
        shape = (x.shape[1], y.shape[1])
        a, b = np.broadcast_to(x.sum(0)[:, None], shape), np.broadcast_to(y.sum(0), shape)
        aa, bb = np.broadcast_to((x * x).sum(0)[:, None], shape), np.broadcast_to((y * y).sum(0), shape)
        return np.stack([np.full(shape, float(len(x))), a, b, aa, bb, x.T @ y])
    x, y, here, there = np.nan_to_num(x), np.nan_to_num(y), here.astype(float), there.astype(float)
    return np.stack([here.T @ there, x.T @ there, here.T @ y, (x * x).T @ there, here.T @ (y * y), x.T @ y])


def _tile(df: DataFrame, names: list[str], cells: list[tuple[int, int]], stats: dict) -> DataFrame:
    """(i, j, sums) of the wanted cells, column numbers in ``names``, one row for each and task."""
    rows = sorted({i for i, _ in cells})
    columns = sorted({j for _, j in cells})
    used = sorted({*rows, *columns})
    left, right = [used.index(i) for i in rows], [used.index(j) for j in columns]
    at = (np.searchsorted(rows, [i for i, _ in cells]), np.searchsorted(columns, [j for _, j in cells]))
    # Centred and scaled to about one, sums keep their digits.
    shift = np.array([stats[names[i]]["mean"] or 0.0 for i in used])
    span = np.array([max(abs(stats[names[i]]["max"] or 0.0), abs(stats[names[i]]["min"] or 0.0)) for i in used])
    scale = np.where(span > 0, span, 1.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_SUMS), len(rows), len(columns)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_PRODUCT):
                part = batch.slice(start, ROWS_PER_PRODUCT)
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                values = (values - shift) / scale
                total += _products(values[:, left], values[:, right])
        found = [pa.array([i for i, _ in cells], pa.int32()), pa.array([j for _, j in cells], pa.int32())]
        sums = [pa.array(s[at]) for s in total]
        yield pa.RecordBatch.from_arrays([*found, *sums], ["i", "j", *_SUMS])

    chosen = [names[i] for i in used]
    data = clean(df, chosen).select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(chosen)])
    return data.mapInArrow(work, _TILE)


def _correlation(constant: Column) -> Column:
    """r from sums of centred values; NULL when a side has no spread over the shared rows."""
    n, sa, sb, aa, bb, ab = (F.col(s) for s in _SUMS)
    n = F.when(n > 0, n)
    va, vb = aa - sa * sa / n, bb - sb * sb / n
    spread = (va > ROUNDING * (aa + 1e-300)) & (vb > ROUNDING * (bb + 1e-300))
    r = F.try_divide(ab - sa * sb / n, F.sqrt(va) * F.sqrt(vb))
    return F.when(~constant & (n >= 2) & spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pair_correlations(
    df: DataFrame,
    columns: list[str] | None = None,
    pairs: list[tuple[str, str]] | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """(col_a, col_b, n, r) for all pairs in column order, or for the given pairs.

    r is NULL when a column is constant over the shared rows. The result is written down once, since
    it is usually read more than once.
    """
    names = infer_kinds(df).numeric if columns is None else list(columns)
    wanted = list(combinations(names, 2)) if pairs is None else list(pairs)
    if not wanted:
        return local_table(df.sparkSession, [], SCHEMA)
    used = list(dict.fromkeys(c for p in wanted for c in p))
    stats = stats or basic_stats(df, used)
    place = {c: i for i, c in enumerate(used)}
    tiles: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in wanted:
        i, j = place[a], place[b]
        tiles.setdefault((i // COLUMNS_PER_BLOCK, j // COLUMNS_PER_BLOCK), []).append((i, j))
    parts = [_tile(df, used, cells, stats) for cells in tiles.values()]
    # A pair belongs to one tile; tasks are what is summed over. An empty table has no task.
    sums = reduce(DataFrame.unionAll, parts).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    names_of = local_table(
        df.sparkSession,
        [(place[a], place[b], a, b, any(stats[c]["min"] == stats[c]["max"] for c in (a, b))) for a, b in wanted],
        "i int, j int, col_a string, col_b string, constant boolean",
    )
    rows = names_of.join(sums, ["i", "j"], "left").select(
        "col_a",
        "col_b",
        F.coalesce(F.col("n").cast("long"), F.lit(0)).cast("long").alias("n"),
        _correlation(F.col("constant")).alias("r"),
    )
    return materialise(rows, "pairs")
