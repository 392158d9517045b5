"""Exact quantiles with linear interpolation, without holding a column in one place.

The columns are narrowed in passes: a pass counts the values in equal-width bins of the range
that still holds a wanted rank, keeps the bin of that rank, and goes on inside the smallest
and largest value found there. Each pass is one scan with a partial aggregation to a bounded
number of bins, so neither skew nor ties nor size moves rows between executors. Once few rows
are left between the bounds, their values are read out. Spark's own ``percentile`` keeps every
distinct value of a column in one buffer, which does not hold for long columns.

Bins of equal width tell little about a column with a far outlier. Where the range is many standard
deviations wide, or a first pass leaves most rows in one bin, a quantile sketch brackets the wanted
ranks instead, and one scan counts what lies below and inside; the search goes on inside the brackets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.plans.kinds import clean
from tabscope.plans.moments import basic_stats

BINS = 2048
READ_OUT_ROWS = 50_000
COLUMNS_PER_PASS = 12
SKETCH = 20_000  # accuracy of the sketch: ranks are off by a share of 1 / SKETCH at most
WIDE_RANGE = 200.0  # standard deviations


@dataclass(frozen=True)
class _Range:
    """Rows of ``column`` in [low, high]; ``below`` rows are smaller than low."""

    column: str
    low: float
    high: float
    below: int
    rows: int


def _inside(r: _Range) -> Column:
    x = col(r.column).cast("double")
    return (x >= F.lit(r.low)) & (x <= F.lit(r.high))


def _any_inside(ranges: list[_Range]) -> Column:
    return reduce(or_, [_inside(r) for r in ranges])


def _narrow(df: DataFrame, ranges: list[_Range]) -> dict[_Range, list]:
    """Bin counts of each range: at most len(ranges) * BINS rows."""
    values = F.array(*[F.when(_inside(r), col(r.column).cast("double")) for r in ranges])
    near = df.filter(_any_inside(ranges))
    hits = near.select(F.posexplode(values).alias("r", "x")).filter("x IS NOT NULL")

    def per_range(numbers: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in numbers]), F.col("r") + 1)

    # Halved so that high - low cannot overflow. Every step is monotone in x,
    # which is all that the selection needs to be exact.
    low = per_range([r.low / 2 for r in ranges])
    width = per_range([r.high / 2 - r.low / 2 for r in ranges])
    scaled = (F.col("x") / 2 - low) / width * F.lit(float(BINS))
    rows = (
        hits.withColumn("bin", F.least(F.floor(scaled), F.lit(BINS - 1)).cast("int"))
        .groupBy("r", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()
    )
    out: dict[_Range, list] = {r: [] for r in ranges}
    for row in sorted(rows, key=lambda v: (v["r"], v["bin"])):
        out[ranges[row["r"]]].append(row)
    return out


def _locate(r: _Range, bins: list, rank: int) -> _Range:
    below = r.below
    for b in bins:
        if rank < below + b["n"]:
            return _Range(r.column, b["lo"], b["hi"], below, b["n"])
        below += b["n"]
    raise RuntimeError(f"rank {rank} not found in column {r.column}: the input changed between passes")


def _read_out(df: DataFrame, wanted: dict[tuple[str, int], _Range]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks of ranges that hold at most READ_OUT_ROWS rows."""
    ranges = list(dict.fromkeys(wanted.values()))
    sorted_values = [
        F.sort_array(F.collect_list(F.when(_inside(r), col(r.column).cast("double")))).alias(f"v{i}")
        for i, r in enumerate(ranges)
    ]
    picks = [
        F.element_at(F.col(f"v{ranges.index(r)}"), rank - r.below + 1).alias(f"p{i}")
        for i, ((_, rank), r) in enumerate(wanted.items())
    ]
    row = df.filter(_any_inside(ranges)).agg(*sorted_values).select(*picks).first()
    return {key: row[i] for i, key in enumerate(wanted)}


def _bracketed(df: DataFrame, keys: list[tuple[str, int]], stats: dict) -> dict[tuple[str, int], _Range]:
    """A narrow range around each wanted rank, from a sketch; only where a count proves that it holds the rank."""
    ends, sketches = [], []
    for i, (name, rank) in enumerate(keys):
        n = stats[name]["count"]
        shares = [max(0.0, rank / n - 2 / SKETCH), min(1.0, (rank + 1) / n + 2 / SKETCH)]
        sketches.append(F.percentile_approx(col(name).cast("double"), shares, SKETCH).alias(f"q{i}"))
    ends = df.agg(*sketches).first()
    counts = []
    for i, (name, _) in enumerate(keys):
        x, (low, high) = col(name).cast("double"), ends[i]
        counts += [F.count_if(x < low).alias(f"b{i}"), F.count_if((x >= low) & (x <= high)).alias(f"r{i}")]
    row = df.agg(*counts).first()
    found = {}
    for i, (name, rank) in enumerate(keys):
        below, rows = row[f"b{i}"], row[f"r{i}"]
        if below <= rank < below + rows:
            found[name, rank] = _Range(name, ends[i][0], ends[i][1], below, rows)
    return found


def _far_apart(s: dict) -> bool:
    """Whether the range says little about where the values lie."""
    std = s.get("std")
    if not std:
        return False
    # Powers of values beyond 1e154 have no finite sum.
    return not math.isfinite(std) or (s["max"] / 2 - s["min"] / 2) / std > WIDE_RANGE / 2


def values_at_ranks(
    df: DataFrame, ranks: dict[str, list[int]], stats: dict
) -> dict[tuple[str, int], float]:
    """Order statistics (0-based ranks) of columns whose moments are in ``stats``."""
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], _Range] = {}
    for name, wanted in ranks.items():
        s = stats[name]
        for k in wanted:
            open_[(name, k)] = _Range(name, s["min"], s["max"], 0, s["count"])
    far = [k for k, r in open_.items() if r.rows > READ_OUT_ROWS and _far_apart(stats[k[0]])]
    if far:
        open_.update(_bracketed(df, far, stats))
    while True:
        for key, r in list(open_.items()):
            if r.low == r.high:
                found[key] = r.low
                del open_[key]
        wide = {k: r for k, r in open_.items() if r.rows > READ_OUT_ROWS}
        if not wide:
            break
        bins = _narrow(df, list(dict.fromkeys(wide.values())))
        stuck = []
        for key, r in wide.items():
            open_[key] = _locate(r, bins[r], key[1])
            # All of a range in one bin, and not for being one value.
            if key not in far and open_[key].rows > r.rows / 2 and open_[key].low < open_[key].high:
                stuck.append(key)
        if stuck:
            far += stuck
            open_.update(_bracketed(df, stuck, stats))
    if open_:
        found.update(_read_out(df, open_))
    return found


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    stats: dict | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of each column; None where a column has no values."""
    data = clean(df, columns)
    if stats is None:
        stats = basic_stats(data, columns)
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    filled = [c for c in columns if stats[c]["count"] > 0]
    for start in range(0, len(filled), COLUMNS_PER_PASS):
        chunk = filled[start : start + COLUMNS_PER_PASS]
        places = {c: [(stats[c]["count"] - 1) * float(p) for p in probabilities] for c in chunk}
        ranks = {
            c: sorted({f(v) for v in places[c] for f in (math.floor, math.ceil)}) for c in chunk
        }
        values = values_at_ranks(data, ranks, stats)
        for c in chunk:
            for i, place in enumerate(places[c]):
                low, high = values[(c, math.floor(place))], values[(c, math.ceil(place))]
                part = place - math.floor(place)
                out[c][i] = low if low == high else low * (1 - part) + high * part
    return out


def exact_medians(df: DataFrame, columns: list[str], stats: dict | None = None) -> dict:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], stats).items()}
