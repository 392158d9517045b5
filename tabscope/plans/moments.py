"""Per-column numbers except quantiles, in two light aggregations.

The first takes counts, mean and range; the second sums the powers of the distance to that mean. Plain sums keep the generated code small and fast (a wide
aggregate of Spark's own skewness and kurtosis is several times slower), and centred powers do
not lose digits. Only one row per column reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.local import local_table

# Columns per aggregation; a wider table is split so that generated code stays small.
COLUMNS_PER_PASS = 16

MOMENTS = (
    "position int, column string, n_rows long, count long, mean double, std double, min double, "
    "max double, skewness double, kurtosis double, zeros long, all_integer boolean"
)


def _chunks(names: list[str]):
    for start in range(0, len(names), COLUMNS_PER_PASS):
        yield names[start : start + COLUMNS_PER_PASS]


def basic_stats(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """count, mean, min, max, zeros and whether all values are whole, per numeric column."""
    names = infer_kinds(df).numeric if columns is None else list(columns)
    place = {c: i for i, c in enumerate(df.columns, start=1)}
    out = {}
    for chunk in _chunks(names):
        aggregates = [F.count(F.lit(1)).alias("n_rows")]
        for i, c in enumerate(chunk):
            x = col(c).cast("double")
            aggregates += [
                F.count(x).alias(f"count{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
                F.count(F.when(x == 0, 1)).alias(f"zeros{i}"),
                F.bool_and(x == F.floor(x)).alias(f"whole{i}"),
            ]
        row = clean(df, chunk).agg(*aggregates).first()
        for i, c in enumerate(chunk):
            out[c] = {k: row[f"{k}{i}"] for k in ("count", "mean", "min", "max", "zeros")}
            out[c] |= {"column": c, "position": place[c], "n_rows": row["n_rows"]}
            out[c]["all_integer"] = bool(row[f"whole{i}"])
    return out


def _shape(s: dict, s2: float | None, s3: float | None, s4: float | None) -> dict:
    """std, G1 and G2 from sums of centred powers; a constant column has exactly none of them."""
    n = s["count"]
    constant = n > 0 and s["min"] == s["max"]
    std = None if n < 2 else 0.0 if constant else math.sqrt(s2 / (n - 1))
    skewness = kurtosis = None
    if n >= 3:
        skewness = 0.0 if constant else (s3 / n) / (s2 / n) ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    if n >= 4:
        excess = 0.0 if constant else s4 * n / (s2 * s2) - 3
        kurtosis = 0.0 if constant else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6)
    return {"std": std, "skewness": skewness, "kurtosis": kurtosis}


def collect_moments(
    df: DataFrame, columns: list[str] | None = None, stats: dict | None = None
) -> dict[str, dict]:
    """``basic_stats`` plus std, G1 and G2."""
    names = infer_kinds(df).numeric if columns is None else list(columns)
    stats = stats or basic_stats(df, names)
    out = {}
    for chunk in _chunks(names):
        aggregates = []
        for i, c in enumerate(chunk):
            x = col(c).cast("double")
            d = x - F.lit(stats[c]["mean"] if stats[c]["mean"] is not None else 0.0)
            aggregates += [
                F.sum(d * d).alias(f"s2_{i}"),
                F.sum(d * d * d).alias(f"s3_{i}"),
                F.sum(d * d * d * d).alias(f"s4_{i}"),
            ]
        row = clean(df, chunk).agg(*aggregates).first()
        for i, c in enumerate(chunk):
            shape = _shape(stats[c], row[f"s2_{i}"], row[f"s3_{i}"], row[f"s4_{i}"])
            out[c] = stats[c] | shape
    return out


def numeric_moments(
    df: DataFrame, columns: list[str] | None = None, stats: dict | None = None
) -> DataFrame:
    """``collect_moments`` as a table, one row per numeric column."""
    stats = stats or collect_moments(df, columns)
    keys = [part.split()[0] for part in MOMENTS.split(", ")]
    rows = [tuple(s[k] for k in keys) for s in stats.values()]
    return local_table(df.sparkSession, rows, MOMENTS)
