"""Descriptive statistics, missing values, histograms and density curves."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import col, position_in, share, skew_label
from tabscope.plans.counts import top_by_count, value_counts
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.moments import basic_stats, collect_moments, numeric_moments
from tabscope.plans.quantiles import exact_quantiles
from tabscope.plans.local import local_table

BINS = 30
PEAK_SIGMAS = 3.0
PEAK_MASS = 0.01
ZERO_SHARE_PCT = 40.0
KDE_ORDER = 12
KDE_REACH = 9.0

_QUARTILES = [0.25, 0.5, 0.75]
_DESCRIBE = (
    "position int, column string, n_rows long, count long, mean double, std double, min double, "
    "q25 double, median double, q75 double, max double, skewness double, kurtosis double, "
    "zeros long, all_integer boolean"
)


def describe_numeric(
    df: DataFrame, columns: list[str] | None = None, stats: dict | None = None
) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max, G1, G2, zeros.

    The moments come from two aggregations; the quartiles from passes that use their result.
    What reaches the driver is one row per column.
    """
    names = infer_kinds(df).numeric if columns is None else list(columns)
    stats = stats or collect_moments(df, names)
    quartiles = exact_quantiles(df, names, _QUARTILES, stats) if names else {}
    rows = []
    for c in names:
        s, (q1, q2, q3) = stats[c], quartiles[c]
        rows.append(
            (
                s["position"],
                c,
                s["n_rows"],
                s["count"],
                s["mean"],
                s["std"],
                s["min"],
                q1,
                q2,
                q3,
                s["max"],
                s["skewness"],
                s["kurtosis"],
                s["zeros"],
                s["all_integer"],
            )
        )
    return local_table(df.sparkSession, rows, _DESCRIBE)


def adjusted_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sample skewness G1 and excess kurtosis G2 per numeric column."""
    return numeric_moments(df, columns).select("column", "count", "skewness", "kurtosis")


def describe_categorical(
    df: DataFrame, columns: list[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per categorical column with values: count, unique, top, freq (ties: smallest)."""
    counts = counts if counts is not None else value_counts(df, columns)
    totals = counts.groupBy("column").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique")
    )
    first = top_by_count(counts, 1, "column").select(
        "column", F.col("value").alias("top"), F.col("count").alias("freq")
    )
    return totals.join(first, "column")


def missing_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: n_rows, missing, missing_share and missing_pct (2 dp)."""
    names = columns or df.columns
    row = (
        clean(df, names)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(col(c)).alias(f"present{i}") for i, c in enumerate(names)],
        )
        .first()
    )
    present = {c: row[f"present{i}"] for i, c in enumerate(names)}
    return missing_from_counts(df.sparkSession, row["n"], present)


def missing_from_counts(spark, n_rows: int, present: dict[str, int]) -> DataFrame:
    """``missing_analysis`` from counts that are already known."""
    rate = F.coalesce(share(F.col("missing"), F.col("n_rows")), F.lit(0.0))
    rows = [(i, c, n_rows, n_rows - n) for i, (c, n) in enumerate(present.items(), start=1)]
    out = local_table(spark, rows, "position int, column string, n_rows long, missing long")
    return out.withColumn("missing_share", rate).withColumn("missing_pct", F.round(rate * 100, 2))


def total_from_missing(missing: DataFrame) -> DataFrame:
    rate = F.coalesce(share(F.col("missing"), F.col("cells")), F.lit(0.0))
    return (
        missing.agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("cells"),
            F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        )
        .withColumn("missing_share", rate)
        .withColumn("total_pct", F.round(rate * 100, 2))
    )


def missing_total(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells and their share and percentage (2 dp, 0 when empty)."""
    return total_from_missing(missing_analysis(df))


def spread_metrics(described: DataFrame) -> DataFrame:
    """IQR, coefficient of variation and Tukey fences from ``describe_numeric``."""
    iqr = F.col("q75") - F.col("q25")
    return described.select(
        "position",
        "column",
        "count",
        iqr.alias("iqr"),
        F.coalesce(F.abs(F.try_divide("std", "mean")), F.lit(0.0)).alias("cv"),
        (F.col("q25") - 1.5 * iqr).alias("lower_fence"),
        (F.col("q75") + 1.5 * iqr).alias("upper_fence"),
        "min",
        "max",
    )


def skew_labels(described: DataFrame) -> DataFrame:
    """Shape label per numeric column from ``describe_numeric``."""
    return described.select(
        "column",
        "skewness",
        skew_label(F.col("skewness"), F.col("mean"), F.col("median")).alias("skew_direction"),
    )


def distribution_diagnostics(
    described: DataFrame,
    categorical: DataFrame | None = None,
    flags: DataFrame | None = None,
    target: str | None = None,
) -> DataFrame:
    """(diagnostic, column, value): high CV, no spread, beyond fences, unreliable fences, binary.

    ``described`` is ``describe_numeric``'s result, ``categorical`` ``describe_categorical``'s and
    ``flags`` the quality flags, which tell columns whose fences are unreliable.
    """
    spread = spread_metrics(described)
    other = F.col("column") != F.lit(target) if target is not None else F.lit(True)
    high_cv = spread.filter((F.col("cv") > 1.0) & other).select(
        F.lit("high_cv").alias("diagnostic"), "column", F.col("cv").alias("value")
    )
    flat = spread.filter((F.col("iqr") == 0) & other).select(
        F.lit("zero_iqr").alias("diagnostic"), "column", F.col("iqr").alias("value")
    )
    beyond = spread.filter(
        (F.col("iqr") != 0)
        & ((F.col("min") < F.col("lower_fence")) | (F.col("max") > F.col("upper_fence")))
    )
    reach = F.greatest(F.col("lower_fence") - F.col("min"), F.col("max") - F.col("upper_fence"))
    if flags is None:
        split = beyond.withColumn("diagnostic", F.lit("beyond_fences"))
    else:
        doubtful = flags.filter(
            (F.col("rule") == "outliers_iqr") & (F.col("severity") == "LOW")
        ).select("column", F.lit(True).alias("doubtful"))
        split = beyond.join(doubtful, "column", "left").withColumn(
            "diagnostic",
            F.when(F.col("doubtful"), "fences_unreliable").otherwise("beyond_fences"),
        )
    out = high_cv.unionByName(flat).unionByName(
        split.select("diagnostic", "column", reach.alias("value"))
    )
    if categorical is not None:
        binary = categorical.filter(F.col("unique") <= 2).select(
            F.lit("binary_categorical").alias("diagnostic"),
            "column",
            F.col("unique").cast("double").alias("value"),
        )
        out = out.unionByName(binary)
    return out


def _bin_edges(low: float, high: float, bins: int) -> tuple[float, float, float]:
    """Range and bin width; a constant column gets one unit around its value."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return low, high, (high - low) / bins


def _bins_of(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """(pos, bin) of every value: lower edges included, last bin closed.

    The quotient may be off by one next to an edge, so it is checked against the edges.
    """
    guesses, checked = [], []
    for i, (c, (low, high)) in enumerate(ranges.items()):
        low, high, width = _bin_edges(low, high, bins)
        x = col(c).cast("double")
        part = F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)))
        guesses += [
            x.alias(f"x{i}"),
            F.when(x.isNotNull(), F.least(part, F.lit(bins - 1)).cast("int")).alias(f"g{i}"),
        ]
        x, g = F.col(f"x{i}"), F.col(f"g{i}")
        lower, upper = F.lit(low) + g * F.lit(width), F.lit(low) + (g + 1) * F.lit(width)
        checked.append(
            F.when((x < lower) & (g > 0), g - 1)
            .when((x >= upper) & (g < bins - 1), g + 1)
            .otherwise(g)
        )
    data = clean(df, list(ranges)).select(*guesses)
    return data.select(F.posexplode(F.array(*checked)).alias("pos", "bin")).filter("bin IS NOT NULL")


def histogram(
    df: DataFrame,
    columns: list[str] | None = None,
    bins: int = BINS,
    stats: dict | None = None,
) -> DataFrame:
    """(column, bin, low, high, count) with ``bins`` equal-width bins per column, empty ones kept."""
    names = infer_kinds(df).numeric if columns is None else list(columns)
    schema = "column string, bin int, low double, high double, count long"
    stats = stats or basic_stats(df, names)
    names = [c for c in names if stats[c]["count"] > 0]
    if not names:
        return local_table(df.sparkSession, [], schema)
    ranges = {c: (stats[c]["min"], stats[c]["max"]) for c in names}
    counted = _bins_of(df, ranges, bins).groupBy("pos", "bin").agg(F.count(F.lit(1)).alias("count"))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("pos") + 1)
    counted = counted.select(label.alias("column"), "bin", "count")
    # One row per column and bin: the frame that keeps empty bins.
    frame = []
    for c in names:
        low, high, width = _bin_edges(stats[c]["min"], stats[c]["max"], bins)
        for b in range(bins):
            frame.append((c, b, low + b * width, high if b == bins - 1 else low + (b + 1) * width))
    edges = local_table(
        df.sparkSession,
        frame, "column string, bin int, low double, high double"
    )
    return edges.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count")
    )


def _with_peaks(bins: DataFrame) -> DataFrame:
    order = Window.partitionBy("column").orderBy("bin")
    whole = Window.partitionBy("column")
    # Outside the histogram there is nothing to compare with: an edge has one neighbour.
    neighbour = F.greatest(F.lag("count").over(order), F.lead("count").over(order))
    total = F.sum("count").over(whole)
    per_bin = total / F.count(F.lit(1)).over(whole)
    floor = F.greatest(F.sqrt(per_bin) * PEAK_SIGMAS, total * PEAK_MASS, F.lit(1.0))
    stands_out = (F.col("prominence") > 0) & (F.col("prominence") >= F.col("threshold"))
    return (
        bins.withColumn("prominence", F.col("count") - neighbour)
        .withColumn("threshold", floor)
        .withColumn("is_peak", F.coalesce(stands_out, F.lit(False)))
    )


def histogram_peaks(bins: DataFrame) -> DataFrame:
    """Peaks of ``histogram``: bins that stand out from both neighbours beyond counting noise."""
    return _with_peaks(bins).filter("is_peak").drop("is_peak")


def modality(bins: DataFrame) -> DataFrame:
    """(column, peaks, modality) from ``histogram``."""
    n = F.col("peaks")
    return (
        _with_peaks(bins)
        .groupBy("column")
        .agg(F.count_if("is_peak").alias("peaks"))
        .withColumn(
            "modality",
            F.when(n <= 1, "unimodal").otherwise(F.concat(n.cast("string"), F.lit("-modal"))),
        )
    )


def histogram_gaps(bins: DataFrame) -> DataFrame:
    return bins.filter(F.col("count") == 0).select("column", "bin", "low", "high")


def zero_inflation(
    df: DataFrame, columns: list[str] | None = None, target: str | None = None,
    min_pct: float = ZERO_SHARE_PCT,
) -> DataFrame:
    """Columns with many exact zeros; a two-valued target counts as class imbalance instead."""
    names = infer_kinds(df).numeric if columns is None else list(columns)
    stats = basic_stats(df, names)
    rows = []
    for c, s in stats.items():
        if s["count"] and s["zeros"] / s["count"] * 100 >= min_pct:
            label = "zero_inflation"
            if c == target:
                x = col(c).cast("double")
                between = clean(df, [c]).filter((x != s["min"]) & (x != s["max"]))
                label = "class_imbalance" if between.isEmpty() else label
            rows.append((c, s["zeros"], s["count"] - s["zeros"], s["zeros"] / s["count"] * 100, label))
    return local_table(
        df.sparkSession,
        rows,
        "column string, zero_count long, nonzero_count long, zero_pct double, label string",
    )


def _hermite_powers(order: int) -> list[list[int]]:
    """Coefficients of t^0, t^1, ... of the polynomials that the Gaussian's derivatives have, up to an order."""
    rows = [[1], [0, 1]]
    for k in range(1, order):
        shifted = [0, *rows[k]]
        lower = [*rows[k - 1], 0, 0]
        rows.append([a - k * b for a, b in zip(shifted, lower)])
    return rows[: order + 1]


def kde_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """(point, x, density): Gaussian kernel density with Scott's bandwidth on an even grid.

    A kernel around a value is a series around the middle of the value's cell of half a bandwidth: a value that
    lies u bandwidths beside it adds u^k / k! to the k-th of a few sums of its cell, and those give the cell's
    share at every grid point. With ``KDE_ORDER`` terms and u of at most a quarter, what is left out is below
    1.1 sum over k > 12 of (1/4)^k / sqrt(k!) < 3e-13 of a kernel's height; cells more than ``KDE_REACH`` bandwidths away, below 3e-18. So the table
    is read once into sums by cell, whatever the number of grid points, and only cells meet grid points.
    """
    s = collect_moments(df, [column])[column]
    schema = "point int, x double, density double"
    n, std = s["count"], s["std"]
    if n < 2 or not std:
        return local_table(df.sparkSession, [], schema)
    width = std * n ** (-1.0 / 5.0)
    step = (s["max"] - s["min"]) / (points - 1)
    at = (col(column).cast("double") - F.lit(s["min"])) / F.lit(width)
    values = clean(df, [column]).select(at.alias("z")).filter("z IS NOT NULL")
    values = values.withColumn("cell", F.floor(F.col("z") * 2))
    values = values.withColumn("u", F.col("z") - (F.col("cell") + 0.5) / 2)
    sums, power = [F.count("*").cast("double").alias("m0")], F.col("u")
    for k in range(1, KDE_ORDER + 1):
        sums.append((F.sum(power) / F.lit(float(math.factorial(k)))).alias(f"m{k}"))
        power = power * F.col("u")
    cells = values.groupBy("cell").agg(*sums).withColumn("middle", (F.col("cell") + 0.5) / 2)
    # Grid points lie ``apart`` bandwidths from each other.
    apart = F.lit(step / width)
    first = F.greatest(F.ceil((F.col("middle") - KDE_REACH) / apart), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("middle") + KDE_REACH) / apart), F.lit(points - 1)).cast("int")
    near = F.when(first <= last, F.sequence(first, last))
    met = cells.withColumn("point", F.explode(near)).withColumn("t", F.col("point") * apart - F.col("middle"))
    # The polynomials in t, each times the cell's sum, by powers of t.
    by_power = [
        reduce(add, [F.col(f"m{k}") * F.lit(float(row[j])) for k, row in enumerate(_hermite_powers(KDE_ORDER)) if j < len(row) and row[j]])
        for j in range(KDE_ORDER + 1)
    ]
    series = reduce(lambda total, term: total * F.col("t") + term, reversed(by_power))
    weight = F.sum(F.exp(-F.col("t") * F.col("t") / 2) * series)
    weights = met.groupBy("point").agg(weight.alias("weight"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    density = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) / F.lit(n * width * math.sqrt(2 * math.pi))
    return grid.join(weights, "point", "left").select(
        "point", (F.lit(s["min"]) + F.col("point") * F.lit(step)).alias("x"), density.alias("density")
    )


def order_of(df: DataFrame, column: Column) -> Column:
    """Place of a column name in the table, for ties that follow column order."""
    return position_in(df.columns, column)
