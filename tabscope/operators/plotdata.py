"""The numbers behind each plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators import associate, categorical, correlate, describe, target_analysis
from tabscope.operators.target import Target
from tabscope.plans.kinds import infer_kinds

KINDS = [
    "histogram",
    "correlation",
    "missing",
    "target",
    "categorical",
    "ordinal",
    "associations",
]


def plot_data(
    df: DataFrame,
    kind: str,
    target: Target | None = None,
    encoded: list[str] | tuple[str, ...] = (),
    associations: DataFrame | None = None,
) -> DataFrame:
    """One table per plot kind; see ``KINDS``."""
    if kind == "histogram":
        return describe.histogram(df)
    if kind == "correlation":
        return correlate.correlation_matrix(df)
    if kind == "missing":
        return missing_bars(df)
    if kind == "target":
        return target_bars(df, target)
    if kind == "categorical":
        return categorical.top_values(df, infer_kinds(df, encoded).categorical)
    if kind == "ordinal":
        return correlate.ordinal_spearman(df, list(encoded))
    if kind == "associations":
        rows = associations if associations is not None else associate.feature_associations(df, target)
        return rows.select("place", "feature", "mi_score", "effect_size", "effect_size_type")
    raise ValueError(f"unknown plot kind: {kind}")


def missing_bars(df: DataFrame) -> DataFrame:
    """Bar heights: missing percentage per column, worst first."""
    return (
        describe.missing_analysis(df)
        .select("position", "column", "missing_pct")
        .orderBy(F.desc("missing_pct"), "position")
    )


def target_bars(df: DataFrame, target: Target) -> DataFrame:
    """Class bars, or histogram and density of a numeric target, as (series, label, x, y)."""
    if target.problem_type == "classification":
        return target_analysis.class_distribution(df, target.column).select(
            F.lit("class").alias("series"),
            F.col("class").alias("label"),
            F.lit(None).cast("double").alias("x"),
            F.col("count").cast("double").alias("y"),
        )
    bars = describe.histogram(df, [target.column]).select(
        F.lit("histogram").alias("series"),
        F.col("bin").cast("string").alias("label"),
        F.col("low").alias("x"),
        F.col("count").cast("double").alias("y"),
    )
    curve = describe.kde_curve(df, target.column).select(
        F.lit("density").alias("series"),
        F.col("point").cast("string").alias("label"),
        "x",
        F.col("density").alias("y"),
    )
    return bars.unionByName(curve)
