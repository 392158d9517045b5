"""Inventories of categorical columns and their target rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import RARE_SHARE, col, position_in, share
from tabscope.plans.counts import entropy_bits, long_form, top_by_count, value_counts
from tabscope.plans.kinds import infer_kinds
from tabscope.plans.local import local_table

TOP_VALUES = 10


def _totals(counts: DataFrame) -> DataFrame:
    """One row per column of the schema, hence safe to broadcast. The value counts behind it
    and behind its user are shuffled once: Spark reuses the exchange."""
    return F.broadcast(counts.groupBy("column").agg(F.sum("count").alias("total")))


def top_values(
    df: DataFrame,
    columns: list[str] | None = None,
    n: int = TOP_VALUES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(column, rank, value, count, pct, is_rare): the n most frequent values per column."""
    counts = counts if counts is not None else value_counts(df, columns)
    part = share(F.col("count"), F.col("total"))
    return (
        top_by_count(counts, n, "column")
        .join(_totals(counts), "column")
        .select(
            "column",
            "rank",
            "value",
            "count",
            F.round(part * 100, 2).alias("pct"),
            (part < RARE_SHARE).alias("is_rare"),
        )
    )


def summary_from_counts(counts: DataFrame, columns: list[str], n: int = TOP_VALUES) -> DataFrame:
    """``categorical_summary`` from an existing value-count table."""
    spark = counts.sparkSession
    names = local_table(
        spark,
        [(i, c) for i, c in enumerate(columns, start=1)], "position int, column string"
    )
    shape = counts.groupBy("column").agg(
        F.sum("count").alias("count"),
        F.count(F.lit(1)).alias("cardinality"),
        entropy_bits().alias("entropy_bits"),
    )
    # A value is rare below half a percent of the column's total, known once it is summed.
    rare = (
        counts.join(_totals(counts), "column")
        .groupBy("column")
        .agg(F.count_if(share(F.col("count"), F.col("total")) < RARE_SHARE).alias("rare_count"))
    )
    zero = F.lit(0).cast("long")
    k = F.coalesce("cardinality", zero)
    return (
        names.join(shape, "column", "left")
        .join(rare, "column", "left")
        .select(
            "position",
            "column",
            F.coalesce("count", zero).alias("count"),
            k.alias("cardinality"),
            F.round(F.coalesce("entropy_bits", F.lit(0.0)), 4).alias("entropy_bits"),
            F.coalesce("rare_count", zero).alias("rare_count"),
            F.greatest(k - n, zero).alias("more_values"),
        )
    )


def categorical_summary(
    df: DataFrame, columns: list[str] | None = None, n: int = TOP_VALUES
) -> DataFrame:
    """One row per categorical column: cardinality, entropy, rare values, values beyond the top."""
    names = infer_kinds(df).categorical if columns is None else list(columns)
    return summary_from_counts(value_counts(df, names), names, n)


def target_rates(
    df: DataFrame,
    target: str,
    columns: list[str] | None = None,
    n: int = TOP_VALUES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(column, rank, value, count, class, class_count, rate): class shares in % inside the top
    values of each column; rows without target are left out of the shares. Only cells of top values
    are shuffled. ``counts`` are the value counts, where they are known."""
    names = infer_kinds(df).categorical if columns is None else list(columns)
    counts = value_counts(df, names) if counts is None else counts.filter(F.col("column").isin(names))
    # n rows per column of the schema, so the broadcast has a proven bound.
    top = F.broadcast(top_by_count(counts, n, "column"))
    cells = (
        long_form(df.withColumn("__class", col(target).cast("string")), names, "__class")
        .filter("__class IS NOT NULL")
        .join(top, ["column", "value"])
        .groupBy("column", "rank", "value", "count", F.col("__class").alias("class"))
        .agg(F.count(F.lit(1)).alias("class_count"))
    )
    inside = Window.partitionBy("column", "value")
    rate = share(F.col("class_count"), F.sum("class_count").over(inside))
    return (
        cells.withColumn("rate", F.round(rate * 100, 2))
        .select("column", "rank", "value", "count", "class", "class_count", "rate")
    )


def rate_reliability(values: DataFrame) -> DataFrame:
    """Margin of error in points for values with fewer than 100 rows (column, value, count)."""
    n = F.col("count")
    margin = F.bround(F.lit(1.96) * F.sqrt(F.lit(0.25) / n) * 100, 0)
    return values.filter((n > 0) & (n < 100)).select(
        "column",
        "value",
        "count",
        margin.alias("margin_pp"),
        F.when(n < 30, "VERY_LOW_N").otherwise("LOW_N").alias("level"),
    )


def anomalous_rates(rates: DataFrame, min_count: int = 50) -> DataFrame:
    """Values whose class rate is over twice or under half the column's, from ``target_rates``."""
    covered = (
        rates.select("column", "value", "count")
        .distinct()
        .groupBy("column")
        .agg(F.sum("count").alias("covered"))
    )
    overall = (
        rates.groupBy("column", "class")
        .agg(F.sum(F.col("rate") * F.col("count")).alias("weighted"))
        .join(covered, "column")
        .select("column", "class", (F.col("weighted") / F.col("covered")).alias("column_rate"))
    )
    r, base = F.col("rate"), F.col("column_rate")
    return (
        rates.filter(F.col("count") >= min_count)
        .join(overall, ["column", "class"])
        .filter((base > 0) & ((r > base * 2) | (r < base * 0.5)))
        .select("column", "value", "class", "count", "rate", "column_rate", (r / base).alias("ratio"))
    )


def discriminative_columns(
    rates: DataFrame, order: list[str], target: str | None = None, top: int = 3
) -> DataFrame:
    """(place, column, first_class, spread): columns whose top values differ most in the rate of
    the class that leads in their most frequent value."""
    used = rates if target is None else rates.filter(F.col("column") != target)
    leader = Window.partitionBy("column").orderBy("rank", F.desc("class_count"), "class")
    first = (
        used.withColumn("n", F.row_number().over(leader))
        .filter("n = 1")
        .select("column", F.col("class").alias("first_class"))
    )
    per_value = (
        used.join(first, "column")
        .groupBy("column", "first_class", "value")
        .agg(F.max(F.when(F.col("class") == F.col("first_class"), F.col("rate"))).alias("rate"))
        .fillna(0.0, subset=["rate"])
    )
    spread = per_value.groupBy("column", "first_class").agg(
        (F.max("rate") - F.min("rate")).alias("spread"), F.max("rate").alias("max_rate")
    )
    # One row per column of the schema.
    best = Window.orderBy(F.desc("spread"), position_in(order, F.col("column")))
    return (
        spread.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= top)
        .select("place", "column", "first_class", "spread", "max_rate")
    )


def discriminative_values(rates: DataFrame, chosen: DataFrame, values: int = 5) -> DataFrame:
    """All class rates of the first values of the chosen columns."""
    return (
        rates.filter(F.col("rank") <= values)
        .join(chosen.select("place", "column"), "column")
        .select("place", "column", "rank", "value", "class", "rate")
    )


def borda_not_in_top_spread(associations: DataFrame, chosen: DataFrame, top: int = 3) -> DataFrame:
    """Categorical features ranked by Borda count that are missing from the widest spreads."""
    return (
        associations.filter(F.col("feature_type") == "categorical")
        .join(chosen.select(F.col("column").alias("feature")), "feature", "left_anti")
        .orderBy("place")
        .limit(top)
        .select("feature", "borda_score")
    )


def cardinality_bands(summary: DataFrame) -> DataFrame:
    """(band, column, value) from ``categorical_summary``."""

    def band(name, condition, value):
        return summary.filter(condition).select(
            F.lit(name).alias("band"), "column", F.col(value).cast("double").alias("value")
        )

    e, p = F.col("entropy_bits"), F.col("position")
    ends = summary.agg(
        F.count(F.lit(1)).alias("columns"),
        F.max_by("column", F.struct(e, -p)).alias("high"),
        F.max("entropy_bits").alias("high_value"),
        F.max_by("column", F.struct(-e, p)).alias("low"),
        F.min("entropy_bits").alias("low_value"),
    ).filter("columns > 1")
    entropy = ends.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("highest_entropy").alias("band"),
                    F.col("high").alias("column"),
                    F.col("high_value").alias("value"),
                ),
                F.struct(
                    F.lit("lowest_entropy").alias("band"),
                    F.col("low").alias("column"),
                    F.col("low_value").alias("value"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    return (
        band("high_cardinality", F.col("cardinality") > 20, "cardinality")
        .unionByName(band("binary", F.col("cardinality") <= 2, "cardinality"))
        .unionByName(band("rare_levels", F.col("rare_count") > 0, "rare_count"))
        .unionByName(entropy)
    )
