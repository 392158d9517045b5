"""How the target is distributed and how features differ between its classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import col, imbalance_band, position_in, share
from tabscope.operators.describe import describe_numeric
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.local import local_table
from tabscope.plans.scratch import materialise
from tabscope.plans.widest import widest_pairs

FEATURES_PER_PASS = 24


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, count, pct): the percentage counts rows without target in the denominator."""
    total = df.agg(F.count(F.lit(1))).first()[0]
    return (
        clean(df, [target])
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
        .filter("class IS NOT NULL")
        .withColumn("pct", F.round(F.col("count") * 100.0 / F.lit(total), 2))
    )


def per_class_feature_stats(
    df: DataFrame, target: str, columns: list[str] | None = None
) -> DataFrame:
    """(class, feature, n, mean, std) with 4 dp. The table is reduced to one wide row per class
    inside each task before it is shuffled or turned long."""
    names = [c for c in (columns or infer_kinds(df).numeric) if c != target]
    schema = "class string, feature string, n long, mean double, std double"
    if not names:
        return local_table(df.sparkSession, [], schema)
    out = None
    for start in range(0, len(names), FEATURES_PER_PASS):
        chunk = names[start : start + FEATURES_PER_PASS]
        wide = (
            clean(df, [target, *chunk])
            .filter(col(target).isNotNull())
            .groupBy(col(target).cast("string").alias("class"))
            .agg(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.count(col(c)).alias("n"),
                        F.round(F.avg(col(c).cast("double")), 4).alias("mean"),
                        F.round(F.stddev_samp(col(c).cast("double")), 4).alias("std"),
                    ).alias(f"s{i}")
                    for i, c in enumerate(chunk)
                ]
            )
        )
        entries = F.array(*[F.col(f"s{i}") for i in range(len(chunk))])
        part = wide.select("class", F.explode(entries).alias("s")).select("class", "s.*")
        out = part if out is None else out.unionByName(part)
    return out


def regression_target_stats(df: DataFrame, target: str) -> DataFrame:
    """One row with 4 dp: mean, median, std, skewness, kurtosis, min, max."""
    keys = ["mean", "median", "std", "skewness", "kurtosis", "min", "max"]
    return describe_numeric(df, [target]).select(
        "column", *[F.round(k, 4).alias(k) for k in keys]
    )


def cohens_d_ranking(stats: DataFrame, order: list[str], top: int = 10) -> DataFrame:
    """(place, feature, cohens_d): largest distance between two classes, from
    ``per_class_feature_stats``.

    The widest pair is found by branch and bound over cells of classes (``plans.widest``), whatever their
    number and however spread and mean go together.
    """
    stats = materialise(stats.select("feature", "mean", "std"), "class-stats")
    widest = widest_pairs(stats)
    features = stats.select("feature").distinct()
    # One row per feature of the schema.
    best = Window.orderBy(F.desc("cohens_d"), position_in(order, F.col("feature")))
    return (
        features.join(widest, "feature", "left")
        .select("feature", F.coalesce("d", F.lit(0.0)).alias("cohens_d"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= top)
    )


def imbalance(distribution: DataFrame) -> DataFrame:
    """One row from ``class_distribution``: n_classes, imbalance_ratio (2 dp) and its band."""
    ratio = F.coalesce(F.round(share(F.max("count"), F.min("count")), 2), F.lit(1.0))
    return distribution.agg(
        F.count(F.lit(1)).alias("n_classes"), ratio.alias("imbalance_ratio")
    ).withColumn("band", imbalance_band(F.col("imbalance_ratio")))
