"""The shared value-count table: (column, value, count) for many columns in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.local import local_table


def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep..., column, value) with values as text; rows of NULL values are left out."""
    data = clean(df, list(dict.fromkeys([*keep, *columns])))
    # The kept columns travel under their own names, so a column can be both kept and unpivoted.
    data = data.select(
        *[col(k).alias(f"keep_{i}") for i, k in enumerate(keep)],
        *[col(c).cast("string").alias(c) for c in columns],
    )
    ids = [F.col(f"keep_{i}") for i in range(len(keep))]
    out = data.unpivot(ids, [col(c) for c in columns], "column", "value")
    out = out.filter(F.col("value").isNotNull())
    return out.select(
        *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], "column", "value"
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count). Partial counts are formed before the shuffle, so a hot value is
    one row per task; the shuffle key is (column, value), so no column lands in one task."""
    names = infer_kinds(df).categorical if columns is None else list(columns)
    if not names:
        return local_table(df.sparkSession, [], "column string, value string, count long")
    return long_form(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_by_count(counts: DataFrame, n: int, *group: str) -> DataFrame:
    """The n most frequent rows per group, ties by value; adds ``rank``.

    Spark limits each partition to n rows per group before the shuffle (window group limit),
    so a column of unique values never meets in one task.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*group).orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def entropy_bits() -> Column:
    """Shannon entropy of counts, in one aggregate: log2(N) - sum(c*log2 c)/N."""
    c = F.col("count").cast("double")
    total = F.sum(c)
    return F.greatest(F.log2(total) - F.sum(c * F.log2(c)) / total, F.lit(0.0))
