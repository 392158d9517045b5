"""Interaction signals: target rates over families of numbered columns and over segments."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.operators.target import Target, binarise_target
from tabscope.plans.kinds import infer_kinds, normalise
from tabscope.plans.quantiles import exact_medians, exact_quantiles
from tabscope.plans.local import local_table

# Fixed value: what counts as a numbered column.
FAMILY_PATTERN = r"^([a-zA-Z_]+?)_?(\d+)$"
MIN_FAMILY = 3
MIN_GROUP = 10
MIN_QUINTILE = 5
MIN_SPREAD_PP = 5.0

SIGNALS = (
    "type string, subject string, columns array<string>, group string, group_no int, count long, "
    "rate_pct double, positives double, spread_pp double, overall_rate_pct double, "
    "top_share_pct double"
)


def column_families(columns: list[str]) -> dict[str, list[str]]:
    """Columns that share a name and differ in a number, in number order; families by name."""
    named = (re.fullmatch(FAMILY_PATTERN, c) for c in columns)
    # Of names with one number ("q1", "q01"), the shorter comes first.
    rows = sorted((m[1], int(m[2]), len(m[0]), m[0]) for m in named if m)
    stems = Counter(stem for stem, *_ in rows)
    return {
        stem: [name for *_, name in own]
        for stem, own in groupby(rows, key=itemgetter(0))
        if stems[stem] >= MIN_FAMILY
    }


def family_table(df: DataFrame, target: str | None = None) -> DataFrame:
    families = column_families([c for c in infer_kinds(df).numeric if c != target])
    return local_table(
        df.sparkSession,
        [(name, i, c) for name, cols in families.items() for i, c in enumerate(cols)],
        "family string, member int, column string",
    )


def _above(name: str, medians: dict) -> Column:
    """Value above the column's median; a missing value is not."""
    median = medians[name]
    if median is None:
        return F.lit(False)
    return F.coalesce(col(name) > F.lit(median), F.lit(False))


def _entry(kind: str, subject: str, columns: list[str], number: Column, label: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(subject).alias("subject"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        number.cast("int").alias("group_no"),
        label.cast("string").alias("group"),
    )


def _persistence(name: str, members: list[str], medians: dict) -> Column:
    level = reduce(lambda a, b: a + b, [_above(c, medians).cast("int") for c in members])
    return _entry("persistence_gradient", name, members, level, level)


def _trajectory(name: str, members: list[str], medians: dict) -> Column:
    first, last = _above(members[0], medians), _above(members[-1], medians)
    number = F.when(~first & ~last, 0).when(~first & last, 1).when(first & ~last, 2).otherwise(3)
    names = ["stable_low", "deteriorating", "improving", "stable_high"]
    label = F.element_at(F.array(*[F.lit(v) for v in names]), number + 1)
    return _entry("trajectory", name, [members[0], members[-1]], number, label)


def _segments(first: str, second: str, medians: dict) -> Column:
    def side(c):
        return F.coalesce(col(c) >= F.lit(medians[c]), F.lit(False))

    number = side(first).cast("int") * 2 + side(second).cast("int")
    names = [f"{first}_{a}_{second}_{b}" for a in ("lo", "hi") for b in ("lo", "hi")]
    label = F.element_at(F.array(*[F.lit(v) for v in names]), number + 1)
    return _entry("cross_feature_segments", f"{first} x {second}", [first, second], number, label)


def _quintile(name: str, edges: list[float]) -> Column:
    """Right-closed bins between the edges, the lowest value included."""
    x = col(name).cast("double")
    below = reduce(lambda a, b: a + b, [(x > F.lit(e)).cast("int") for e in edges])
    number = F.greatest(below, F.lit(1))
    label = F.concat(F.lit("Q"), number.cast("string"))
    return F.when(
        x.isNotNull(), _entry("portfolio_concentration", name, [name], number, label)
    )


def _group_rates(df: DataFrame, target: Target, entries: list[Column]) -> DataFrame:
    """Rates of all signals from one explode and one shuffle of at most a few groups each."""
    if not entries:
        return local_table(df.sparkSession, [], SIGNALS)
    data = binarise_target(df, target, "__positive")
    total = data.agg(F.avg("__positive").alias("rate"), F.sum("__positive").alias("sum")).first()
    groups = (
        data.select("__positive", F.explode(F.array(*entries)).alias("e"))
        .filter("e IS NOT NULL")
        .groupBy("e.type", "e.subject", "e.columns", "e.group", "e.group_no")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg("__positive") * 100, 1).alias("rate_pct"),
            F.sum("__positive").alias("positives"),
        )
    )
    concentration = F.col("type") == "portfolio_concentration"
    enough = F.when(concentration, MIN_QUINTILE).otherwise(MIN_GROUP)
    # A signal has a handful of groups, so these windows are tiny.
    signal = Window.partitionBy("type", "subject")
    by_rate = signal.orderBy(F.desc("rate_pct"), "group_no")
    top = F.first("positives").over(by_rate.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    overall = None if total["rate"] is None else float(total["rate"]) * 100
    whole = max(float(total["sum"] or 0.0), 1.0)
    return (
        groups.filter(F.col("count") >= enough)
        .withColumn("groups", F.count(F.lit(1)).over(signal))
        .withColumn("spread", F.max("rate_pct").over(signal) - F.min("rate_pct").over(signal))
        .withColumn("top_share_pct", F.when(concentration, F.round(top / F.lit(whole) * 100, 1)))
        .filter((F.col("groups") >= 2) & (F.col("spread") >= MIN_SPREAD_PP))
        .select(
            "type",
            "subject",
            "columns",
            "group",
            "group_no",
            "count",
            "rate_pct",
            "positives",
            F.round("spread", 1).alias("spread_pp"),
            F.round(F.lit(overall), 1).alias("overall_rate_pct"),
            "top_share_pct",
        )
    )


def _families(df: DataFrame, target: Target) -> tuple[dict, dict]:
    families = column_families([c for c in infer_kinds(df).numeric if c != target.column])
    members = list(dict.fromkeys(c for cols in families.values() for c in cols))
    return families, exact_medians(df, members) if members else {}


def persistence_gradient(df: DataFrame, target: Target) -> DataFrame:
    """Target rate by how many columns of a family are above their own median."""
    df = normalise(df)
    families, medians = _families(df, target)
    return _group_rates(df, target, [_persistence(n, m, medians) for n, m in families.items()])


def trajectory(df: DataFrame, target: Target) -> DataFrame:
    """Target rate by the move from the first to the last column of a family."""
    df = normalise(df)
    families, medians = _families(df, target)
    return _group_rates(df, target, [_trajectory(n, m, medians) for n, m in families.items()])


def cross_feature_segments(df: DataFrame, target: Target, first: str, second: str) -> DataFrame:
    """Target rate in the four halves of two numeric features."""
    df = normalise(df)
    medians = exact_medians(df, [first, second])
    if None in medians.values():
        return _group_rates(df, target, [])
    return _group_rates(df, target, [_segments(first, second, medians)])


def quintile_concentration(df: DataFrame, target: Target, feature: str) -> DataFrame:
    """Target rate by quintile of a feature and the share of positives in the highest one."""
    df = normalise(df)
    return _group_rates(df, target, _quintile_entries(df, feature))


def _quintile_entries(df: DataFrame, feature: str) -> list[Column]:
    edges = exact_quantiles(df, [feature], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])[feature]
    distinct = sorted({e for e in edges if e is not None})
    return [_quintile(feature, distinct)] if len(distinct) >= 2 else []


def interaction_signals(
    df: DataFrame, target: Target, associations: DataFrame | None = None
) -> DataFrame:
    """All signals that reach the spread, one row per group; empty without a target.

    ``associations`` (``feature_associations``) names the features for segments and quintiles.
    """
    if target.column is None or target.problem_type == "unsupervised":
        return local_table(df.sparkSession, [], SIGNALS)
    df = normalise(df)
    families, medians = _families(df, target)
    entries = []
    for name, members in families.items():
        entries += [_persistence(name, members, medians), _trajectory(name, members, medians)]
    if associations is not None:
        best = associations.filter("feature_type = 'numerical'").orderBy("place").limit(2)
        top = [r["feature"] for r in best.select("feature").collect() if r["feature"] in df.columns]
        if len(top) == 2:
            halves = exact_medians(df, top)
            if None not in halves.values():
                entries.append(_segments(top[0], top[1], halves))
        if top:
            entries += _quintile_entries(df, top[0])
    return _group_rates(df, target, entries)
