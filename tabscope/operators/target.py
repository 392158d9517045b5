"""Finding, classifying and binarising the target column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import col
from tabscope.plans.few import few_values
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.quantiles import exact_medians
from tabscope.plans.local import local_table

# The name lists decide which column is taken as the target.
EXACT_NAMES = ["target", "label", "y", "class", "price", "churn"]
NAME_PARTS = [
    "target", "label", "class", "outcome", "diagnosis", "default", "churn", "response",
]
NAME_PREFIXES = ["is_", "has_"]
DATE_NAME_PARTS = ["date", "time", "timestamp"]

REGRESSION_OVER = 10
FALLBACK_UNDER = 10
PROFILED_VALUES = 30
SAMPLE_VALUES = 15


@dataclass(frozen=True)
class Target:
    """What is known of the target; a handful of numbers, so it lives on the driver."""

    column: str | None
    problem_type: str = "unsupervised"
    n_classes: int = 0
    imbalance_ratio: float = 1.0
    detection_method: str = "none"
    has_datetime_index: bool = False


def has_datetime_column(df: DataFrame) -> bool:
    """A date or timestamp column, or text named like one of which every value parses."""
    if infer_kinds(df).datetime:
        return True
    named = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and any(p in f.name.lower() for p in DATE_NAME_PARTS)
    ]
    if not named:
        return False
    bad = [
        F.count_if(col(c).isNotNull() & F.try_to_timestamp(col(c)).isNull()).alias(f"bad{i}")
        for i, c in enumerate(named)
    ]
    return 0 in tuple(df.agg(*bad).first())


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """(class, count) of the non-NULL target values, most frequent first when ordered."""
    return (
        clean(df, [column])
        .select(col(column).alias("class"))
        .filter("class IS NOT NULL")
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def classify_target(df: DataFrame, column: str, method: str = "explicit") -> Target:
    """Numeric with more than ten values is regression, everything else classification."""
    found = Target(column, detection_method=method, has_datetime_index=has_datetime_column(df))
    regression = replace(found, problem_type="regression")
    numeric = column in infer_kinds(df).numeric
    if numeric and not few_values(df, [column], REGRESSION_OVER):
        return regression
    shape = class_counts(df, column).agg(
        F.count(F.lit(1)).alias("k"),
        F.round(F.max("count") / F.min("count"), 2).alias("ratio"),
    ).first()
    return replace(
        found,
        problem_type="classification",
        n_classes=shape["k"],
        imbalance_ratio=shape["ratio"] if shape["ratio"] is not None else 1.0,
    )


def _by_name(columns: list[str]) -> str | None:
    lowered = {c.lower(): c for c in columns}
    for word in EXACT_NAMES:
        if word in lowered:
            return lowered[word]
    for word in NAME_PARTS:
        for low, name in lowered.items():
            if word in low and low != word:
                return name
    for prefix in NAME_PREFIXES:
        for low, name in lowered.items():
            if low.startswith(prefix):
                return name
    return None


def _last_with_few_values(df: DataFrame, under: int) -> str | None:
    few = few_values(df, df.columns, under - 1)
    return next((c for c in reversed(df.columns) if c in few), None)


def detect_target(df: DataFrame) -> Target:
    """By name first, then the last column with fewer than ten values."""
    name = _by_name(df.columns)
    if name is not None:
        return classify_target(df, name, "name_heuristic")
    name = _last_with_few_values(df, FALLBACK_UNDER)
    if name is not None:
        return classify_target(df, name, "position_heuristic")
    return Target(None, has_datetime_index=has_datetime_column(df))


def resolve_target(df: DataFrame, target: str | None = None, no_target: bool = False) -> Target:
    """A named target, none at all, or the detected one."""
    if no_target:
        return Target(None, has_datetime_index=has_datetime_column(df))
    if target is None:
        return detect_target(df)
    if target not in df.columns:
        raise ValueError(f"unknown target column: {target}")
    return classify_target(df, target)


def target_table(df: DataFrame, target: Target) -> DataFrame:
    """The target with a row per class (class, class_count); one row without a class where the target
    is continuous or missing."""
    spark = df.sparkSession
    row = local_table(
        spark,
        [
            (
                target.column,
                target.problem_type,
                target.n_classes,
                target.imbalance_ratio,
                target.detection_method,
                target.has_datetime_index,
            )
        ],
        "column string, problem_type string, n_classes long, imbalance_ratio double, "
        "detection_method string, has_datetime_index boolean",
    )
    if target.problem_type != "classification":
        nothing = {"class": F.lit(None).cast("string"), "class_count": F.lit(None).cast("long")}
        return row.withColumns(nothing)
    classes = class_counts(df, target.column).select(
        F.lit(target.column).alias("column"),
        F.col("class").cast("string").alias("class"),
        F.col("count").alias("class_count"),
    )
    return row.join(classes, "column", "left")


def low_cardinality_profiles(
    df: DataFrame, target: str | None = None, max_values: int = PROFILED_VALUES
) -> DataFrame:
    """Numeric columns with few values: the candidates for encoded categories."""
    names = [c for c in infer_kinds(df).numeric if c != target]
    few = few_values(df, names, max_values)
    names = [c for c in names if c in few]
    n_rows = df.count()
    dtypes = dict(df.dtypes)
    frame = local_table(
        df.sparkSession,
        [(i, c, dtypes[c], n_rows) for i, c in enumerate(names)],
        "pos int, column string, dtype string, n_rows long",
    )
    if not names:
        values = local_table(df.sparkSession, [], "pos int, x double")
    else:
        values = (
            clean(df, names)
            .select(F.posexplode(F.array(*[col(c).cast("double") for c in names])).alias("pos", "x"))
            .filter("x IS NOT NULL")
            .groupBy("pos", "x")
            .agg(F.lit(1).alias("one"))
        )
    x = F.col("x")
    # Only columns with few values are left, so the lists are short.
    profile = values.groupBy("pos").agg(
        F.count(x).alias("nunique"),
        F.slice(F.sort_array(F.collect_list(x)), 1, SAMPLE_VALUES).alias("sample_values"),
        F.min(x).alias("min_val"),
        F.max(x).alias("max_val"),
        F.bool_and(x == F.floor(x)).alias("is_all_integer"),
    )
    nunique = F.coalesce("nunique", F.lit(0))
    return (
        frame.join(profile, "pos", "left")
        .filter(nunique <= max_values)
        .select(
            "column",
            "dtype",
            nunique.alias("nunique"),
            "n_rows",
            F.coalesce("sample_values", F.array().cast("array<double>")).alias("sample_values"),
            F.coalesce("min_val", F.lit(0.0)).alias("min_val"),
            F.coalesce("max_val", F.lit(0.0)).alias("max_val"),
            F.coalesce("is_all_integer", F.lit(False)).alias("is_all_integer"),
        )
    )


def match_encoded_suspects(
    profiles: DataFrame,
    suspects: DataFrame | None = None,
    categoricals: list[str] | None = None,
    enabled: bool = True,
) -> DataFrame:
    """Profiled columns named by a suspects table (column, reason, subtype) or by a list.

    A given list wins over the table; names that are not profiled are ignored.
    """
    if not enabled:
        return profiles.limit(0).withColumns({"reason": F.lit(""), "subtype": F.lit("nominal")})
    if categoricals is not None:
        return profiles.filter(F.col("column").isin(categoricals)).withColumns(
            {"reason": F.lit("named by the user"), "subtype": F.lit("nominal")}
        )
    given = suspects.select("column", "reason", "subtype")
    return profiles.join(given, "column").withColumns(
        {
            "reason": F.coalesce("reason", F.lit("")),
            "subtype": F.coalesce("subtype", F.lit("nominal")),
        }
    )


def binarise_target(df: DataFrame, target: Target, name: str = "positive") -> DataFrame:
    """Add a 0/1 column for the target, for rates in groups of rows."""
    t = col(target.column)
    numeric = target.column in infer_kinds(df).numeric
    if target.problem_type == "regression":
        median = exact_medians(df, [target.column])[target.column]
        positive = F.coalesce((t >= F.lit(median)).cast("double"), F.lit(0.0))
    elif target.n_classes <= 2 and numeric:
        positive = t.cast("double")
    else:
        counts = class_counts(df, target.column)
        if target.n_classes <= 2:
            # The rarer class counts as positive; of two equal ones the larger value.
            pick = counts.orderBy(F.asc("count"), F.desc("class")).first()
            positive = (t.cast("string") == F.lit(str(pick["class"]))).cast("double")
        else:
            pick = counts.orderBy(F.desc("count"), F.asc("class")).first()
            positive = F.coalesce((t == F.lit(pick["class"])).cast("double"), F.lit(0.0))
    return df.withColumn(name, positive)
