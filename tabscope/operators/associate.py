"""Feature-target associations: effect sizes, p-values, ranks and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import col, effect_size_label, position_in, share
from tabscope.functions.tails import tail_by_family
from tabscope.operators.cleaning import apply_missingness_strategy
from tabscope.operators.mutual_info import mutual_information
from tabscope.operators.target import Target
from tabscope.plans.counts import long_form
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.pairs import pair_correlations
from tabscope.plans.local import local_table

FEATURES_PER_PASS = 24
# Rows up to which a table of class margins is broadcast; beyond, Spark picks the join.
BROADCAST_ROWS = 200_000
EFFECTS = (
    "feature string, effect_size double, effect_size_type string, statistic double, p_value double"
)
ASSOCIATIONS = (
    "place int, feature string, feature_type string, mi_score double, mi_rank int, "
    "effect_size double, effect_size_type string, effect_size_label string, "
    "effect_size_rank int, borda_score int, f_stat_or_chi2 double, p_value double, "
    "total_features int, missingness_strategy string, mi_sample_size int, mi_sample_note string"
)


def _group_moment(x) -> list:
    return [
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"),
    ]


def group_moments_by_class(df: DataFrame, target: str, numeric: list[str]) -> DataFrame:
    """(feature, n, mean, m2) per class and numeric feature: one row per class is shuffled."""
    out = None
    for start in range(0, len(numeric), FEATURES_PER_PASS):
        chunk = numeric[start : start + FEATURES_PER_PASS]
        wide = (
            clean(df, [target, *chunk])
            .filter(col(target).isNotNull())
            .groupBy(col(target).alias("__class"))
            .agg(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), *_group_moment(col(c).cast("double"))
                    ).alias(f"s{i}")
                    for i, c in enumerate(chunk)
                ]
            )
        )
        entries = F.array(*[F.col(f"s{i}") for i in range(len(chunk))])
        part = wide.select(F.explode(entries).alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    return out.filter("n > 0")


def group_moments_by_value(df: DataFrame, target: str, categorical: list[str]) -> DataFrame:
    """(feature, n, mean, m2) of a numeric target per value of each categorical feature."""
    long = long_form(
        df.withColumn("__target", col(target).cast("double")), categorical, "__target"
    ).filter("__target IS NOT NULL")
    return (
        long.groupBy(F.col("column").alias("feature"), "value")
        .agg(*_group_moment(F.col("__target")))
        .select("feature", "n", "mean", "m2")
    )


def anova_sums(moments: DataFrame, *keys: str) -> DataFrame:
    """Sums of squares between and within groups, from (keys..., n, mean, m2)."""
    n, mean = F.col("n"), F.col("mean")
    # One row per feature (or pair of columns).
    grand = moments.groupBy(*keys).agg((F.sum(n * mean) / F.sum(n)).alias("grand_mean"))
    off = mean - F.col("grand_mean")
    return (
        moments.join(F.broadcast(grand), list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("rows"),
            F.sum(n * off * off).alias("between"),
            F.sum("m2").alias("within"),
        )
    )


def eta_squared(moments: DataFrame) -> DataFrame:
    """eta squared with the F statistic and p-value of a one-way analysis of variance."""
    sums = anova_sums(moments, "feature")
    k, n = F.col("groups"), F.col("rows")
    between, within = F.col("between"), F.col("within")
    eta = F.coalesce(share(between, between + within), F.lit(0.0))
    eta = F.when(k < 2, 0.0).otherwise(F.round(F.least(eta, F.lit(1.0)), 6))
    f = (
        F.when((k < 2) | (n <= k) | (between + within == 0), None)
        .when(within == 0, F.lit(float("inf")))
        .otherwise(F.try_divide(between / (k - 1), within / (n - k)))
    )
    p = F.coalesce(tail_by_family(F.lit("f"), F.col("f"), k - 1, n - k), F.lit(1.0))
    return (
        sums.withColumn("f", f)
        .withColumn("p", p)
        .select(
            "feature",
            eta.alias("effect_size"),
            F.lit("eta2").alias("effect_size_type"),
            F.round(F.coalesce("f", F.lit(0.0)), 4).alias("statistic"),
            F.round("p", 6).alias("p_value"),
        )
    )


def cramers_v(df: DataFrame, target: str, categorical: list[str]) -> DataFrame:
    """Cramer's V with chi-squared and p-value; Yates' correction for two-by-two tables.

    chi2 = n * (sum of o*o / (r*c) - 1) over the cells that occur, so absent cells need no row.
    The class margins c meet the cells first, then one aggregation per value gives r and the
    value's share of the sum.
    """
    # Filtered before the rows are multiplied, so that all uses of the cells share one shuffle.
    known = df.filter(col(target).isNotNull()).withColumn("__class", col(target).cast("string"))
    cells = (
        long_form(known, categorical, "__class")
        .groupBy(F.col("column").alias("feature"), "value", F.col("__class").alias("class"))
        .agg(F.count(F.lit(1)).alias("o"))
    )
    by_class = cells.groupBy("feature", "class").agg(F.sum("o").alias("c"))
    classes = clean(df, [target]).agg(F.approx_count_distinct(col(target))).first()[0]
    if classes * len(categorical) <= BROADCAST_ROWS:
        by_class = F.broadcast(by_class)
    o, c, r, n = (F.col(k).cast("double") for k in ("o", "c", "r", "n"))
    by_value = (
        cells.join(by_class, ["feature", "class"])
        .groupBy("feature", "value")
        .agg(F.sum("o").alias("r"), F.sum(o * o / c).alias("q"))
    )
    columns = by_class.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("c").alias("n"),
        F.sum(1 / F.col("c")).alias("inverse_c"),
    )
    # One row per feature.
    sums = (
        by_value.join(F.broadcast(columns), "feature")
        .groupBy("feature", "n_classes", "n", "inverse_c")
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            F.sum(F.col("q") / r).alias("total"),
            F.sum(1 / r).alias("inverse_r"),
        )
    )
    plain = F.greatest(n * (F.col("total") - 1), F.lit(0.0))
    # In a two-by-two table all four cells are equally far from what is expected of them.
    per_square = n * F.col("inverse_r") * F.col("inverse_c")
    away = F.sqrt(plain / per_square)
    yates = F.pow(away - F.least(F.lit(0.5), away), 2) * per_square
    small = F.least("n_values", "n_classes")
    freedom = (F.col("n_values") - 1) * (F.col("n_classes") - 1)
    v = F.sqrt(F.col("chi2") / (n * (small - 1)))
    return (
        sums.filter(small >= 2)
        .withColumn("chi2", F.when(freedom == 1, yates).otherwise(plain))
        .withColumn("p", tail_by_family(F.lit("chi2"), F.col("chi2"), freedom, F.lit(1.0)))
        .select(
            "feature",
            F.round(F.least(v, F.lit(1.0)), 6).alias("effect_size"),
            F.lit("cramer_v").alias("effect_size_type"),
            F.round("chi2", 4).alias("statistic"),
            F.round("p", 6).alias("p_value"),
        )
    )


def pearson_effect(df: DataFrame, target: str, numeric: list[str]) -> DataFrame:
    """|r| with its two-sided p-value; too few rows or no spread gives (0, 0, 1)."""
    pairs = pair_correlations(df, pairs=[(c, target) for c in numeric])
    r, n = F.col("r"), F.col("n")
    usable = (n >= 3) & r.isNotNull()
    rest = 1 - r * r
    t = F.when(rest <= 0, F.lit(float("inf"))).otherwise(
        F.abs(r) * F.sqrt(F.try_divide((n - 2).cast("double"), rest))
    )
    return (
        pairs.withColumn("t", F.when(usable, t))
        .withColumn("p", tail_by_family(F.lit("t"), F.col("t"), n - 2, F.lit(1.0)))
        .select(
            F.col("col_a").alias("feature"),
            F.when(usable, F.round(F.abs(r), 6)).otherwise(0.0).alias("effect_size"),
            F.lit("pearson_r").alias("effect_size_type"),
            F.when(usable, F.round(F.abs(r), 4)).otherwise(0.0).alias("statistic"),
            F.when(usable, F.round("p", 6)).otherwise(1.0).alias("p_value"),
        )
    )


def effect_sizes(
    df: DataFrame, target: str, task: str, numeric: list[str], categorical: list[str]
) -> DataFrame:
    """One row per feature with the effect size that suits its kind and the task."""
    parts = []
    if task == "classification":
        if numeric:
            parts.append(eta_squared(group_moments_by_class(df, target, numeric)))
        if categorical:
            parts.append(cramers_v(df, target, categorical))
    else:
        if numeric:
            parts.append(pearson_effect(df, target, numeric))
        if categorical:
            parts.append(eta_squared(group_moments_by_value(df, target, categorical)))
    if not parts:
        return local_table(df.sparkSession, [], EFFECTS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_associations(
    df: DataFrame,
    target: Target,
    top_n: int = 10,
    encoded: list[str] | tuple[str, ...] = (),
    key: list[str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Features ranked by the sum of their mutual-information and effect-size ranks.

    Both use all rows; with ``max_rows`` mutual information uses a sample above that number. ``key``
    names columns that identify a row; all columns by default.
    """
    spark = df.sparkSession
    if target.column is None or target.problem_type == "unsupervised":
        return local_table(spark, [], ASSOCIATIONS)
    name, task = target.column, target.problem_type
    kinds = infer_kinds(df, encoded).without(name)
    numeric, categorical = kinds.numeric, kinds.categorical
    features = [*numeric, *categorical]
    if not features:
        return local_table(spark, [], ASSOCIATIONS)
    keys = key or df.columns
    # The key columns travel along under other names: missing values are filled in the features.
    tags = {f"__key_{i}": col(c).cast("string") for i, c in enumerate(keys)}
    rows, strategy = apply_missingness_strategy(
        df.withColumns(tags), name, features, encoded=encoded, keep=list(tags)
    )
    n = rows.agg(F.count(F.lit(1))).first()[0]
    sampled = max_rows is not None and n > max_rows
    note = (
        f"MI estimated on a sample of {max_rows:,} of {n:,} rows; effect sizes on all rows"
        if sampled
        else ""
    )
    effects = effect_sizes(rows, name, task, numeric, categorical)
    scores = mutual_information(rows, name, task, numeric, categorical, list(tags), max_rows)
    frame = local_table(
        spark,
        [
            (
                i,
                c,
                "numerical" if c in numeric else "categorical",
                _effect_type(task, c in numeric),
            )
            for i, c in enumerate(features)
        ],
        "position int, feature string, feature_type string, default_type string",
    )
    # From here on there is one row per feature of the schema.
    joined = (
        frame.join(scores, "feature", "left")
        .join(effects, "feature", "left")
        .select(
            "position",
            "feature",
            "feature_type",
            F.coalesce("mi_score", F.lit(0.0)).alias("mi_raw"),
            F.coalesce("effect_size", F.lit(0.0)).alias("effect_size"),
            F.coalesce("effect_size_type", "default_type").alias("effect_size_type"),
            F.coalesce("statistic", F.lit(0.0)).alias("f_stat_or_chi2"),
            F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
        )
    )
    by_mi = Window.orderBy(F.desc("mi_raw"), "position")
    by_effect = Window.orderBy(F.desc("effect_size"), "position")
    ranked = (
        joined.withColumn("mi_rank", F.row_number().over(by_mi))
        .withColumn("effect_size_rank", F.row_number().over(by_effect))
        .withColumn("borda_score", F.col("mi_rank") + F.col("effect_size_rank"))
    )
    fused = Window.orderBy(
        "borda_score",
        F.desc("effect_size"),
        position_in(features, F.col("feature")),
    )
    return (
        ranked.withColumn("place", F.row_number().over(fused))
        .filter(F.col("place") <= top_n)
        .select(
            "place",
            "feature",
            "feature_type",
            F.round("mi_raw", 6).alias("mi_score"),
            "mi_rank",
            "effect_size",
            "effect_size_type",
            effect_size_label(F.col("effect_size_type"), F.col("effect_size")).alias(
                "effect_size_label"
            ),
            "effect_size_rank",
            "borda_score",
            "f_stat_or_chi2",
            "p_value",
            F.lit(len(features)).alias("total_features"),
            F.lit(strategy).alias("missingness_strategy"),
            F.lit(max_rows if sampled else None).cast("int").alias("mi_sample_size"),
            F.lit(note).alias("mi_sample_note"),
        )
    )


def _effect_type(task: str, numeric: bool) -> str:
    if task == "classification":
        return "eta2" if numeric else "cramer_v"
    return "pearson_r" if numeric else "eta2"


def association_quadrants(associations: DataFrame) -> DataFrame:
    """Features where information and effect size disagree."""
    high = F.col("mi_rank") <= F.ceil(F.col("total_features") / 2)
    label = F.col("effect_size_label")
    quadrant = F.when(high & (label == "weak"), "NONLINEAR SIGNAL").when(
        ~high & (label == "strong"), "SUSPICIOUS ASSOCIATION"
    )
    return (
        associations.withColumn("quadrant", quadrant)
        .filter("quadrant IS NOT NULL")
        .select("feature", "mi_rank", "effect_size", "effect_size_label", "quadrant")
    )
