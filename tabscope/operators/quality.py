"""Quality rules. Each takes a ``Profile`` and returns flags as rows.

A flag is (rule_no, seq, column, rule, severity, message, value, suggestion); ``seq`` orders the
flags of a rule. Rules read the profile's small tables and scan the data only where they must.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import RARE_SHARE, col, share, vif
from tabscope.operators.describe import spread_metrics
from tabscope.operators.profile import Profile
from tabscope.plans.counts import long_form, top_by_count, value_counts
from tabscope.plans.few import without_repeats
from tabscope.plans.local import local_table

FLAGS = (
    "rule_no int, seq int, column string, rule string, severity string, message string, "
    "value double, suggestion string"
)
BLOCKING = ["BLOCKER", "HIGH"]

Rule = Callable[[Profile], DataFrame]


def _flags(
    rows: DataFrame,
    rule: str,
    severity: Column,
    message: Column,
    value: Column,
    order: list[Column],
    column: Column | None = None,
    suggestion: Column | None = None,
) -> DataFrame:
    """Rows with a severity as flags. Rows number at most one per column or pair."""
    place = Window.orderBy(*order)
    return (
        rows.withColumn("__severity", severity)
        .filter("__severity IS NOT NULL")
        .select(
            F.lit(0).alias("rule_no"),
            F.row_number().over(place).alias("seq"),
            (column if column is not None else F.lit(None).cast("string")).alias("column"),
            F.lit(rule).alias("rule"),
            F.col("__severity").alias("severity"),
            message.alias("message"),
            value.cast("double").alias("value"),
            (suggestion if suggestion is not None else F.lit("")).alias("suggestion"),
        )
    )


def _pct(value: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def missing_values(p: Profile) -> DataFrame:
    v = F.col("missing_share")
    severity = F.when(v > 0.50, "BLOCKER").when(v > 0.30, "HIGH").when(v > 0.05, "MEDIUM")
    return _flags(
        p.missing,
        "missing_values",
        severity,
        F.concat(_pct(v), F.lit(" of the values are missing")),
        v,
        [F.desc("missing_share"), F.asc("position")],
        F.col("column"),
    )


def dataset_missingness(p: Profile) -> DataFrame:
    v = F.col("missing_share")
    return _flags(
        p.missing_total,
        "dataset_missingness",
        F.when(v > 0.30, "HIGH"),
        F.concat(_pct(v), F.lit(" of all cells are missing")),
        v,
        [F.desc("missing_share")],
    )


def duplicate_rows(p: Profile) -> DataFrame:
    v = F.col("duplicate_share")
    return _flags(
        p.duplicates,
        "duplicate_rows",
        F.when(v > 0.01, "HIGH").when(v > 0.001, "MEDIUM"),
        F.format_string("%s of the rows are copies (%d rows)", _pct(v, 1), F.col("duplicate_count")),
        v,
        [F.desc("duplicate_share")],
        suggestion=F.when(v > 0.01, "Look for a step upstream that repeats rows").otherwise(
            "Check that repeated rows are meant to be there"
        ),
    )


def outlier_shares(p: Profile) -> DataFrame:
    """(position, column, outlier_share): rows outside Tukey's fences, per numeric column."""
    schema = "position int, column string, outlier_share double"
    fences = spread_metrics(p.described).filter("count >= 4 AND iqr != 0").collect()
    if not fences:
        return local_table(p.spark, [], schema)
    outside = [
        F.count(
            F.when(
                (col(r["column"]) < r["lower_fence"]) | (col(r["column"]) > r["upper_fence"]), 1
            )
        ).alias(f"o{i}")
        for i, r in enumerate(fences)
    ]
    row = p.df.agg(*outside).first()
    return local_table(
        p.spark,
        [(r["position"], r["column"], row[i] / r["count"]) for i, r in enumerate(fences)], schema
    )


def unreliability_hint(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """Why fences flag so much: the shape that fits skewness and kurtosis."""
    return (
        F.when(n < 8, "unclear")
        .when(kurtosis < 0, "platykurtic")
        .when(F.abs(skewness) > 1, "heavy_tail")
        .when(kurtosis > 0, "central_spike")
        .otherwise("unreliable")
    )


_HINT_TEXT = {
    "unclear": "too few values to tell the shape",
    "platykurtic": "separate clusters or a flat spread",
    "heavy_tail": "a heavy tail",
    "central_spike": "a central spike with smaller groups around it",
    "unreliable": "a shape that fences do not suit",
}
_HINT_ADVICE = {
    "central_spike": "Keep the rows; bin the column or model its groups apart",
    "heavy_tail": "Keep the rows; use a log or root transform or a robust scaler",
    "unclear": "Split the data by natural group before treating outliers",
    "platykurtic": "Split the data by natural group before treating outliers",
    "unreliable": "Split the data by natural group before treating outliers",
}


def _lookup(texts: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(v) for kv in texts.items() for v in kv]
    return F.element_at(F.create_map(*pairs), key)


def worst_outlier_column(p: Profile) -> DataFrame:
    """The column with the largest outlier share, with its shape hint."""
    shape = p.described.select("column", "count", "skewness", "kurtosis")
    hint = unreliability_hint(F.col("count"), F.col("skewness"), F.col("kurtosis"))
    return (
        outlier_shares(p)
        .filter("outlier_share > 0")
        .orderBy(F.desc("outlier_share"), "position")
        .limit(1)
        .join(shape, "column")
        .withColumn("hint", hint)
    )


def outliers_iqr(p: Profile) -> DataFrame:
    v = F.col("outlier_share")
    unreliable = v > 0.20
    return _flags(
        worst_outlier_column(p),
        "outliers_iqr",
        F.when(unreliable, "LOW").when(v > 0.05, "MEDIUM"),
        F.when(
            unreliable,
            F.concat(
                _pct(v, 1),
                F.lit(" of the values lie outside the IQR fences, which are unreliable here: "),
                _lookup(_HINT_TEXT, F.col("hint")),
            ),
        ).otherwise(F.concat(_pct(v, 1), F.lit(" of the values lie outside the IQR fences"))),
        v,
        [F.desc("outlier_share")],
        F.col("column"),
        F.when(unreliable, _lookup(_HINT_ADVICE, F.col("hint"))).otherwise(
            "Winsorise, cap or drop outliers as the model needs"
        ),
    )


def skewness(p: Profile, most: int | None = None) -> DataFrame:
    """All skewed columns, or the ``most`` skewed ones."""
    g, low = F.col("skewness"), F.col("min")
    size = F.abs(g)
    zeros = F.coalesce(share(F.col("zeros"), F.col("count")), F.lit(0.0)) * 100
    few = F.col("n_rows") < 30
    severity = F.when((size > 2) & ~few, "HIGH").when(size > 1, "MEDIUM")
    message = F.concat_ws(
        ", ",
        F.format_string("skewness %.2f", g),
        F.when(g > 0, "right tail").otherwise("left tail"),
        F.when(zeros > 20, F.format_string("%.0f%% zeros", zeros)),
        F.when(few, F.format_string("only %d rows", F.col("n_rows"))),
    )
    suggestion = (
        F.when((zeros > 20) & (low >= 0), "Many zeros: zero-inflated model or log1p")
        .when(zeros > 20, "Many zeros and negative values: cube root or signed log")
        .when((g > 2) & (low >= 0), "Strong right tail: log1p or square root")
        .when(g > 2, "Strong right tail with negative values: cube root or signed log")
        .when(g < -2, "Strong left tail: reflect, then log")
        .when((g > 1) & (low >= 0), "Right tail: square root may help")
        .when(g > 1, "Right tail with negative values: cube root")
        .otherwise("Left tail: reflect, then square root")
    )
    flags = _flags(
        p.described.filter("count >= 3"),
        "skewness",
        severity,
        message,
        size,
        [F.desc(size), F.asc("position")],
        F.col("column"),
        suggestion,
    )
    return flags if most is None else flags.filter(F.col("seq") <= most)


def zero_variance(p: Profile) -> DataFrame:
    first = p.described.filter("std = 0").orderBy("position").limit(1)
    return _flags(
        first,
        "zero_variance",
        F.lit("HIGH"),
        F.lit("all values are equal"),
        F.lit(0.0),
        [F.asc("position")],
        F.col("column"),
    )


def near_zero_variance(p: Profile) -> DataFrame:
    mean = F.abs("mean")
    first = (
        p.described.filter((mean > 0) & (F.col("std") > 0) & (F.col("std") < 0.01 * mean))
        .orderBy("position")
        .limit(1)
    )
    return _flags(
        first,
        "near_zero_variance",
        F.lit("LOW"),
        F.format_string("std %.4f against a mean of size %.4f", F.col("std"), mean),
        F.col("std"),
        [F.asc("position")],
        F.col("column"),
    )


def near_perfect_correlation(p: Profile) -> DataFrame:
    a = F.abs("r")
    high = a > 0.95
    pairs = p.pairs.withColumn("abs_r", a).withColumn("vif", F.round(vif(F.col("r")), 1))
    return _flags(
        pairs,
        "near_perfect_correlation",
        F.when(high, "HIGH").when(a > 0.85, "MEDIUM"),
        F.format_string(
            "'%s' and '%s': |r| %.2f, VIF %.1f", F.col("col_a"), F.col("col_b"), a, F.col("vif")
        ),
        a,
        [F.desc("abs_r"), F.asc("col_a"), F.asc("col_b")],
        suggestion=F.when(
            high, "Keep one of the two in linear models; tree models can take both"
        ).otherwise("Watch the pair in linear models; tree models can take both"),
    )


def _pair_sums(p: Profile, categorical: list[str], numeric: list[str]) -> DataFrame:
    """(cat, num, between, total, raw) sums of squares, one row per pair of columns.

    Plain sums of the distance to the column mean per category: one wide row per category is
    shuffled, and a second sum joins the categories.
    """
    distances = [
        (col(c).cast("double") - F.lit(p.stats[c]["mean"])).alias(f"__d{i}")
        for i, c in enumerate(numeric)
    ]
    long = long_form(
        p.df.select(*[col(c) for c in categorical], *distances),
        categorical,
        *[f"__d{i}" for i in range(len(numeric))],
    )
    per_category = long.groupBy(F.col("column").alias("cat"), "value").agg(
        *[
            a
            for i in range(len(numeric))
            for d in [F.col(f"__d{i}")]
            for a in (
                F.count(d).alias(f"n{i}"),
                F.sum(d).alias(f"s{i}"),
                F.sum(d * d).alias(f"q{i}"),
            )
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("num"),
                F.col(f"n{i}").alias("n"),
                F.col(f"s{i}").alias("s"),
                F.col(f"q{i}").alias("q"),
            )
            for i, c in enumerate(numeric)
        ]
    )
    n, s = F.col("n"), F.col("s")
    shift = F.sum(s) * F.sum(s) / F.sum(n)
    return (
        per_category.select("cat", F.explode(entries).alias("e"))
        .select("cat", "e.*")
        .filter("n > 0")
        .groupBy("cat", "num")
        .agg(
            (F.sum(s * s / n) - shift).alias("between"),
            (F.sum("q") - shift).alias("total"),
            F.sum("q").alias("raw"),
        )
    )


def redundancy_table(p: Profile) -> DataFrame:
    """(cat, num, eta2) of categorical and numeric columns; sparse categories are left out."""
    schema = "cat string, num string, eta2 double"
    usable = [
        r["column"]
        for r in p.categorical.collect()
        if r["cardinality"] != p.n_rows and 0 < r["cardinality"] <= p.n_rows // 2
    ]
    numeric = [c for c in p.kinds.numeric if p.stats[c]["min"] != p.stats[c]["max"]]
    if p.n_rows < 10 or not usable or not numeric:
        return local_table(p.spark, [], schema)
    between, total = F.col("between"), F.col("total")
    # What rounding alone can leave of a column that is constant over the shared rows.
    spread = total > 1e-12 * F.col("raw")
    eta = F.when(spread, F.least(between / total, F.lit(1.0))).otherwise(0.0)
    out = None
    for start in range(0, len(numeric), 12):
        sums = _pair_sums(p, usable, numeric[start : start + 12])
        part = sums.select("cat", "num", eta.alias("eta2"))
        out = part if out is None else out.unionByName(part)
    return out


def categorical_numeric_redundancy(p: Profile) -> DataFrame:
    v = F.col("eta2")
    return _flags(
        redundancy_table(p),
        "categorical_numeric_redundancy",
        F.when(v > 0.95, "HIGH"),
        F.format_string("'%s' explains '%s': eta squared %.3f", F.col("cat"), F.col("num"), v),
        F.round(v, 6),
        [F.desc(F.round("eta2", 6)), F.asc("cat"), F.asc("num")],
        suggestion=F.format_string("Use only one of '%s' and '%s'", F.col("cat"), F.col("num")),
    )


def all_unique_column(p: Profile) -> DataFrame:
    """The first column with as many values as rows. A value that a task meets twice rules a column
    out; the values of all columns left are counted in one shuffle."""
    n = p.n_rows
    full = [c for c, (present, _) in p.rough_distinct.items() if present == n] if n else []
    left = without_repeats(p.df, full)
    counts = value_counts(p.df, left).groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") == n)
    unique = {r["column"] for r in counts.collect()}
    rows = [(c, n) for c in left if c in unique][:1]
    first = local_table(p.spark, rows, "column string, n long")
    return _flags(
        first,
        "all_unique_column",
        F.lit("LOW"),
        F.format_string("all %d values differ; likely an identifier", F.col("n")),
        F.col("n"),
        [F.asc("column")],
        F.col("column"),
    )


def single_value_categorical(p: Profile) -> DataFrame:
    first = p.categorical.filter("cardinality = 1").orderBy("position").limit(1)
    return _flags(
        first,
        "single_value_categorical",
        F.lit("HIGH"),
        F.lit("only one value occurs"),
        F.lit(1.0),
        [F.asc("position")],
        F.col("column"),
    )


def high_cardinality(p: Profile) -> DataFrame:
    k = F.col("cardinality")
    severity = F.when(k == p.n_rows, None).when(k > 50, "HIGH").when(k > 20, "MEDIUM")
    return _flags(
        p.categorical,
        "high_cardinality",
        severity,
        F.format_string("%d different values", k),
        k,
        [F.desc("cardinality"), F.asc("position")],
        F.col("column"),
        F.when(k > 50, "Target encoding or an embedding instead of one-hot columns").otherwise(
            "Group infrequent values or use ordinal encoding"
        ),
    )


def rare_category(p: Profile) -> DataFrame:
    if p.n_rows < 100:
        return local_table(p.spark, [], FLAGS)
    totals = p.categorical.filter("rare_count > 0").select(
        "column", "position", F.col("count").alias("total"), "rare_count"
    )
    # Three examples per column are cut off before the shuffle.
    rare = p.value_counts.join(F.broadcast(totals), "column").filter(
        share(F.col("count"), F.col("total")) < RARE_SHARE
    )
    examples = (
        top_by_count(rare, 3, "column")
        .groupBy("column", "position", "rare_count")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("first"))
    )
    named = F.concat_ws(", ", F.transform("first", lambda e: F.concat(F.lit("'"), e["value"], F.lit("'"))))
    k = F.col("rare_count")
    return _flags(
        examples,
        "rare_category",
        F.lit("LOW"),
        F.concat(
            F.format_string("%d rare values (under 0.5%% each): ", k),
            named,
            F.when(k > 3, F.format_string(" (+%d more)", k - 3)).otherwise(""),
        ),
        k,
        [F.asc("position")],
        F.col("column"),
        F.lit("Group rare values under one name"),
    )


def class_imbalance(p: Profile) -> DataFrame:
    t = p.target
    rows = []
    if t is not None and t.column is not None:
        if t.detection_method == "position_heuristic":
            rows.append((1, t.column, "position", 0.0))
        if t.problem_type == "classification":
            rows.append((2, t.column, "classes", float(t.imbalance_ratio)))
        elif t.problem_type == "regression" and t.column in p.moments:
            m = p.moments[t.column]
            if m["count"] > 2 and m["skewness"] is not None:
                rows.append((2, t.column, "skew", abs(m["skewness"])))
    found = local_table(p.spark, rows, "place int, column string, kind string, v double")
    kind, v = F.col("kind"), F.col("v")
    severity = (
        F.when(kind == "position", "LOW")
        .when((kind == "classes") & (v > 10), "HIGH")
        .when((kind == "classes") & (v > 3), "MEDIUM")
        .when((kind == "skew") & (v > 2), "MEDIUM")
    )
    return _flags(
        found,
        "class_imbalance",
        severity,
        F.when(kind == "position", "target chosen by its position only")
        .when(kind == "classes", F.format_string("classes differ %.1f to 1 in size", v))
        .otherwise(F.format_string("target skewness of size %.2f", v)),
        v,
        [F.asc("place")],
        F.col("column"),
        F.when(kind == "position", "Name the target explicitly")
        .when(kind == "classes", "Class weights or stratified sampling")
        .otherwise("Log or Box-Cox transform of the target"),
    )


DEFAULT_RULES: list[Rule] = [
    missing_values,
    dataset_missingness,
    duplicate_rows,
    outliers_iqr,
    skewness,
    zero_variance,
    near_zero_variance,
    near_perfect_correlation,
    categorical_numeric_redundancy,
    all_unique_column,
    single_value_categorical,
    high_cardinality,
    rare_category,
    class_imbalance,
]
_extra_rules: list[Rule] = []


def register_rule(rule: Rule) -> Rule:
    """Add a rule of one's own: a callable from a ``Profile`` to a flags DataFrame."""
    if rule not in _extra_rules:
        _extra_rules.append(rule)
    return rule


def unregister_rule(rule: Rule) -> None:
    if rule in _extra_rules:
        _extra_rules.remove(rule)


def flags_schema() -> str:
    return FLAGS


def run_quality_rules(p: Profile, rules: list[Rule] | None = None) -> DataFrame:
    """All flags in rule order."""
    chosen = list(rules) if rules is not None else [*DEFAULT_RULES, *_extra_rules]
    out = local_table(p.spark, [], FLAGS)
    for number, rule in enumerate(chosen, start=1):
        out = out.unionByName(rule(p).withColumn("rule_no", F.lit(number)))
    return out


def quality_status(flags: DataFrame) -> DataFrame:
    """One row: status, number of flags and of those that block."""
    blocking = F.count_if(F.col("severity").isin(BLOCKING))
    return flags.agg(
        F.when(blocking > 0, "REVISION_NEEDED").otherwise("APPROVED").alias("status"),
        F.count(F.lit(1)).alias("flags"),
        blocking.alias("blocking_flags"),
    )


def unresolved_flags(flags: DataFrame, final_pass: bool = True) -> DataFrame:
    """On the last pass, the flags that still block."""
    return flags.filter(F.col("severity").isin(BLOCKING) & F.lit(final_pass))
