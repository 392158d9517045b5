"""Findings: the decisions of the report as rows, and every number in one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import vif
from tabscope.operators import associate, categorical, correlate, describe, quality
from tabscope.operators import target_analysis as ta
from tabscope.operators.profile import Profile
from tabscope.plans.local import keep_rows, local_table

FINDINGS = (
    "section_no int, section string, code string, severity string, column string, value double, "
    "detail string"
)
FACTS = "section string, column string, metric string, value double, text string"
# Order of the report's sections.
SECTIONS = [
    "overview",
    "missing",
    "correlation",
    "statistics",
    "categorical",
    "associations",
    "target",
    "quality",
    "conclusions",
    "recommendations",
    "limitations",
]
FEW_ROWS = 1000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _finding(
    rows: DataFrame,
    section: str,
    code: Column | str,
    column: Column | None = None,
    value: Column | None = None,
    severity: Column | str | None = None,
    detail: Column | None = None,
) -> DataFrame:
    def text(v):
        return (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")

    return rows.select(
        F.lit(SECTIONS.index(section) + 1).alias("section_no"),
        F.lit(section).alias("section"),
        text(code).alias("code"),
        text(severity).alias("severity"),
        text(column).alias("column"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        text(detail).alias("detail"),
    )


def overview_row(p: Profile, subtypes: dict[str, str] | None = None) -> DataFrame:
    """One row: size, kinds of columns, encoded columns by subtype, and duplicates."""
    kinds, subtypes = p.kinds, subtypes or p.subtypes
    nominal = [c for c in p.encoded if (subtypes or {}).get(c, "nominal") == "nominal"]
    ordinal = [c for c in p.encoded if (subtypes or {}).get(c) == "ordinal"]
    row = local_table(
        p.spark,
        [
            (
                len(p.df.columns),
                len(kinds.numeric),
                len(kinds.categorical),
                len(kinds.datetime),
                nominal,
                ordinal,
            )
        ],
        "n_columns int, n_numeric int, n_categorical int, n_datetime int, "
        "nominal array<string>, ordinal array<string>",
    )
    doubles = p.duplicates.agg(
        F.max("n_rows").alias("original_rows"),
        F.max("duplicate_count").alias("duplicate_count"),
        F.round(F.max("duplicate_share") * 100, 1).alias("duplicate_pct"),
    )
    # Two one-row tables side by side.
    key = F.lit(1).alias("k")
    return row.select(key, "*").join(doubles.select(key, "*"), "k").drop("k")


def missing_ranked(p: Profile) -> DataFrame:
    """Columns with missing values, worst first."""
    return (
        p.missing.filter("missing > 0")
        .select("position", "column", "missing", "missing_pct")
        .orderBy(F.desc("missing_pct"), "position")
    )


def conclusion_findings(p: Profile, flags: DataFrame) -> DataFrame:
    """Completeness, collinear pairs and how many flags are serious."""
    pct = F.col("total_pct")
    worst = p.missing.agg(
        F.max_by("column", F.struct(F.col("missing_pct"), -F.col("position"))).alias("worst"),
        F.max("missing_pct").alias("worst_pct"),
    )
    one = F.lit(1).alias("k")
    total = p.missing_total.select(one, "total_pct").join(worst.select(one, "*"), "k")
    band = F.when(pct == 0, "complete").when(pct < 5, "minor_missing").otherwise("much_missing")
    completeness = _finding(
        total,
        "conclusions",
        band,
        F.when(pct >= 5, F.col("worst")),
        pct,
        detail=F.when(pct >= 5, F.col("worst_pct").cast("string")),
    )
    close = correlate.collinear_pairs(p.pairs, 0.85)
    collinear = _finding(
        close,
        "conclusions",
        "collinear_pair",
        F.concat("col_a", F.lit(" ~ "), "col_b"),
        F.round("abs_r", 4),
    )
    counts = flags.agg(
        F.count_if(F.col("severity").isin(quality.BLOCKING)).alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"),
        F.count(F.lit(1)).alias("n"),
    )
    serious = _finding(counts.filter("high > 0"), "conclusions", "high_flags", value=F.col("high"))
    medium = _finding(
        counts.filter("medium > 0"), "conclusions", "medium_flags", value=F.col("medium")
    )
    clean = _finding(counts.filter("n = 0"), "conclusions", "all_checks_passed", value=F.col("n"))
    return _union([completeness, collinear, serious, medium, clean])


def recommendation_findings(p: Profile, flags: DataFrame) -> DataFrame:
    """What to do next: missing values, redundancy, each flag's advice, and readiness."""
    pct = F.col("missing_pct")
    missing = _finding(
        p.missing.filter(pct > 5),
        "recommendations",
        "missing_values",
        F.col("column"),
        pct,
        F.when(pct > 30, "HIGH PRIORITY").otherwise("MEDIUM PRIORITY"),
    )
    redundant = correlate.collinear_pairs(p.pairs, 0.90).agg(
        F.count(F.lit(1)).alias("pairs"), F.max("abs_r").alias("r")
    )
    redundancy = _finding(
        redundant.filter("pairs > 0"),
        "recommendations",
        "redundant_pairs",
        value=F.col("pairs"),
        detail=F.format_string("worst VIF %.1f", F.round(vif(F.col("r")), 1)),
    )
    advice = _finding(
        flags.filter("suggestion != ''"),
        "recommendations",
        "data_quality",
        F.coalesce("column", F.lit("dataset")),
        F.col("value"),
        F.col("severity"),
        F.col("suggestion"),
    )
    one = F.lit(1).alias("k")
    state = p.missing_total.select(one, "total_pct").join(
        flags.agg(
            one,
            F.count_if(F.col("severity").isin(quality.BLOCKING)).alias("high"),
            F.count(F.lit(1)).alias("n"),
        ),
        "k",
    )
    readiness = [
        _finding(state.filter(rule), "recommendations", code, value=F.col("total_pct"))
        for code, rule in [
            ("readiness_missing", F.col("total_pct") > 10),
            ("readiness_blocked", F.col("high") > 0),
            ("readiness_clean", (F.col("n") == 0) & (F.col("total_pct") < 5)),
        ]
    ]
    return _union([missing, redundancy, advice, *readiness])


def limitation_findings(
    p: Profile, flags: DataFrame, signals: DataFrame | None = None
) -> DataFrame:
    """What the analysis cannot tell."""
    if signals is None:
        found = local_table(p.spark, [(0,)], "n long")
    else:
        found = signals.select("type", "subject").distinct().agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    interactions = _finding(
        found,
        "limitations",
        F.when(n > 0, "higher_order_interactions").otherwise("univariate_and_bivariate_only"),
        value=n,
    )
    sparse = _finding(
        p.missing.filter("missing_pct > 20"),
        "limitations",
        "over_20_pct_missing",
        F.col("column"),
        F.col("missing_pct"),
    )
    temporal = _finding(
        local_table(p.spark, [(0,)], "n long"), "limitations", "no_temporal_validation"
    )
    outliers = _finding(
        flags.filter("rule = 'outliers_iqr'").agg(F.count(F.lit(1)).alias("n")).filter("n > 0"),
        "limitations",
        "outlier_flags_may_be_groups",
        value=F.col("n"),
    )
    small = local_table(p.spark, [(p.n_rows,)], "n long").filter(n < FEW_ROWS)
    few_rows = _finding(small, "limitations", "few_rows", value=n)
    return _union([interactions, sparse, temporal, outliers, few_rows])


def assemble_findings(
    p: Profile,
    flags: DataFrame | None = None,
    associations: DataFrame | None = None,
    signals: DataFrame | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """All sections in order. Missing parts are computed; those without input stay away."""
    if flags is None:
        # One row per finding of a rule, read by several sections below.
        flags = keep_rows(quality.run_quality_rules(p))
    p.key = p.key or key
    name = p.target_name
    has_target = name is not None
    if has_target:
        associations = p.associations if associations is None else associations
        signals = p.signals if signals is None else signals
    parts = []
    overview = overview_row(p)
    for metric in ("original_rows", "n_columns", "n_numeric", "n_categorical", "duplicate_count"):
        parts.append(_finding(overview, "overview", metric, value=F.col(metric)))
    parts.append(
        _finding(missing_ranked(p), "missing", "missing_column", F.col("column"), F.col("missing_pct"))
    )
    parts.append(_finding(p.missing_total, "missing", "missing_total", value=F.col("total_pct")))
    sizes = local_table(
        p.spark, [(len(p.kinds.numeric), len(p.kinds.categorical))], "numeric int, categorical int"
    )
    parts.append(_finding(sizes, "correlation", "numeric_columns", value=F.col("numeric")))
    strongest = correlate.strongest_pair(p.pairs)
    parts.append(
        _finding(
            strongest,
            "correlation",
            "strongest_pair",
            F.concat("col_a", F.lit(" ~ "), "col_b"),
            F.col("r"),
            detail=F.col("strength"),
        )
    )
    parts.append(_finding(sizes, "statistics", "numeric_columns", value=F.col("numeric")))
    diagnostics = describe.distribution_diagnostics(p.described, None, flags, name)
    parts.append(
        _finding(diagnostics, "statistics", F.col("diagnostic"), F.col("column"), F.col("value"))
    )
    if p.kinds.categorical:
        parts.append(
            _finding(sizes, "categorical", "categorical_columns", value=F.col("categorical"))
        )
        bands = categorical.cardinality_bands(p.categorical)
        parts.append(_finding(bands, "categorical", F.col("band"), F.col("column"), F.col("value")))
    if has_target:
        parts.append(
            _finding(
                associations,
                "associations",
                "ranked_feature",
                F.col("feature"),
                F.col("effect_size"),
                detail=F.col("effect_size_label"),
            )
        )
        quadrants = associate.association_quadrants(associations)
        parts.append(
            _finding(
                quadrants, "associations", F.col("quadrant"), F.col("feature"), F.col("effect_size")
            )
        )
        parts.append(_target_section(p))
        if p.has_classes and p.kinds.without(name).categorical:
            parts.append(_rates_section(p, associations))
    if len(p.encoded) > 1:
        pairs = correlate.notable_ordinal_pairs(p.ordinals)
        both = F.concat("col_a", F.lit(" ~ "), "col_b")
        parts.append(_finding(pairs, "correlation", "ordinal_pair", both, F.col("rho")))
    status = quality.quality_status(flags)
    parts.append(_finding(status, "quality", F.col("status"), value=F.col("flags")))
    parts.append(
        _finding(
            flags,
            "quality",
            F.col("rule"),
            F.col("column"),
            F.col("value"),
            F.col("severity"),
            F.col("message"),
        )
    )
    parts.append(conclusion_findings(p, flags))
    parts.append(recommendation_findings(p, flags))
    parts.append(limitation_findings(p, flags, signals))
    return _union(parts)


def _rates_section(p: Profile, associations: DataFrame) -> DataFrame:
    """Columns whose values differ most in their class rates, these values, and well-ranked features
    that are not among them."""
    widest = p.widest_rates
    values = categorical.discriminative_values(p.rates, widest)
    said = F.concat("value", F.lit(" / "), "class")
    others = categorical.borda_not_in_top_spread(associations, widest)
    return _union(
        [
            _finding(widest, "categorical", "rate_spread", F.col("column"), F.col("spread"), detail=F.col("first_class")),
            _finding(values, "categorical", "value_rate", F.col("column"), F.col("rate"), detail=said),
            _finding(others, "categorical", "ranked_elsewhere", F.col("feature"), F.col("borda_score")),
        ]
    )


def _target_section(p: Profile) -> DataFrame:
    name = p.target_name
    if p.has_classes:
        differences = []
        if [c for c in p.kinds.numeric if c != name]:
            differences = [
                _finding(p.class_stats, "target", "class_mean", F.col("feature"), F.col("mean"), detail=F.col("class")),
                _finding(p.class_differences, "target", "cohens_d", F.col("feature"), F.col("cohens_d")),
            ]
        return _union(
            [
                *differences,
                _finding(p.classes, "target", "class_share", F.col("class"), F.col("pct")),
                _finding(
                    ta.imbalance(p.classes),
                    "target",
                    "imbalance",
                    F.lit(name),
                    F.col("imbalance_ratio"),
                    detail=F.col("band"),
                ),
            ]
        )
    close = p.target_correlation.filter("place IS NOT NULL")
    return _union(
        [
            *[
                _finding(p.target_stats, "target", f"target_{k}", F.lit(name), F.col(k))
                for k in ("mean", "median", "std", "skewness")
            ],
            _finding(close, "target", "correlated_feature", F.col("feature"), F.col("r")),
        ]
    )


def _facts(rows: DataFrame, section: str, column: Column, metrics: list[str], text=None) -> DataFrame:
    """Wide result rows to one row per metric."""
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return rows.select(
        F.lit(section).alias("section"),
        column.cast("string").alias("column"),
        F.explode(entries).alias("e"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
    ).select("section", "column", "e.metric", "e.value", "text")


def fact_table(
    p: Profile,
    flags: DataFrame | None = None,
    associations: DataFrame | None = None,
    signals: DataFrame | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Every statistic as (section, column, metric, value, text). Missing parts are computed."""
    flags = flags if flags is not None else keep_rows(quality.run_quality_rules(p))
    name = F.col("column")
    target, p.key = p.target_name, p.key or key
    if target is not None:
        associations = p.associations if associations is None else associations
        signals = p.signals if signals is None else signals
    shapes = describe.skew_labels(p.described)
    values, bins = p.top_values, p.bins
    diagnostics = describe.distribution_diagnostics(p.described, p.categories, flags, target)
    parts = [
        _facts(
            overview_row(p),
            "overview",
            F.lit(None),
            ["original_rows", "duplicate_count", "duplicate_pct", "n_columns", "n_numeric", "n_categorical", "n_datetime"],
        ),
        _facts(shapes, "shape", name, ["skewness"], F.col("skew_direction")),
        _facts(diagnostics, "diagnostics", name, ["value"], F.col("diagnostic")),
        _facts(p.categories, "categorical", name, ["count", "unique", "freq"], F.col("top")),
        _facts(describe.histogram_gaps(bins), "gaps", name, ["low", "high"], F.col("bin")),
        _facts(categorical.rate_reliability(values), "margins", name, ["margin_pp"], F.concat("value", F.lit(" "), "level")),
        _facts(p.missing, "missing", name, ["missing", "missing_pct"]),
        _facts(
            p.described,
            "statistics",
            name,
            ["count", "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"],
        ),
        _facts(
            describe.spread_metrics(p.described),
            "statistics",
            name,
            ["iqr", "cv", "lower_fence", "upper_fence"],
        ),
        _facts(bins, "histogram", name, ["count"], F.col("bin")),
        _facts(describe.modality(bins), "histogram", name, ["peaks"], F.col("modality")),
        _facts(
            p.zeros,
            "histogram",
            name,
            ["zero_count", "zero_pct"],
            F.col("label"),
        ),
        _facts(
            correlate.ranked_pairs(p.pairs),
            "correlation",
            F.concat("col_a", F.lit(" ~ "), "col_b"),
            ["r"],
            F.col("strength"),
        ),
        _facts(
            p.categorical,
            "categorical",
            name,
            ["cardinality", "entropy_bits", "rare_count", "more_values"],
        ),
        _facts(
            values,
            "categorical",
            name,
            ["count", "pct"],
            F.col("value"),
        ),
        _facts(flags, "quality", name, ["value"], F.concat("severity", F.lit(" "), "rule")),
    ]
    if len(p.encoded) > 1:
        both = F.concat("col_a", F.lit(" ~ "), "col_b")
        parts.append(_facts(p.ordinals, "correlation", both, ["rho"], F.lit("ordinal")))
    said = F.concat("value", F.lit(" / "), "class")
    if p.has_classes:
        widest = p.widest_rates
        parts += [
            _facts(p.rates, "target_rates", name, ["rate"], said),
            _facts(categorical.anomalous_rates(p.rates), "anomalous_rates", name, ["ratio"], said),
            _facts(widest, "rate_spread", name, ["spread", "max_rate"], F.col("first_class")),
            _facts(categorical.discriminative_values(p.rates, widest), "rate_spread", name, ["rate"], said),
            _facts(p.classes, "target", F.col("class"), ["count", "pct"]),
            _facts(ta.imbalance(p.classes), "target", F.lit(target), ["n_classes", "imbalance_ratio"], F.col("band")),
        ]
        if [c for c in p.kinds.numeric if c != target]:
            stats = p.class_stats
            parts.append(_facts(stats, "class_statistics", F.col("feature"), ["n", "mean", "std"], F.col("class")))
            parts.append(_facts(p.class_differences, "class_differences", F.col("feature"), ["cohens_d"]))
    elif target is not None:
        parts.append(
            _facts(
                p.target_stats,
                "target",
                name,
                ["mean", "median", "std", "skewness", "kurtosis", "min", "max"],
            )
        )
        parts.append(_facts(p.target_correlation, "target", F.col("feature"), ["r", "place"]))
    if target is not None:
        quadrants = associate.association_quadrants(associations)
        parts.append(_facts(quadrants, "quadrants", F.col("feature"), ["effect_size"], F.col("quadrant")))
    if associations is not None:
        parts.append(
            _facts(
                associations,
                "associations",
                F.col("feature"),
                ["mi_score", "effect_size", "borda_score", "f_stat_or_chi2", "p_value"],
                F.col("effect_size_label"),
            )
        )
    if signals is not None:
        parts.append(
            _facts(
                signals,
                "interactions",
                F.col("subject"),
                ["count", "rate_pct"],
                F.concat("type", F.lit(" / "), "group"),
            )
        )
    return _union(parts)
