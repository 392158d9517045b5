"""One call for all results over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabscope.operators import (
    associate,
    categorical,
    correlate,
    describe,
    findings,
    quality,
    target_analysis,
)
from tabscope.operators.cleaning import dataset_profile
from tabscope.operators.profile import Profile
from tabscope.operators.target import resolve_target, target_table
from tabscope.plans.kinds import column_kinds
from tabscope.plans.local import keep_rows


def profile(
    df: DataFrame,
    target: str | None = None,
    no_target: bool = False,
    categoricals: list[str] | tuple[str, ...] = (),
    duplicates: int | None = None,
    key: list[str] | None = None,
    subtypes: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All result tables by name.

    ``categoricals`` names numeric columns that hold categories, ``subtypes`` tells which of them are
    ``ordinal``, ``duplicates`` is the number of copies removed before, ``key`` the columns that identify a
    row in the association sample. Results that several tables need are computed once (``Profile``).
    """
    found = resolve_target(df, target, no_target)
    p = Profile(df, found, categoricals, duplicates, subtypes, key)
    data, kinds, name = p.df, p.kinds, found.column
    flags = keep_rows(quality.run_quality_rules(p))
    out = {
        "column_kinds": column_kinds(df, p.encoded),
        "dataset_profile": dataset_profile(df),
        "target": target_table(data, found),
        "overview": findings.overview_row(p),
        "describe_numeric": p.described,
        "describe_categorical": p.categories,
        "missing_analysis": p.missing,
        "missing_total": p.missing_total,
        "histogram": p.bins,
        "histogram_gaps": describe.histogram_gaps(p.bins),
        "modality": describe.modality(p.bins),
        "correlation_matrix": correlate.correlation_matrix(data, kinds.numeric, p.stats, p.pairs),
        "ranked_pairs": correlate.ranked_pairs(p.pairs),
        "spread_metrics": describe.spread_metrics(p.described),
        "skew_labels": describe.skew_labels(p.described),
        "distribution_diagnostics": describe.distribution_diagnostics(p.described, p.categories, flags, name),
        "zero_inflation": p.zeros,
        "cardinality_bands": categorical.cardinality_bands(p.categorical),
        "categorical_summary": p.categorical,
        "categorical_values": p.top_values,
        "rate_reliability": categorical.rate_reliability(p.top_values),
        "ordinal_spearman": p.ordinals,
        "notable_ordinal_pairs": correlate.notable_ordinal_pairs(p.ordinals),
        "flags": flags,
        "status": quality.quality_status(flags),
    }
    if name is not None:
        out["feature_associations"] = p.associations
        out["interaction_signals"] = p.signals
        out["association_quadrants"] = associate.association_quadrants(p.associations)
        if p.has_classes:
            out["class_distribution"] = p.classes
            out["imbalance"] = target_analysis.imbalance(p.classes)
            out["per_class_feature_stats"] = p.class_stats
            out["cohens_d_ranking"] = p.class_differences
            out["target_rates"] = p.rates
            out["anomalous_rates"] = categorical.anomalous_rates(p.rates)
            out["discriminative_columns"] = p.widest_rates
            out["discriminative_values"] = categorical.discriminative_values(p.rates, p.widest_rates)
            out["borda_not_in_top_spread"] = categorical.borda_not_in_top_spread(p.associations, p.widest_rates)
        else:
            out["target_stats"] = p.target_stats
            out["feature_target_correlation"] = p.target_correlation
    out["findings"] = findings.assemble_findings(p, flags)
    out["fact_table"] = findings.fact_table(p, flags)
    return out
