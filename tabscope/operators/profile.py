"""The shared results that rules and findings read, each computed once per table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.operators import associate, categorical as categories, correlate, describe, interact
from tabscope.operators import target_analysis as ta
from tabscope.operators.categorical import summary_from_counts
from tabscope.operators.cleaning import duplicate_summary, reclassify_columns
from tabscope.operators.target import Target
from tabscope.plans.counts import value_counts
from tabscope.plans.kinds import infer_kinds, normalise
from tabscope.plans.moments import basic_stats, collect_moments
from tabscope.plans.pairs import pair_correlations
from tabscope.plans.scratch import materialise
from tabscope.plans.local import keep_rows, local_table


class Profile:
    """Results over one table that have one row per column or pair, kept as small DataFrames.

    ``duplicates`` is the number of copies removed before; None means that the rows given here
    are to be checked. ``encoded`` names numeric columns confirmed to be categories, ``subtypes`` tells
    which of them are ``ordinal`` or ``nominal``, and ``key`` names the columns that identify a row.
    """

    def __init__(
        self,
        df: DataFrame,
        target: Target | None = None,
        encoded: list[str] | tuple[str, ...] = (),
        duplicates: int | None = None,
        subtypes: dict[str, str] | None = None,
        key: list[str] | None = None,
    ):
        self.target = target
        self.subtypes, self.key = subtypes, key
        self.encoded = [c for c in encoded if c in infer_kinds(df).numeric]
        self.raw = df
        self.df = normalise(reclassify_columns(df, self.encoded) if self.encoded else df)
        self.kinds = infer_kinds(self.df)
        self._duplicates = duplicates
        self.spark = df.sparkSession

    @cached_property
    def overview(self) -> dict[str, tuple[int, int]]:
        """(non-NULL rows, approximate distinct values) of every column, and the row count
        under the empty name: one scan."""
        names = self.df.columns
        row = self.df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
            *[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)],
        ).first()
        return {"": (row["n"], 0)} | {c: (row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(names)}

    @property
    def n_rows(self) -> int:
        return self.overview[""][0]

    @property
    def rough_distinct(self) -> dict[str, tuple[int, int]]:
        return {c: v for c, v in self.overview.items() if c}

    @cached_property
    def stats(self) -> dict:
        return basic_stats(self.df, self.kinds.numeric)

    @cached_property
    def moments(self) -> dict:
        return collect_moments(self.df, self.kinds.numeric, self.stats)

    @cached_property
    def described(self) -> DataFrame:
        return describe.describe_numeric(self.df, self.kinds.numeric, self.moments)

    @cached_property
    def missing(self) -> DataFrame:
        present = {c: n for c, (n, _) in self.rough_distinct.items()}
        return describe.missing_from_counts(self.spark, self.n_rows, present)

    @cached_property
    def missing_total(self) -> DataFrame:
        return describe.total_from_missing(self.missing)

    @cached_property
    def duplicates(self) -> DataFrame:
        """One row: n_rows (original), duplicate_count, duplicate_share."""
        if self._duplicates is None:
            return keep_rows(
                duplicate_summary(self.df).select("n_rows", "duplicate_count", "duplicate_share")
            )
        rows = self.n_rows + self._duplicates
        return local_table(
            self.spark,
            [(rows, self._duplicates, self._duplicates / max(rows, 1))],
            "n_rows long, duplicate_count long, duplicate_share double",
        )

    @cached_property
    def value_counts(self) -> DataFrame:
        """Counted once and kept as a table on shared storage: it may hold many values."""
        return materialise(value_counts(self.df, self.kinds.categorical), "value-counts")

    @cached_property
    def categorical(self) -> DataFrame:
        return keep_rows(summary_from_counts(self.value_counts, self.kinds.categorical))

    @cached_property
    def pairs(self) -> DataFrame:
        return pair_correlations(self.df, self.kinds.numeric, stats=self.stats)

    @cached_property
    def categories(self) -> DataFrame:
        """count, unique, top, freq of every categorical column."""
        return keep_rows(describe.describe_categorical(self.df, counts=self.value_counts))

    @cached_property
    def top_values(self) -> DataFrame:
        """At most ten rows a column."""
        return keep_rows(categories.top_values(self.df, counts=self.value_counts))

    @cached_property
    def bins(self) -> DataFrame:
        """The histograms of all numeric columns, a row a bin."""
        return keep_rows(describe.histogram(self.df, self.kinds.numeric, stats=self.stats))

    @cached_property
    def zeros(self) -> DataFrame:
        return keep_rows(describe.zero_inflation(self.df, self.kinds.numeric, self.target_name))

    @cached_property
    def ordinals(self) -> DataFrame:
        """Spearman among the encoded ordinal columns, a row a pair."""
        return keep_rows(correlate.ordinal_spearman(self.df, self.encoded, self.subtypes))

    @property
    def target_name(self) -> str | None:
        return self.target.column if self.target is not None else None

    @property
    def has_classes(self) -> bool:
        return self.target_name is not None and self.target.problem_type == "classification"

    @cached_property
    def classes(self) -> DataFrame:
        """Shares of the target's classes; there may be many."""
        return materialise(ta.class_distribution(self.df, self.target_name), "classes")

    @cached_property
    def class_stats(self) -> DataFrame:
        """A row for each class and numeric feature."""
        return materialise(ta.per_class_feature_stats(self.df, self.target_name), "class-stats")

    @cached_property
    def class_differences(self) -> DataFrame:
        return keep_rows(ta.cohens_d_ranking(self.class_stats, self.df.columns))

    @cached_property
    def rates(self) -> DataFrame:
        """Class rates of the top values: at most ten values a column, times the classes."""
        names = self.kinds.categorical
        return materialise(categories.target_rates(self.df, self.target_name, names, counts=self.value_counts), "rates")

    @cached_property
    def widest_rates(self) -> DataFrame:
        names = self.kinds.without(self.target_name).categorical
        return keep_rows(categories.discriminative_columns(self.rates, names, self.target_name))

    @cached_property
    def target_stats(self) -> DataFrame:
        return keep_rows(ta.regression_target_stats(self.df, self.target_name))

    @cached_property
    def target_correlation(self) -> DataFrame:
        return keep_rows(correlate.feature_target_correlation(self.df, self.target_name, self.kinds.numeric))

    @cached_property
    def associations(self) -> DataFrame:
        """A row a feature; empty without a target."""
        return keep_rows(associate.feature_associations(self.df, self.target, key=self.key))

    @cached_property
    def signals(self) -> DataFrame:
        return keep_rows(interact.interaction_signals(self.df, self.target, self.associations))
