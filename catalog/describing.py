"""Descriptive statistics, missing values, histograms, density."""

from __future__ import annotations

from catalog.inputs import (
    LABELLED, LINEITEM_NET, MIXED_CATEGORIES, MIXED_ORDERS, NET_NUMERIC, SKEWED, STRESS_COLUMNS,
    STRESS_EVENTS, counts_sql, labelled, lineitem_net, mixed_orders, per_column, rounded, skewed,
    stress_events, table, union_all,
)
from catalog.registry import query
from tabscope.operators import describe, quality
from tabscope.operators.profile import Profile

SKEWED_COLUMNS = ["value", "value_squared", "user_id"]


def describe_sql(relation: str, columns: list[str]) -> str:
    """One row per column, unrounded. skewness and kurtosis are the sample versions in DuckDB."""
    return per_column(
        relation,
        columns,
        "CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", count(*) AS n_rows, "
        'count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, '
        "CAST(min({c}) AS DOUBLE) AS \"min\", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
        "quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
        "quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS \"max\", "
        "CASE WHEN min({c}) = max({c}) THEN 0 ELSE skewness({c}) END AS skewness, "
        "CASE WHEN min({c}) = max({c}) THEN 0 ELSE kurtosis({c}) END AS kurtosis, "
        "count(*) FILTER ({c} = 0) AS zeros",
    )


DESCRIBED = ["mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"]
_ROUND = ", ".join(f'round("{c}", 4) AS "{c}"' for c in DESCRIBED)


def _described(cte: str, relation: str, columns: list[str]) -> str:
    head = f"WITH {cte} " if cte else ""
    return (
        f'{head}SELECT "column", n_rows, "count", {_ROUND}, zeros FROM (\n'
        + describe_sql(relation, columns)
        + "\n)"
    )


def _describe(df):
    out = describe.describe_numeric(df)
    return rounded(out, 4, *DESCRIBED).drop("position", "all_integer")


LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


@query("describe_numeric", _described("", "lineitem", LINEITEM_NUMERIC))
def describe_numeric(spark, sf):
    return _describe(table(spark, sf, "lineitem"))


@query("describe_numeric_skewed", _described(SKEWED, "skewed", SKEWED_COLUMNS))
def describe_numeric_skewed(spark, sf):
    return _describe(skewed(spark, sf))


@query(
    "describe_numeric_missing",
    _described(STRESS_EVENTS, "stress_events", ["event_id", "user_id", "value"]),
)
def describe_numeric_missing(spark, sf):
    return _describe(stress_events(spark, sf))


@query(
    "adjusted_moments",
    f'WITH {LINEITEM_NET} SELECT "column", "count", round(skewness, 5) AS skewness, '
    f"round(kurtosis, 5) AS kurtosis FROM (\n{describe_sql('lineitem_net', NET_NUMERIC)}\n)",
)
def adjusted_moments(spark, sf):
    out = describe.adjusted_moments(lineitem_net(spark, sf))
    return rounded(out, 5, "skewness", "kurtosis")


@query(
    "describe_categorical",
    f"""WITH {MIXED_ORDERS}, vc AS ({counts_sql('mixed_orders', MIXED_CATEGORIES)})
SELECT "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique",
       arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM vc GROUP BY "column" """,
)
def describe_categorical(spark, sf):
    return describe.describe_categorical(mixed_orders(spark, sf))


MISSING_SQL = per_column(
    "stress_events",
    STRESS_COLUMNS,
    "CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", count(*) AS n_rows, "
    "count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*) AS missing_share, "
    "round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct",
)


@query(
    "missing_analysis",
    f'WITH {STRESS_EVENTS} SELECT position, "column", n_rows, missing, '
    f"round(missing_share, 6) AS missing_share, missing_pct FROM ({MISSING_SQL})",
)
def missing_analysis(spark, sf):
    return rounded(describe.missing_analysis(stress_events(spark, sf)), 6, "missing_share")


@query(
    "missing_total",
    f"WITH {STRESS_EVENTS} SELECT CAST(sum(n_rows) AS BIGINT) AS cells, "
    "CAST(sum(missing) AS BIGINT) AS missing, "
    "round(sum(missing) / sum(n_rows), 6) AS missing_share, "
    f"round(sum(missing) / sum(n_rows) * 100, 2) AS total_pct FROM ({MISSING_SQL})",
)
def missing_total(spark, sf):
    return rounded(describe.missing_total(stress_events(spark, sf)), 6, "missing_share")


SPREAD_SQL = """spread AS (
  SELECT position, "column", "count", q75 - q25 AS iqr,
         CASE WHEN mean = 0 THEN 0 ELSE abs(std / mean) END AS cv,
         q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence,
         "min", "max", std, mean, median, skewness, kurtosis
  FROM described)"""


@query(
    "spread_metrics",
    f"""WITH {LINEITEM_NET}, described AS ({describe_sql('lineitem_net', NET_NUMERIC)}), {SPREAD_SQL}
SELECT "column", "count", round(iqr, 4) AS iqr, round(cv, 6) AS cv,
       round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence,
       round("min", 4) AS "min", round("max", 4) AS "max" FROM spread""",
)
def spread_metrics(spark, sf):
    out = describe.spread_metrics(describe.describe_numeric(lineitem_net(spark, sf)))
    out = rounded(out, 4, "iqr", "lower_fence", "upper_fence", "min", "max")
    return rounded(out, 6, "cv").drop("position")


def skew_label_sql(g: str) -> str:
    side = f"CASE WHEN {g} > 0 THEN 'RIGHT' ELSE 'LEFT' END"
    return (
        f"CASE WHEN abs({g}) < 0.5 THEN 'approximately symmetric' "
        f"WHEN abs({g}) < 1.0 THEN 'slightly ' || {side} || '-SKEWED' "
        f"ELSE {side} || '-SKEWED' END"
    )


@query(
    "skew_labels",
    f"""WITH {SKEWED} SELECT "column", round(skewness, 4) AS skewness,
       {skew_label_sql('skewness')} AS skew_direction
FROM ({describe_sql('skewed', SKEWED_COLUMNS)})""",
)
def skew_labels(spark, sf):
    return rounded(describe.skew_labels(describe.describe_numeric(skewed(spark, sf))), 4, "skewness")


@query(
    "distribution_diagnostics",
    f"""WITH {SKEWED}, described AS ({describe_sql('skewed', SKEWED_COLUMNS)}), {SPREAD_SQL},
outside AS ({per_column(
        "skewed, spread", SKEWED_COLUMNS,
        "'{c}' AS \"column\", count(*) FILTER ({c} < lower_fence OR {c} > upper_fence) / count({c}) "
        "AS part", "WHERE spread.\"column\" = '{c}'")}),
worst AS (SELECT "column", part FROM outside ORDER BY part DESC LIMIT 1)
SELECT 'high_cv' AS diagnostic, "column", round(cv, 4) AS value FROM spread WHERE cv > 1
UNION ALL
SELECT 'zero_iqr', "column", iqr FROM spread WHERE iqr = 0
UNION ALL
SELECT CASE WHEN "column" IN (SELECT "column" FROM worst WHERE part > 0.2)
            THEN 'fences_unreliable' ELSE 'beyond_fences' END,
       "column", round(greatest(lower_fence - "min", "max" - upper_fence), 4)
FROM spread WHERE iqr <> 0 AND ("min" < lower_fence OR "max" > upper_fence)""",
)
def distribution_diagnostics(spark, sf):
    p = Profile(skewed(spark, sf), duplicates=0)
    flags = quality.run_quality_rules(p, [quality.outliers_iqr])
    return rounded(describe.distribution_diagnostics(p.described, None, flags), 4, "value")


def histogram_sql(relation: str, columns: list[str], bins: int = 30) -> str:
    """CTEs ranges, binned and histogram, with the bins' edges checked like numpy does."""
    ranges = per_column(
        relation,
        columns,
        "'{c}' AS \"column\", CAST(CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 "
        "ELSE min({c}) END AS DOUBLE) AS lo, CAST(CASE WHEN min({c}) = max({c}) "
        "THEN max({c}) + 0.5 ELSE max({c}) END AS DOUBLE) AS hi",
    )
    values = union_all(
        [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM {relation}" for c in columns]
    )
    n = f"CAST({bins} AS DOUBLE)"
    return f"""ranges AS ({ranges}),
guessed AS (
  SELECT "column", x, lo, hi, (hi - lo) / {n} AS width,
         least(floor((x - lo) / (hi - lo) * {n}), {bins - 1}) AS g
  FROM ({values}) JOIN ranges USING ("column") WHERE x IS NOT NULL),
binned AS (
  SELECT "column", CAST(CASE WHEN x < lo + g * width AND g > 0 THEN g - 1
              WHEN x >= lo + (g + 1) * width AND g < {bins - 1} THEN g + 1 ELSE g END AS INTEGER) AS bin
  FROM guessed),
histogram AS (
  SELECT r."column", CAST(b AS INTEGER) AS bin, lo + b * ((hi - lo) / {n}) AS low,
         CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * ((hi - lo) / {n}) END AS high,
         coalesce(n, 0) AS "count"
  FROM ranges r CROSS JOIN range(0, {bins}) t(b)
  LEFT JOIN (SELECT "column", bin, count(*) AS n FROM binned GROUP BY ALL) c
    ON c."column" = r."column" AND c.bin = b)"""


PEAKS_SQL = """peaks AS (
  SELECT *, "count" - prominence_base AS prominence,
         greatest(3 * sqrt(total / bins), 0.01 * total, 1) AS threshold
  FROM (SELECT *, greatest(coalesce(lag("count") OVER w, lead("count") OVER w),
                           coalesce(lead("count") OVER w, lag("count") OVER w)) AS prominence_base,
               sum("count") OVER (PARTITION BY "column") AS total,
               count(*) OVER (PARTITION BY "column") AS bins
        FROM histogram WINDOW w AS (PARTITION BY "column" ORDER BY bin)))"""
_NET_HISTOGRAM = histogram_sql("lineitem_net", NET_NUMERIC)


@query(
    "histogram",
    f"""WITH {LINEITEM_NET}, {_NET_HISTOGRAM}
SELECT "column", bin, round(low, 4) AS low, round(high, 4) AS high, "count" FROM histogram""",
)
def histogram(spark, sf):
    return rounded(describe.histogram(lineitem_net(spark, sf)), 4, "low", "high")


@query(
    "histogram_peaks",
    f"""WITH {LINEITEM_NET}, {_NET_HISTOGRAM}, {PEAKS_SQL}
SELECT "column", bin, round(low, 4) AS low, round(high, 4) AS high, "count",
       CAST(prominence AS BIGINT) AS prominence, round(threshold, 4) AS threshold
FROM peaks WHERE prominence > 0 AND prominence >= threshold""",
)
def histogram_peaks(spark, sf):
    peaks = describe.histogram_peaks(describe.histogram(lineitem_net(spark, sf)))
    return rounded(peaks, 4, "low", "high", "threshold")


@query(
    "modality",
    f"""WITH {LINEITEM_NET}, {_NET_HISTOGRAM}, {PEAKS_SQL}
SELECT "column", peaks, CASE WHEN peaks <= 1 THEN 'unimodal' ELSE peaks || '-modal' END AS modality
FROM (SELECT "column", count(*) FILTER (prominence > 0 AND prominence >= threshold) AS peaks
      FROM peaks GROUP BY "column")""",
)
def modality(spark, sf):
    return describe.modality(describe.histogram(lineitem_net(spark, sf)))


@query(
    "histogram_gaps",
    f"""WITH {SKEWED}, {histogram_sql('skewed', SKEWED_COLUMNS)}
SELECT "column", bin, round(low, 4) AS low, round(high, 4) AS high FROM histogram
WHERE "count" = 0""",
)
def histogram_gaps(spark, sf):
    gaps = describe.histogram_gaps(describe.histogram(skewed(spark, sf)))
    return rounded(gaps, 4, "low", "high")


@query(
    "zero_inflation",
    f"""WITH {LABELLED} SELECT * FROM (
SELECT 'quality' AS "column", count(*) FILTER (quality = 0) AS zero_count,
       count(*) FILTER (quality <> 0) AS nonzero_count,
       round(count(*) FILTER (quality = 0) / count(quality) * 100, 4) AS zero_pct,
       'zero_inflation' AS label FROM labelled
UNION ALL
SELECT 'toxic', count(*) FILTER (toxic = 0), count(*) FILTER (toxic <> 0),
       round(count(*) FILTER (toxic = 0) / count(toxic) * 100, 4), 'class_imbalance' FROM labelled)
WHERE zero_pct >= 40""",
)
def zero_inflation(spark, sf):
    return rounded(describe.zero_inflation(labelled(spark, sf), None, "toxic"), 4, "zero_pct")


@query(
    "kde_curve",
    """WITH s AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) AS std,
                  min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
grid AS (SELECT CAST(p AS INTEGER) AS point, lo + p * ((hi - lo) / 199) AS x,
                std * pow(n, -0.2) AS h, n FROM s CROSS JOIN range(0, 200) t(p))
SELECT point, round(any_value(x), 4) AS x,
       round(sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 10)
         AS density
FROM grid CROSS JOIN customer GROUP BY point""",
)
def kde_curve(spark, sf):
    curve = describe.kde_curve(table(spark, sf, "customer"), "c_acctbal")
    return rounded(rounded(curve, 4, "x"), 10, "density")
