"""Findings tables, the fact table and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F


from catalog.associating import RANKED
from catalog.correlating import pairs_sql
from catalog.describing import MISSING_SQL, SPREAD_SQL, describe_sql, histogram_sql
from catalog.inputs import (
    LABELLED, LINEITEM_NET, NET_NUMERIC, ORDER_QUANTITIES, QUANTITIES, STRESS_EVENTS, counts_sql, labelled,
    lineitem_net, order_quantities, rounded, stress_events, table,
)
from catalog.interacting import PERSISTENCE, TRAJECTORY, _MEDIANS
from catalog.quality import STRESS_RULES, all_rules_sql
from catalog.registry import query
from tabscope.facade import profile
from tabscope.operators import findings, interact, plotdata, quality
from tabscope.operators.associate import feature_associations
from tabscope.operators.profile import Profile
from tabscope.operators.target import classify_target

_NUMERIC = ["event_id", "user_id", "value"]
_CATEGORIES = ["event_type", "props"]
_BASE = f"""{STRESS_EVENTS}, flags AS ({STRESS_RULES}),
missing AS ({MISSING_SQL}),
total AS (SELECT sum(n_rows) AS cells, sum(missing) AS missing,
          round(sum(missing) / sum(n_rows) * 100, 2) AS total_pct FROM missing),
pairs AS ({pairs_sql('stress_events', _NUMERIC)})"""
_NET_FLAGS = all_rules_sql(
    "lineitem_net", [*NET_NUMERIC, "l_returnflag", "l_linestatus"], NET_NUMERIC,
    ["l_returnflag", "l_linestatus"],
)
_NET_BASE = f"""{LINEITEM_NET}, flags AS ({_NET_FLAGS}),
pairs AS ({pairs_sql('lineitem_net', NET_NUMERIC)})"""


def _show(rows):
    return rounded(rows, 4, "value")


@query(
    "overview_row",
    f"""WITH {STRESS_EVENTS}, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM stress_events))
SELECT 5 AS n_columns, 2 AS n_numeric, 3 AS n_categorical, 0 AS n_datetime, '' AS nominal,
  'user_id' AS ordinal, count(*) AS original_rows, count(*) - (SELECT n FROM d) AS duplicate_count,
  round((1 - (SELECT n FROM d) / count(*)) * 100, 1) AS duplicate_pct FROM stress_events""",
)
def overview_row(spark, sf):
    p = Profile(stress_events(spark, sf), encoded=["user_id"])
    row = findings.overview_row(p, {"user_id": "ordinal"})
    return row.withColumns({c: F.array_join(c, ",") for c in ("nominal", "ordinal")})


@query(
    "missing_ranked",
    f'WITH {STRESS_EVENTS} SELECT position, "column", missing, missing_pct FROM ({MISSING_SQL}) '
    "WHERE missing > 0",
)
def missing_ranked(spark, sf):
    return findings.missing_ranked(Profile(stress_events(spark, sf)))


CONCLUSIONS = """SELECT 9 AS section_no, 'conclusions' AS section,
  CASE WHEN total_pct = 0 THEN 'complete' WHEN total_pct < 5 THEN 'minor_missing'
       ELSE 'much_missing' END AS code, CAST(NULL AS VARCHAR) AS severity,
  CASE WHEN total_pct >= 5 THEN (SELECT arg_max("column", (missing_pct, -position)) FROM missing)
    END AS "column", round(total_pct, 4) AS value,
  CASE WHEN total_pct >= 5 THEN CAST((SELECT max(missing_pct) FROM missing) AS VARCHAR) END AS detail
FROM total
UNION ALL SELECT 9, 'conclusions', 'collinear_pair', NULL, col_a || ' ~ ' || col_b,
  round(abs(r), 4), NULL FROM pairs WHERE abs(r) > 0.85
UNION ALL SELECT 9, 'conclusions', 'high_flags', NULL, NULL, count(*), NULL FROM flags
  WHERE severity IN ('BLOCKER', 'HIGH') HAVING count(*) > 0
UNION ALL SELECT 9, 'conclusions', 'medium_flags', NULL, NULL, count(*), NULL FROM flags
  WHERE severity = 'MEDIUM' HAVING count(*) > 0
UNION ALL SELECT 9, 'conclusions', 'all_checks_passed', NULL, NULL, 0, NULL FROM flags
  HAVING count(*) = 0"""


@query("conclusion_findings", f"WITH {_BASE} {CONCLUSIONS}")
def conclusion_findings(spark, sf):
    p = Profile(stress_events(spark, sf))
    return _show(findings.conclusion_findings(p, quality.run_quality_rules(p)))


# Advice texts are the library's own; the rows, their order of urgency and values are compared.
RECOMMENDATIONS = """SELECT 10 AS section_no, 'recommendations' AS section, 'missing_values' AS code,
  CASE WHEN missing_pct > 30 THEN 'HIGH PRIORITY' ELSE 'MEDIUM PRIORITY' END AS severity,
  "column", round(missing_pct, 4) AS value FROM missing WHERE missing_pct > 5
UNION ALL SELECT 10, 'recommendations', 'redundant_pairs', NULL, NULL, count(*)
  FROM pairs WHERE abs(r) > 0.9 HAVING count(*) > 0
UNION ALL SELECT 10, 'recommendations', 'data_quality', severity, coalesce("column", 'dataset'),
  round(value, 4) FROM flags WHERE rule IN ('duplicate_rows', 'outliers_iqr', 'skewness',
    'near_perfect_correlation', 'categorical_numeric_redundancy', 'high_cardinality',
    'rare_category', 'class_imbalance')
UNION ALL SELECT 10, 'recommendations', 'readiness_missing', NULL, NULL, round(total_pct, 4)
  FROM total WHERE total_pct > 10
UNION ALL SELECT 10, 'recommendations', 'readiness_blocked', NULL, NULL, round(total_pct, 4)
  FROM total WHERE (SELECT count(*) FROM flags WHERE severity IN ('BLOCKER', 'HIGH')) > 0
UNION ALL SELECT 10, 'recommendations', 'readiness_clean', NULL, NULL, round(total_pct, 4)
  FROM total WHERE (SELECT count(*) FROM flags) = 0 AND total_pct < 5"""


@query("recommendation_findings", f"WITH {_BASE} {RECOMMENDATIONS}")
def recommendation_findings(spark, sf):
    p = Profile(stress_events(spark, sf))
    rows = findings.recommendation_findings(p, quality.run_quality_rules(p))
    return _show(rows).drop("detail")


@query(
    "recommendation_redundancy",
    f"""WITH {_NET_BASE} SELECT 'redundant_pairs' AS code, CAST(count(*) AS DOUBLE) AS value,
  'worst VIF ' || printf('%.1f', 1 / (1 - pow(least(max(abs(r)), 0.9999), 2))) AS detail
FROM pairs WHERE abs(r) > 0.9 HAVING count(*) > 0""",
)
def recommendation_redundancy(spark, sf):
    p = Profile(lineitem_net(spark, sf), duplicates=0)
    rows = findings.recommendation_findings(p, quality.run_quality_rules(p, [quality.skewness]))
    return rows.filter("code = 'redundant_pairs'").select("code", "value", "detail")


LIMITATIONS = """SELECT 11 AS section_no, 'limitations' AS section,
  'univariate_and_bivariate_only' AS code, CAST(NULL AS VARCHAR) AS severity,
  CAST(NULL AS VARCHAR) AS "column", CAST(0 AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail
UNION ALL SELECT 11, 'limitations', 'over_20_pct_missing', NULL, "column", round(missing_pct, 4),
  NULL FROM missing WHERE missing_pct > 20
UNION ALL SELECT 11, 'limitations', 'no_temporal_validation', NULL, NULL, NULL, NULL
UNION ALL SELECT 11, 'limitations', 'outlier_flags_may_be_groups', NULL, NULL, count(*), NULL
  FROM flags WHERE rule = 'outliers_iqr' HAVING count(*) > 0
UNION ALL SELECT 11, 'limitations', 'few_rows', NULL, NULL, count(*), NULL FROM stress_events
  HAVING count(*) < 1000"""


@query("limitation_findings", f"WITH {_BASE} {LIMITATIONS}")
def limitation_findings(spark, sf):
    p = Profile(stress_events(spark, sf))
    return _show(findings.limitation_findings(p, quality.run_quality_rules(p)))


@query(
    "limitation_findings_signals",
    f"""WITH {ORDER_QUANTITIES}, {_MEDIANS}, signals AS ({PERSISTENCE} UNION ALL {TRAJECTORY})
SELECT code, value FROM (
  SELECT 'higher_order_interactions' AS code, CAST(count(DISTINCT (type, subject)) AS DOUBLE) AS value
  FROM signals HAVING count(*) > 0)
UNION ALL SELECT 'no_temporal_validation', NULL
UNION ALL SELECT 'over_20_pct_missing', round((1 - count(qty) / count(*)) * 100, 2) FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS qty FROM order_quantities" for c in QUANTITIES)})
GROUP BY name HAVING 1 - count(qty) / count(*) > 0.2
UNION ALL SELECT 'few_rows', count(*) FROM order_quantities HAVING count(*) < 1000""",
)
def limitation_findings_signals(spark, sf):
    df = order_quantities(spark, sf)
    target = classify_target(df, "large")
    p = Profile(df, target, duplicates=0)
    none = quality.run_quality_rules(p, [])
    signals = interact.interaction_signals(df, target)
    return findings.limitation_findings(p, none, signals).select("code", "value")


_SUMMARY = f"""vc AS ({counts_sql('stress_events', _CATEGORIES)}),
summary AS (
  SELECT list_position({_CATEGORIES}, "column") AS position, "column", count(*) AS cardinality,
    round(-sum(n / total * log2(n / total)), 4) AS entropy_bits,
    count(*) FILTER (n / total < 0.005) AS rare_count
  FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS total FROM vc) GROUP BY "column")"""


@query(
    "assemble_findings",
    f"""WITH {_BASE}, described AS ({describe_sql('stress_events', _NUMERIC)}), {SPREAD_SQL}, {_SUMMARY},
sizes AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM stress_events)) AS d
          FROM stress_events),
doubtful AS (SELECT "column" FROM flags WHERE rule = 'outliers_iqr' AND severity = 'LOW')
SELECT 1 AS section_no, 'overview' AS section, 'original_rows' AS code, NULL AS severity,
  NULL AS "column", CAST(n AS DOUBLE) AS value FROM sizes
UNION ALL SELECT 1, 'overview', 'n_columns', NULL, NULL, 5
UNION ALL SELECT 1, 'overview', 'n_numeric', NULL, NULL, {len(_NUMERIC)}
UNION ALL SELECT 1, 'overview', 'n_categorical', NULL, NULL, {len(_CATEGORIES)}
UNION ALL SELECT 1, 'overview', 'duplicate_count', NULL, NULL, n - d FROM sizes
UNION ALL SELECT 2, 'missing', 'missing_column', NULL, "column", missing_pct FROM missing WHERE missing > 0
UNION ALL SELECT 2, 'missing', 'missing_total', NULL, NULL, total_pct FROM total
UNION ALL SELECT 3, 'correlation', 'numeric_columns', NULL, NULL, {len(_NUMERIC)}
UNION ALL SELECT 4, 'statistics', 'numeric_columns', NULL, NULL, {len(_NUMERIC)}
UNION ALL SELECT 5, 'categorical', 'categorical_columns', NULL, NULL, {len(_CATEGORIES)}
UNION ALL SELECT 8, 'quality', CASE WHEN count(*) FILTER (severity IN ('BLOCKER', 'HIGH')) > 0
    THEN 'REVISION_NEEDED' ELSE 'APPROVED' END, NULL, NULL, count(*) FROM flags
UNION ALL SELECT * FROM (SELECT 3, 'correlation', 'strongest_pair', NULL, col_a || ' ~ ' || col_b,
  round(r, 4) FROM pairs ORDER BY abs(r) DESC LIMIT 1)
UNION ALL SELECT 4, 'statistics', 'high_cv', NULL, "column", round(cv, 4) FROM spread WHERE cv > 1
UNION ALL SELECT 4, 'statistics', 'zero_iqr', NULL, "column", iqr FROM spread WHERE iqr = 0
UNION ALL SELECT 4, 'statistics', CASE WHEN "column" IN (SELECT "column" FROM doubtful)
    THEN 'fences_unreliable' ELSE 'beyond_fences' END, NULL, "column",
  round(greatest(lower_fence - "min", "max" - upper_fence), 4)
  FROM spread WHERE iqr <> 0 AND ("min" < lower_fence OR "max" > upper_fence)
UNION ALL SELECT 5, 'categorical', 'high_cardinality', NULL, "column", cardinality FROM summary
  WHERE cardinality > 20
UNION ALL SELECT 5, 'categorical', 'binary', NULL, "column", cardinality FROM summary
  WHERE cardinality <= 2
UNION ALL SELECT 5, 'categorical', 'rare_levels', NULL, "column", rare_count FROM summary
  WHERE rare_count > 0
UNION ALL SELECT 5, 'categorical', 'highest_entropy', NULL,
  arg_max("column", (entropy_bits, -position)), max(entropy_bits) FROM summary
UNION ALL SELECT 5, 'categorical', 'lowest_entropy', NULL,
  arg_min("column", (entropy_bits, -position)), min(entropy_bits) FROM summary
UNION ALL SELECT 8, 'quality', rule, severity, "column", round(value, 4) FROM flags
UNION ALL SELECT section_no, section, code, severity, "column", value FROM ({CONCLUSIONS})
UNION ALL SELECT section_no, section, code, severity, "column", value FROM ({RECOMMENDATIONS})
UNION ALL SELECT section_no, section, code, severity, "column", value FROM ({LIMITATIONS})""",
)
def assemble_findings(spark, sf):
    """Without a target; the sections on associations and target stay away."""
    return _show(findings.assemble_findings(Profile(stress_events(spark, sf)))).drop("detail")


@query("assemble_findings_target")
def assemble_findings_target(spark, sf):
    """With a target: associations and signals are computed on demand."""
    df = labelled(spark, sf)
    p = Profile(df, classify_target(df, "quality"))
    return _show(findings.assemble_findings(p, key=["doc_id"]))


@query("fact_table")
def fact_table(spark, sf):
    """Every number of the other queries in one table; those have the SQL."""
    df = labelled(spark, sf)
    return _show(findings.fact_table(Profile(df, classify_target(df, "quality")), key=["doc_id"]))


@query("profile_flags", f"WITH {STRESS_EVENTS} {STRESS_RULES}")
def profile_flags(spark, sf):
    """Flags as the one-call profile gives them."""
    flags = profile(stress_events(spark, sf), no_target=True)["flags"]
    return rounded(flags, 6, "value").drop("message", "suggestion")


@query(
    "plot_missing",
    f'WITH {STRESS_EVENTS} SELECT position, "column", missing_pct FROM ({MISSING_SQL})',
)
def plot_missing(spark, sf):
    return plotdata.plot_data(stress_events(spark, sf), "missing")


@query(
    "plot_target_classes",
    f"""WITH {LABELLED} SELECT 'class' AS series, CAST(quality AS VARCHAR) AS label,
  CAST(NULL AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM labelled GROUP BY quality""",
)
def plot_target_classes(spark, sf):
    df = labelled(spark, sf)
    return plotdata.plot_data(df, "target", classify_target(df, "quality"))


@query(
    "plot_target_density",
    f"""WITH {histogram_sql('customer', ['c_acctbal'])},
s AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) AS std, min(c_acctbal) AS lo,
             max(c_acctbal) AS hi FROM customer),
grid AS (SELECT CAST(p AS INTEGER) AS point, lo + p * ((hi - lo) / 199) AS x,
                std * pow(n, -0.2) AS h, n FROM s CROSS JOIN range(0, 200) t(p))
SELECT 'histogram' AS series, CAST(bin AS VARCHAR) AS label, round(low, 4) AS x,
  CAST("count" AS DOUBLE) AS y FROM histogram
UNION ALL
SELECT 'density', CAST(point AS VARCHAR), round(any_value(x), 4),
  round(sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 10)
FROM grid CROSS JOIN customer GROUP BY point""",
)
def plot_target_density(spark, sf):
    df = table(spark, sf, "customer")
    rows = plotdata.plot_data(df, "target", classify_target(df, "c_acctbal"))
    return rounded(rounded(rows, 4, "x"), 10, "y")


_C_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(
    "plot_histogram",
    f"""WITH {histogram_sql('customer', _C_NUMERIC)}
SELECT "column", bin, round(low, 4) AS low, round(high, 4) AS high, "count" FROM histogram""",
)
def plot_histogram(spark, sf):
    df = table(spark, sf, "customer").select(*_C_NUMERIC, "c_mktsegment")
    return rounded(plotdata.plot_data(df, "histogram"), 4, "low", "high")


@query(
    "plot_correlation",
    f"""WITH {LINEITEM_NET}, pairs AS ({pairs_sql('lineitem_net', NET_NUMERIC)})
SELECT col_a, col_b, round(r, 4) AS r FROM pairs UNION ALL SELECT col_b, col_a, round(r, 4) FROM pairs
UNION ALL SELECT unnest({NET_NUMERIC}), unnest({NET_NUMERIC}), 1.0""",
)
def plot_correlation(spark, sf):
    return plotdata.plot_data(lineitem_net(spark, sf), "correlation")


@query(
    "plot_categorical",
    """WITH vc AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)
SELECT 'o_orderpriority' AS "column", row_number() OVER (ORDER BY n DESC, value) AS rank, value,
  n AS "count", round(n / sum(n) OVER () * 100, 2) AS pct, n / sum(n) OVER () < 0.005 AS is_rare
FROM vc""",
)
def plot_categorical(spark, sf):
    return plotdata.plot_data(table(spark, sf, "orders").select("o_orderpriority"), "categorical")


@query(
    "plot_associations",
    f"""WITH {RANKED} SELECT place, feature, mi_score, effect_size, effect_size_type
FROM associations""",
)
def plot_associations(spark, sf):
    df = labelled(spark, sf)
    target = classify_target(df, "quality")
    ranked = feature_associations(df, target, key=["doc_id"])
    rows = plotdata.plot_data(df, "associations", target, associations=ranked)
    return rounded(rows, 4, "mi_score")


