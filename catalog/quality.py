"""Quality rules, one by one and together."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.inputs import (
    LABELLED, LINEITEM_NET, MIXED_CATEGORIES, MIXED_ORDERS, NET_NUMERIC, SEGMENTS, SKEWED,
    STRESS_COLUMNS, STRESS_EVENTS, counts_sql, labelled, lineitem_net, mixed_orders, rounded,
    segments, skewed, stress_events, table, union_all,
)
from catalog.registry import query
from tabscope.operators import quality
from tabscope.operators.profile import Profile
from tabscope.operators.target import classify_target, detect_target

ODD_NUMERIC = ["event_id", "value", "fixed", "nearly_fixed", "mostly_zero"]
ODD_CATEGORIES = ["single", "event_type", "rare"]
ODD_COLUMNS = ["event_id", "value", "fixed", "nearly_fixed", "mostly_zero", *ODD_CATEGORIES]
ODD_EVENTS = """odd_events AS (
  SELECT event_id, value, 7.5::DOUBLE AS fixed, 10000 + user_id % 3 AS nearly_fixed,
    CASE WHEN event_id % 10 = 0 THEN value ELSE 0 END AS mostly_zero, 'A' AS single, event_type,
    CASE WHEN event_id % 400 = 0 THEN 'rare ' || event_id % 7 ELSE event_type END AS rare
  FROM events)"""


def odd_events(spark, sf):
    """Whole events with columns that each break a rule."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        "value",
        F.lit(7.5).alias("fixed"),
        (F.lit(10000) + F.col("user_id") % 3).alias("nearly_fixed"),
        F.when(e % 10 == 0, F.col("value")).otherwise(0.0).alias("mostly_zero"),
        F.lit("A").alias("single"),
        "event_type",
        F.when(e % 400 == 0, F.concat(F.lit("rare "), (e % 7).cast("string")))
        .otherwise(F.col("event_type"))
        .alias("rare"),
    )


def _rule(number: int, name: str, rows: str, order: str, column: str = '"column"') -> str:
    """Rows (column, severity, value, ...) as flags; a NULL severity is no flag."""
    return f"""SELECT {number} AS rule_no, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS seq,
  {column} AS "column", '{name}' AS rule, severity, round(CAST(value AS DOUBLE), 6) AS value
FROM ({rows}) WHERE severity IS NOT NULL"""


def missing_sql(rel, columns):
    rows = union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", 1 - count({c}) / count(*) AS value FROM {rel}"
            for i, c in enumerate(columns)
        ]
    )
    return _rule(
        1,
        "missing_values",
        "SELECT *, CASE WHEN value > 0.5 THEN 'BLOCKER' WHEN value > 0.3 THEN 'HIGH' "
        f"WHEN value > 0.05 THEN 'MEDIUM' END AS severity FROM (SELECT position, \"column\", "
        f"round(value, 12) AS value FROM ({rows}))",
        "value DESC, position",
    )


def dataset_sql(rel, columns):
    cells = " + ".join(f"count({c})" for c in columns)
    return _rule(
        2,
        "dataset_missingness",
        "SELECT value, CASE WHEN value > 0.3 THEN 'HIGH' END AS severity FROM "
        f"(SELECT 1 - ({cells}) / (count(*) * {len(columns)}) AS value FROM {rel})",
        "value",
        "NULL",
    )


def duplicates_sql(rel):
    return _rule(
        3,
        "duplicate_rows",
        "SELECT value, CASE WHEN value > 0.01 THEN 'HIGH' WHEN value > 0.001 THEN 'MEDIUM' END "
        f"AS severity FROM (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM {rel})) / count(*) "
        f"AS value FROM {rel})",
        "value",
        "NULL",
    )


def outliers_sql(rel, columns):
    rows = union_all(
        [
            f"""SELECT {i} AS position, '{c}' AS "column",
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}) AS value
FROM {rel}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {rel})
HAVING count({c}) >= 4 AND any_value(q3 - q1) <> 0"""
            for i, c in enumerate(columns)
        ]
    )
    return _rule(
        4,
        "outliers_iqr",
        "SELECT *, CASE WHEN value > 0.2 THEN 'LOW' WHEN value > 0.05 THEN 'MEDIUM' END AS severity "
        f"FROM (SELECT * FROM ({rows}) ORDER BY value DESC, position LIMIT 1)",
        "value",
    )


def skewness_sql(rel, columns):
    rows = union_all(
        [
            f"""SELECT {i} AS position, '{c}' AS "column", count(*) AS n_rows,
  CASE WHEN min({c}) = max({c}) THEN 0 ELSE abs(skewness({c})) END AS value FROM {rel}
HAVING count({c}) >= 3"""
            for i, c in enumerate(columns)
        ]
    )
    return _rule(
        5,
        "skewness",
        "SELECT *, CASE WHEN value > 2 AND n_rows >= 30 THEN 'HIGH' WHEN value > 1 THEN 'MEDIUM' END "
        f"AS severity FROM ({rows})",
        "value DESC, position",
    )


def _first(number, name, severity, rows, column='"column"'):
    return _rule(
        number,
        name,
        f"SELECT *, '{severity}' AS severity FROM (SELECT * FROM ({rows}) ORDER BY position LIMIT 1)",
        "position",
        column,
    )


def zero_variance_sql(rel, columns):
    return _first(6, "zero_variance", "HIGH", union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", 0 AS value FROM {rel} "
            f"HAVING count({c}) > 1 AND min({c}) = max({c})"
            for i, c in enumerate(columns)
        ]
    ))


def near_zero_variance_sql(rel, columns):
    return _first(7, "near_zero_variance", "LOW", union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", stddev_samp({c}) AS value FROM {rel} "
            f"HAVING min({c}) < max({c}) AND stddev_samp({c}) < 0.01 * abs(avg({c}))"
            for i, c in enumerate(columns)
        ]
    ))


def correlation_sql(rel, columns):
    rows = union_all(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, abs(corr({a}, {b})) AS value FROM {rel} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL "
            f"HAVING min({a}) < max({a}) AND min({b}) < max({b})"
            for a, b in combinations(columns, 2)
        ]
    )
    return _rule(
        8,
        "near_perfect_correlation",
        "SELECT *, CASE WHEN value > 0.95 THEN 'HIGH' WHEN value > 0.85 THEN 'MEDIUM' END AS severity "
        f"FROM ({rows})",
        "value DESC, col_a, col_b",
        "NULL",
    )


def redundancy_sql(rel, categories, numeric):
    rows = union_all(
        [
            f"""SELECT '{a}' AS cat, '{b}' AS num, round(between_ / (between_ + within), 6) AS value FROM (
  SELECT sum(n * pow(m - g, 2)) AS between_, sum(m2) AS within FROM (
    SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (
      SELECT count({b}) AS n, avg({b}) AS m, var_pop({b}) * count({b}) AS m2
      FROM {rel} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})))
WHERE between_ + within > 0 AND
  (SELECT count(DISTINCT {a}) BETWEEN 1 AND count(*) // 2 FROM {rel})"""
            for a in categories
            for b in numeric
        ]
    )
    return _rule(
        9,
        "categorical_numeric_redundancy",
        f"SELECT *, CASE WHEN value > 0.95 THEN 'HIGH' END AS severity FROM ({rows})",
        "value DESC, cat, num",
        "NULL",
    )


def unique_sql(rel, columns):
    return _first(10, "all_unique_column", "LOW", union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS value FROM {rel} "
            f"HAVING count(DISTINCT {c}) = count(*)"
            for i, c in enumerate(columns)
        ]
    ))


def single_sql(rel, categories):
    return _first(11, "single_value_categorical", "HIGH", union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", 1 AS value FROM {rel} "
            f"HAVING count(DISTINCT {c}) = 1"
            for i, c in enumerate(categories)
        ]
    ))


def cardinality_sql(rel, categories):
    rows = union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS value "
            f"FROM {rel}"
            for i, c in enumerate(categories)
        ]
    )
    return _rule(
        12,
        "high_cardinality",
        "SELECT *, CASE WHEN value = n THEN NULL WHEN value > 50 THEN 'HIGH' "
        f"WHEN value > 20 THEN 'MEDIUM' END AS severity FROM ({rows})",
        "value DESC, position",
    )


def rare_sql(rel, categories):
    place = f"list_position({categories}, \"column\")"
    return _rule(
        13,
        "rare_category",
        f"""SELECT "column", count(*) AS value, 'LOW' AS severity FROM (
  SELECT *, n / sum(n) OVER (PARTITION BY "column") AS part FROM ({counts_sql(rel, categories)}))
WHERE part < 0.005 AND (SELECT count(*) >= 100 FROM {rel}) GROUP BY "column" """,
        place,
    )


def all_rules_sql(rel, columns, numeric, categories):
    return union_all(
        [
            f"({s})"
            for s in (
                missing_sql(rel, columns),
                dataset_sql(rel, columns),
                duplicates_sql(rel),
                outliers_sql(rel, numeric),
                skewness_sql(rel, numeric),
                zero_variance_sql(rel, numeric),
                near_zero_variance_sql(rel, numeric),
                correlation_sql(rel, numeric),
                redundancy_sql(rel, categories, numeric),
                unique_sql(rel, columns),
                single_sql(rel, categories),
                cardinality_sql(rel, categories),
                rare_sql(rel, categories),
            )
        ]
    )


def show(flags):
    return rounded(flags, 6, "value").drop("message", "suggestion")


def _one(name, cte, sql, source, rule):
    number = quality.DEFAULT_RULES.index(rule) + 1

    @query(name, f"WITH {cte} {sql}")
    def run(spark, sf):
        flags = rule(Profile(source(spark, sf)))
        return show(flags.withColumn("rule_no", F.lit(number)))

    return run


_STRESS_NUMERIC = ["event_id", "user_id", "value"]
_STRESS_CATEGORIES = ["event_type", "props"]
_one("rule_missing_values", STRESS_EVENTS, missing_sql("stress_events", STRESS_COLUMNS),
     stress_events, quality.missing_values)
SPARSE_EVENTS = """sparse_events AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"""


def sparse_events(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.when(e % 2 == 0, F.col("event_type")).alias("event_type"),
        F.when(e % 3 != 0, F.col("value")).alias("value"),
    )


_one("rule_dataset_missingness", SPARSE_EVENTS, dataset_sql("sparse_events", ["event_type", "value"]),
     sparse_events, quality.dataset_missingness)
_one("rule_duplicate_rows", STRESS_EVENTS, duplicates_sql("stress_events"),
     stress_events, quality.duplicate_rows)
_one("rule_outliers_iqr", SKEWED, outliers_sql("skewed", ["value", "value_squared", "user_id"]),
     skewed, quality.outliers_iqr)
_one("rule_skewness", SKEWED, skewness_sql("skewed", ["value", "value_squared", "user_id"]),
     skewed, quality.skewness)
_one("rule_zero_variance", ODD_EVENTS, zero_variance_sql("odd_events", ODD_NUMERIC),
     odd_events, quality.zero_variance)
_one("rule_near_zero_variance", ODD_EVENTS, near_zero_variance_sql("odd_events", ODD_NUMERIC),
     odd_events, quality.near_zero_variance)
_one("rule_near_perfect_correlation", LINEITEM_NET, correlation_sql("lineitem_net", NET_NUMERIC),
     lineitem_net, quality.near_perfect_correlation)
_one("rule_categorical_numeric_redundancy", SEGMENTS,
     redundancy_sql("segments", ["c_mktsegment"],
                    ["c_custkey", "c_nationkey", "c_acctbal", "segment_no"]),
     segments, quality.categorical_numeric_redundancy)
_one("rule_all_unique_column", ODD_EVENTS, unique_sql("odd_events", ODD_COLUMNS),
     odd_events, quality.all_unique_column)
_one("rule_single_value_categorical", ODD_EVENTS, single_sql("odd_events", ODD_CATEGORIES),
     odd_events, quality.single_value_categorical)
_one("rule_high_cardinality", MIXED_ORDERS, cardinality_sql("mixed_orders", MIXED_CATEGORIES),
     mixed_orders, quality.high_cardinality)
_one("rule_rare_category", ODD_EVENTS, rare_sql("odd_events", ODD_CATEGORIES),
     odd_events, quality.rare_category)


@query(
    "rule_class_imbalance",
    f"""WITH {LABELLED}, c AS (SELECT count(*) AS n FROM labelled GROUP BY quality),
t AS (SELECT count(*) AS n FROM labels GROUP BY toxic)
SELECT 'named' AS source, 1 AS place, 'quality' AS "column", 'class_imbalance' AS rule,
  CASE WHEN round(max(n) / min(n), 2) > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  round(max(n) / min(n), 2) AS value FROM c HAVING round(max(n) / min(n), 2) > 3
UNION ALL SELECT 'found', 1, 'toxic', 'class_imbalance', 'LOW', 0
UNION ALL SELECT 'found', 2, 'toxic', 'class_imbalance',
  CASE WHEN round(max(n) / min(n), 2) > 10 THEN 'HIGH' ELSE 'MEDIUM' END,
  round(max(n) / min(n), 2) FROM t HAVING round(max(n) / min(n), 2) > 3
UNION ALL SELECT 'skewed', 1, 'value_squared', 'class_imbalance', 'MEDIUM',
  round(abs(skewness(value * value)), 6) FROM events HAVING abs(skewness(value * value)) > 2""",
)
def rule_class_imbalance(spark, sf):
    """A named target, one found by its place, and a skewed numeric one."""
    named, labels, long_tail = labelled(spark, sf), table(spark, sf, "labels"), skewed(spark, sf)
    cases = [
        ("named", Profile(named, classify_target(named, "quality"))),
        ("found", Profile(labels, detect_target(labels))),
        ("skewed", Profile(long_tail, classify_target(long_tail, "value_squared"))),
    ]
    out = None
    for source, p in cases:
        flags = quality.class_imbalance(p).withColumn("source", F.lit(source))
        out = flags if out is None else out.unionByName(flags)
    return show(out).withColumnRenamed("seq", "place").drop("rule_no")


@query(
    "unreliability_hint",
    f"""WITH {SKEWED}, {LINEITEM_NET}
SELECT name AS "column", CASE WHEN n < 8 THEN 'unclear' WHEN k < 0 THEN 'platykurtic'
  WHEN abs(g) > 1 THEN 'heavy_tail' WHEN k > 0 THEN 'central_spike' ELSE 'unreliable' END AS hint
FROM (SELECT 'value_squared' AS name, count(*) AS n, skewness(value_squared) AS g,
             kurtosis(value_squared) AS k FROM skewed
      UNION ALL SELECT 'value', count(*), skewness(value), kurtosis(value) FROM skewed
      UNION ALL SELECT 'user_id', count(*), skewness(user_id), kurtosis(user_id) FROM skewed)""",
)
def unreliability_hint(spark, sf):
    shape = Profile(skewed(spark, sf)).described
    hint = quality.unreliability_hint(F.col("count"), F.col("skewness"), F.col("kurtosis"))
    return shape.select("column", hint.alias("hint"))


STRESS_RULES = all_rules_sql("stress_events", STRESS_COLUMNS, _STRESS_NUMERIC, _STRESS_CATEGORIES)
ODD_RULES = all_rules_sql("odd_events", ODD_COLUMNS, ODD_NUMERIC, ODD_CATEGORIES)


@query("run_quality_rules", f"WITH {STRESS_EVENTS} {STRESS_RULES}")
def run_quality_rules(spark, sf):
    return show(quality.run_quality_rules(Profile(stress_events(spark, sf))))


@query("run_quality_rules_odd", f"WITH {ODD_EVENTS} {ODD_RULES}")
def run_quality_rules_odd(spark, sf):
    return show(quality.run_quality_rules(Profile(odd_events(spark, sf))))


@query(
    "quality_status",
    f"""WITH {STRESS_EVENTS}, {ODD_EVENTS}, flags AS (
  SELECT 'stress' AS name, severity FROM ({STRESS_RULES})
  UNION ALL SELECT 'odd', severity FROM ({ODD_RULES}))
SELECT name, CASE WHEN count(*) FILTER (severity IN ('BLOCKER', 'HIGH')) > 0
                  THEN 'REVISION_NEEDED' ELSE 'APPROVED' END AS status, count(*) AS flags,
  count(*) FILTER (severity IN ('BLOCKER', 'HIGH')) AS blocking_flags FROM flags GROUP BY name""",
)
def quality_status(spark, sf):
    out = None
    for name, df in (("stress", stress_events(spark, sf)), ("odd", odd_events(spark, sf))):
        status = quality.quality_status(quality.run_quality_rules(Profile(df)))
        status = status.withColumn("name", F.lit(name))
        out = status if out is None else out.unionByName(status)
    return out


@query(
    "unresolved_flags",
    f"WITH {ODD_EVENTS} SELECT * FROM ({ODD_RULES}) WHERE severity IN ('BLOCKER', 'HIGH')",
)
def unresolved_flags(spark, sf):
    flags = quality.run_quality_rules(Profile(odd_events(spark, sf)))
    return show(quality.unresolved_flags(flags))


@query(
    "register_rule",
    f"""WITH {STRESS_EVENTS}
SELECT 15 AS rule_no, 1 AS seq, 'value' AS "column", 'large_values' AS rule, 'LOW' AS severity,
  CAST(count(*) AS DOUBLE) AS value FROM stress_events WHERE value > 200
HAVING count(*) > 0""",
)
def register_rule(spark, sf):
    """A rule of one's own next to the built-in ones."""

    def large_values(p):
        counted = p.df.filter(F.col("value") > 200).agg(F.count("*").alias("n")).filter("n > 0")
        return counted.select(
            F.lit(0).alias("rule_no"),
            F.lit(1).alias("seq"),
            F.lit("value").alias("column"),
            F.lit("large_values").alias("rule"),
            F.lit("LOW").alias("severity"),
            F.lit("large values").alias("message"),
            F.col("n").cast("double").alias("value"),
            F.lit("").alias("suggestion"),
        )

    quality.register_rule(large_values)
    try:
        flags = quality.run_quality_rules(Profile(stress_events(spark, sf)))
    finally:
        quality.unregister_rule(large_values)
    return show(flags.filter("rule = 'large_values'"))
