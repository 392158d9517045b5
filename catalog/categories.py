"""Categorical inventories and target rates."""

from __future__ import annotations

from catalog.inputs import (
    MIXED_CATEGORIES, MIXED_ORDERS, SEGMENTS, counts_sql, long_sql, mixed_orders, rounded, segments,
)
from catalog.registry import query
from tabscope.operators import categorical
from tabscope.plans.counts import value_counts as count_values

VC = f"{MIXED_ORDERS}, vc AS ({counts_sql('mixed_orders', MIXED_CATEGORIES)})"
TOTALS = 'totals AS (SELECT "column", sum(n) AS total FROM vc GROUP BY "column")'
TOP = """top AS (
  SELECT * FROM (SELECT "column", value, n,
    row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM vc)
  WHERE rank <= 10)"""


@query("value_counts", f'WITH {VC} SELECT "column", value, n AS "count" FROM vc')
def value_counts(spark, sf):
    return count_values(mixed_orders(spark, sf))


@query(
    "top_values",
    f"""WITH {VC}, {TOTALS}, {TOP}
SELECT "column", rank, value, n AS "count", round(n / total * 100, 2) AS pct,
       n / total < 0.005 AS is_rare FROM top JOIN totals USING ("column")""",
)
def top_values(spark, sf):
    return categorical.top_values(mixed_orders(spark, sf))


SUMMARY = f"""summary AS (
  SELECT list_position({MIXED_CATEGORIES}, "column") AS position, "column",
         CAST(sum(n) AS BIGINT) AS "count", count(*) AS cardinality,
         round(-sum(n / total * log2(n / total)), 4) AS entropy_bits,
         count(*) FILTER (n / total < 0.005) AS rare_count
  FROM vc JOIN totals USING ("column") GROUP BY "column")"""


@query(
    "categorical_summary",
    f"""WITH {VC}, {TOTALS}, {SUMMARY}
SELECT "column", "count", cardinality, entropy_bits, rare_count,
       greatest(cardinality - 10, 0) AS more_values FROM summary""",
)
def categorical_summary(spark, sf):
    return categorical.categorical_summary(mixed_orders(spark, sf)).drop("position")


_TARGET = "l_returnflag"
RATES = f"""cells AS (
  SELECT "column", value, class, count(*) AS class_count FROM (
    {long_sql('(SELECT *, l_returnflag AS class FROM mixed_orders)', MIXED_CATEGORIES, 'class')})
  WHERE class IS NOT NULL GROUP BY ALL),
rates AS (
  SELECT "column", rank, value, n, class, class_count,
         round(class_count / sum(class_count) OVER (PARTITION BY "column", value) * 100, 2) AS rate
  FROM cells JOIN top USING ("column", value))"""


def _rates(spark, sf):
    return categorical.target_rates(mixed_orders(spark, sf), _TARGET)


@query(
    "target_rates",
    f"""WITH {VC}, {TOP}, {RATES}
SELECT "column", rank, value, n AS "count", class, class_count, rate FROM rates""",
)
def target_rates(spark, sf):
    return _rates(spark, sf)


@query(
    "rate_reliability",
    f"""WITH {SEGMENTS}, vc AS ({counts_sql('segments', ['c_nationkey', 'c_mktsegment'])}), {TOP}
SELECT "column", value, n AS "count",
       round_even(1.96 * sqrt(CAST(0.25 AS DOUBLE) / n) * 100, 0) AS margin_pp,
       CASE WHEN n < 30 THEN 'VERY_LOW_N' ELSE 'LOW_N' END AS level
FROM top WHERE n < 100""",
)
def rate_reliability(spark, sf):
    values = categorical.top_values(segments(spark, sf), ["c_nationkey", "c_mktsegment"])
    return categorical.rate_reliability(values)


@query(
    "anomalous_rates",
    f"""WITH {VC}, {TOP}, {RATES},
covered AS (SELECT "column", sum(n) AS covered FROM (
  SELECT DISTINCT "column", value, n FROM rates) GROUP BY "column"),
overall AS (SELECT "column", class, sum(rate * n) / any_value(covered) AS column_rate
            FROM rates JOIN covered USING ("column") GROUP BY "column", class)
SELECT "column", value, class, n AS "count", rate, round(column_rate, 6) AS column_rate,
       round(rate / column_rate, 6) AS ratio
FROM rates JOIN overall USING ("column", class)
WHERE n >= 50 AND column_rate > 0 AND (rate > column_rate * 2 OR rate < column_rate * 0.5)""",
)
def anomalous_rates(spark, sf):
    return rounded(categorical.anomalous_rates(_rates(spark, sf)), 6, "column_rate", "ratio")


CHOSEN = f"""leaders AS (
  SELECT "column", arg_min(class, (rank, -class_count, class)) AS first_class
  FROM rates WHERE "column" <> 'l_returnflag' GROUP BY "column"),
per_value AS (
  SELECT "column", first_class, value,
         coalesce(max(CASE WHEN class = first_class THEN rate END), 0) AS rate
  FROM rates JOIN leaders USING ("column") GROUP BY "column", first_class, value),
chosen AS (
  SELECT * FROM (
    SELECT "column", first_class, max(rate) - min(rate) AS spread, max(rate) AS max_rate,
           row_number() OVER (ORDER BY round(max(rate) - min(rate), 9) DESC,
                              list_position({MIXED_CATEGORIES}, "column")) AS place
    FROM per_value GROUP BY "column", first_class) WHERE place <= 3)"""


def _chosen(rates, spark, sf):
    return categorical.discriminative_columns(rates, MIXED_CATEGORIES, _TARGET)


@query(
    "discriminative_columns",
    f"""WITH {VC}, {TOP}, {RATES}, {CHOSEN}
SELECT place, "column", first_class, round(spread, 6) AS spread, max_rate FROM chosen""",
)
def discriminative_columns(spark, sf):
    return rounded(_chosen(_rates(spark, sf), spark, sf), 6, "spread")


@query(
    "discriminative_values",
    f"""WITH {VC}, {TOP}, {RATES}, {CHOSEN}
SELECT place, "column", rank, value, class, rate
FROM rates JOIN chosen USING ("column") WHERE rank <= 5""",
)
def discriminative_values(spark, sf):
    rates = _rates(spark, sf)
    return categorical.discriminative_values(rates, _chosen(rates, spark, sf))


@query(
    "cardinality_bands",
    f"""WITH {VC}, {TOTALS}, {SUMMARY}
SELECT 'high_cardinality' AS band, "column", CAST(cardinality AS DOUBLE) AS value
FROM summary WHERE cardinality > 20
UNION ALL SELECT 'binary', "column", cardinality FROM summary WHERE cardinality <= 2
UNION ALL SELECT 'rare_levels', "column", rare_count FROM summary WHERE rare_count > 0
UNION ALL SELECT 'highest_entropy', arg_max("column", (entropy_bits, -position)),
                 max(entropy_bits) FROM summary
UNION ALL SELECT 'lowest_entropy', arg_min("column", (entropy_bits, -position)),
                 min(entropy_bits) FROM summary""",
)
def cardinality_bands(spark, sf):
    return categorical.cardinality_bands(categorical.categorical_summary(mixed_orders(spark, sf)))
