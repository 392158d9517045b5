"""Kinds, duplicates, missing values, encodings, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import STRESS_EVENTS, counts_sql, rounded, stress_events, table
from catalog.registry import query
from tabscope.operators import cleaning
from tabscope.plans.counts import value_counts
from tabscope.plans.kinds import column_kinds as kinds_of


@query(
    "column_kinds",
    """SELECT CAST(list_position((SELECT list(column_name) FROM (DESCRIBE lineitem)), column_name) AS INTEGER) AS position, column_name AS "column",
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END AS dtype,
  CASE WHEN column_name = 'l_linenumber' OR column_type = 'VARCHAR' THEN 'categorical'
       WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'datetime' END AS kind,
  column_name = 'l_linenumber' AS encoded, n_values
FROM (DESCRIBE lineitem) JOIN
  (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE n_values)
  USING (column_name)""",
)
def column_kinds(spark, sf):
    lines = table(spark, sf, "lineitem")
    kinds = kinds_of(lines, encoded=["l_linenumber"])
    counts = lines.agg(*[F.count(c).alias(c) for c in lines.columns])
    present = counts.unpivot([], lines.columns, "column", "n_values")
    return kinds.withColumn("dtype", F.regexp_replace("dtype", "timestamp.*", "timestamp")).join(present, "column")


@query("drop_duplicate_rows", f"WITH {STRESS_EVENTS} SELECT DISTINCT * FROM stress_events")
def drop_duplicate_rows(spark, sf):
    return cleaning.drop_duplicate_rows(stress_events(spark, sf))


@query(
    "duplicate_summary",
    f"""WITH {STRESS_EVENTS}, d AS (SELECT DISTINCT * FROM stress_events)
SELECT (SELECT count(*) FROM stress_events) AS n_rows, count(*) AS distinct_rows,
  (SELECT count(*) FROM stress_events) - count(*) AS duplicate_count,
  round(1 - count(*) / (SELECT count(*) FROM stress_events), 6) AS duplicate_share FROM d""",
)
def duplicate_summary(spark, sf):
    return rounded(cleaning.duplicate_summary(stress_events(spark, sf)), 6, "duplicate_share")


@query(
    "normalise_missing",
    "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN value END AS value FROM events",
)
def normalise_missing(spark, sf):
    """Not-a-number and infinities planted in whole events."""
    k = F.col("event_id") % 7
    bad = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf")))
    df = table(spark, sf, "events").select("event_id", bad.otherwise(F.col("value")).alias("value"))
    return cleaning.normalise_missing(df)


@query(
    "stringify_nested",
    "SELECT doc_id, CAST(to_json({'lang': lang, 'source': source}) AS VARCHAR) AS meta FROM documents",
)
def stringify_nested(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.struct("lang", "source").alias("meta"))
    return cleaning.stringify_nested(docs)


@query("reclassify_columns", counts_sql("lineitem", ["l_linenumber", "l_quantity", "l_discount"])
       .replace("CAST(l_quantity AS VARCHAR)", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)")
       .replace("count(*) AS n", 'count(*) AS "count"'))
def reclassify_columns(spark, sf):
    names = ["l_linenumber", "l_quantity", "l_discount"]
    text = cleaning.reclassify_columns(table(spark, sf, "lineitem").select(*names), names)
    return value_counts(text)


@query(
    "coerce_numeric",
    "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_acctbal END AS mixed FROM customer",
)
def coerce_numeric(spark, sf):
    mixed = F.when(F.col("c_nationkey") < 12, F.col("c_acctbal").cast("string"))
    df = table(spark, sf, "customer").select("c_custkey", mixed.otherwise(F.col("c_name")).alias("mixed"))
    return cleaning.coerce_numeric(df, ["mixed"])


@query(
    "dataset_profile",
    f"""WITH {STRESS_EVENTS}
SELECT count(*) AS n_rows, 5 AS n_columns,
  round(sum(24 + coalesce(strlen(event_type), 0) + coalesce(strlen(props), 0)) / 1e6, 3) AS memory_mb,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM stress_events)) AS duplicate_count,
  'event_id:bigint,event_type:string,props:string,user_id:bigint,value:double' AS dtypes
FROM stress_events""",
)
def dataset_profile(spark, sf):
    entries = F.sort_array(F.map_entries("dtypes"))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return cleaning.dataset_profile(stress_events(spark, sf)).withColumn(
        "dtypes", F.array_join(text, ",")
    )


@query(
    "complete_cases",
    f"WITH {STRESS_EVENTS} SELECT * FROM stress_events "
    "WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def complete_cases(spark, sf):
    return cleaning.complete_cases(stress_events(spark, sf), ["event_type", "value"])


@query(
    "retained_fraction",
    f"""WITH {STRESS_EVENTS} SELECT count(*) AS n_rows,
  count(*) FILTER (event_type IS NOT NULL AND value IS NOT NULL) AS n_complete,
  round(count(*) FILTER (event_type IS NOT NULL AND value IS NOT NULL) / count(*), 6) AS retained
FROM stress_events""",
)
def retained_fraction(spark, sf):
    return rounded(cleaning.retained_fraction(stress_events(spark, sf)), 6, "retained")


@query(
    "missingness_strategy_imputed",
    f"""WITH {STRESS_EVENTS}
SELECT user_id, round(coalesce(value, (SELECT avg(value) FROM stress_events)), 6) AS value,
  coalesce(event_type, '__MISSING__') AS event_type, props,
  'imputed (__MISSING__+mean): N=' || format('{{:,}}', (SELECT count(*) FROM stress_events))
    || ', 100.0% retained' AS strategy
FROM stress_events""",
)
def missingness_strategy_imputed(spark, sf):
    rows, strategy = cleaning.apply_missingness_strategy(
        stress_events(spark, sf), "props", ["user_id", "value", "event_type"]
    )
    out = rounded(rows.withColumn("strategy", F.lit(strategy)), 6, "value")
    return out.withColumn("user_id", F.col("user_id").cast("long"))


@query(
    "missingness_strategy_complete",
    f"""WITH {STRESS_EVENTS}, kept AS (
  SELECT user_id, props, event_type FROM stress_events WHERE event_type IS NOT NULL)
SELECT kept.*, 'complete-case: N=' || format('{{:,}}', (SELECT count(*) FROM kept)) || ', '
  || printf('%.1f', (SELECT count(*) FROM kept) / (SELECT count(*) FROM stress_events) * 100)
  || '% retained' AS strategy FROM kept""",
)
def missingness_strategy_complete(spark, sf):
    rows, strategy = cleaning.apply_missingness_strategy(
        stress_events(spark, sf), "event_type", ["user_id", "props"]
    )
    return rows.withColumn("strategy", F.lit(strategy))


@query(
    "fill_categorical_missing",
    f"""WITH {STRESS_EVENTS}
SELECT coalesce(event_type, '__MISSING__') AS event_type, count(*) AS n, count(value) AS with_value
FROM stress_events GROUP BY 1""",
)
def fill_categorical_missing(spark, sf):
    filled = cleaning.fill_categorical_missing(stress_events(spark, sf))
    return filled.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("value").alias("with_value")
    )


@query(
    "label_encode",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority,
  dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus FROM orders""",
)
def label_encode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return cleaning.label_encode(df, ["o_orderpriority", "o_orderstatus"])


@query(
    "median_fill",
    f"""WITH {STRESS_EVENTS}
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM stress_events)), 6) AS value
FROM stress_events""",
)
def median_fill(spark, sf):
    df = stress_events(spark, sf).select("event_id", "value")
    return rounded(cleaning.median_fill(df, ["value"]), 6, "value")


KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEY_TEXT = "concat_ws('|', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
SAMPLE_N = 5000


@query(
    "stratified_sample",
    f"""WITH sizes AS (
  SELECT l_returnflag, count(*) AS size, count(*) * {SAMPLE_N} / (SELECT count(*) FROM lineitem)
         AS exact FROM lineitem GROUP BY 1),
quotas AS (
  SELECT l_returnflag, floor(exact) + CASE WHEN
    row_number() OVER (ORDER BY exact - floor(exact) DESC, l_returnflag)
      <= {SAMPLE_N} - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM sizes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5({_KEY_TEXT})) AS place
  FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag
FROM ranked JOIN quotas USING (l_returnflag) WHERE place <= quota""",
)
def stratified_sample(spark, sf):
    rows = cleaning.stratified_sample(table(spark, sf, "lineitem"), "l_returnflag", SAMPLE_N, KEY)
    return rows.select(*KEY, "l_returnflag")


@query(
    "uniform_sample",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (
  SELECT *, row_number() OVER (ORDER BY md5({_KEY_TEXT})) AS place FROM lineitem)
WHERE place <= {SAMPLE_N}""",
)
def uniform_sample(spark, sf):
    rows = cleaning.stratified_sample(table(spark, sf, "lineitem"), None, SAMPLE_N, KEY)
    return rows.select(*KEY)


