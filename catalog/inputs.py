"""Inputs of the queries, built alike in Spark and in SQL.

The given tables hold no missing values and no copies. ``stress_events`` adds both to the whole
events table: values are blanked by a rule and some rows are repeated; nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem_net(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        "l_returnflag",
        "l_linestatus",
    )


NET_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price"]
LINEITEM_NET = """lineitem_net AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * (1 - l_discount) AS net_price, l_returnflag, l_linestatus
  FROM lineitem)"""


def stress_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    blanked = e.select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 20 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        "props",
    )
    return blanked.unionAll(blanked.filter(F.col("event_id") % 50 == 0))


STRESS_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]
STRESS_EVENTS = """blanked AS (
  SELECT event_id, user_id,
         CASE WHEN event_id % 20 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 3 <> 0 THEN value END AS value, props
  FROM events),
stress_events AS (
  SELECT * FROM blanked UNION ALL SELECT * FROM blanked WHERE event_id % 50 = 0)"""


def skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Event values and their squares: columns with long tails."""
    return table(spark, sf, "events").select(
        "value", (F.col("value") * F.col("value")).alias("value_squared"), "user_id"
    )


SKEWED = """skewed AS (
  SELECT value, value * value AS value_squared, user_id FROM events)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "quality", "toxic", "lang", "source", "n_chars"
    )


LABELLED = """labelled AS (
  SELECT doc_id, quality, toxic, lang, source, n_chars
  FROM labels JOIN documents USING (doc_id))"""


def order_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with lines: quantity per line number, and whether it is a large order."""
    lines = table(spark, sf, "lineitem")
    wide = lines.groupBy("l_orderkey").agg(
        *[
            F.sum(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"qty_{i}")
            for i in range(1, 8)
        ],
        F.when(F.sum("l_quantity") > 100, 1).otherwise(0).alias("large"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return wide.join(orders, wide["l_orderkey"] == orders["o_orderkey"]).drop("l_orderkey")


QUANTITIES = [f"qty_{i}" for i in range(1, 8)]
ORDER_QUANTITIES = (
    "order_quantities AS (\n  SELECT "
    + ", ".join(
        f"sum(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS qty_{i}" for i in range(1, 8)
    )
    + """,
         CASE WHEN sum(l_quantity) > 100 THEN 1 ELSE 0 END AS large,
         o_orderkey, any_value(o_totalprice) AS o_totalprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""
)


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a number that stands for their market segment."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", code.cast("int").alias("segment_no")
    )


SEGMENTS = """segments AS (
  SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
         CAST(coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD',
                                      'MACHINERY'], c_mktsegment), 0) AS INTEGER) AS segment_no
  FROM customer)"""


def mixed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their order and part: categories of every size next to numbers."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_returnflag",
            "l_linestatus",
            "o_orderstatus",
            "o_orderpriority",
            "p_brand",
            "p_type",
            "p_name",
            "l_quantity",
        )
    )


MIXED_CATEGORIES = [
    "l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "p_brand", "p_type", "p_name",
]
MIXED_ORDERS = """mixed_orders AS (
  SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, p_brand, p_type, p_name,
         l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(relation: str, columns: list[str], select: str, extra: str = "") -> str:
    """The same SELECT for every column: ``{c}`` is the column, ``{i}`` its place."""
    return union_all(
        [
            f"SELECT {select.format(c=c, i=i)} FROM {relation} {extra.format(c=c, i=i)}"
            for i, c in enumerate(columns, start=1)
        ]
    )


def long_sql(relation: str, columns: list[str], *keep: str) -> str:
    """(keep..., column, value as text), NULL values left out."""
    kept = "".join(f"{k}, " for k in keep)
    return union_all(
        [
            f"SELECT {kept}'{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {relation} "
            f"WHERE {c} IS NOT NULL"
            for c in columns
        ]
    )


def counts_sql(relation: str, columns: list[str]) -> str:
    return (
        'SELECT "column", value, count(*) AS n FROM (\n'
        + long_sql(relation, columns)
        + '\n) GROUP BY "column", value'
    )
