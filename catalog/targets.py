"""Target detection, target analysis and binarised targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    LABELLED, LINEITEM_NET, NET_NUMERIC, labelled, lineitem_net, per_column, rounded, table, union_all,
)
from catalog.registry import query
from tabscope.operators import target as tg
from tabscope.operators import target_analysis as ta


def _class_sql(relation: str, column: str, method: str, has_time: str) -> str:
    """A classification target as ``target_table`` gives it, classes as 'value=count' text."""
    return f"""SELECT '{column}' AS "column", 'classification' AS problem_type,
  count(*) AS n_classes, round(max(n) / min(n), 2) AS imbalance_ratio,
  '{method}' AS detection_method, {has_time} AS has_datetime_index,
  string_agg(v || '=' || n, ',' ORDER BY v) AS classes
FROM (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {relation}
      WHERE {column} IS NOT NULL GROUP BY 1)"""


def _show(df, target):
    rows = tg.target_table(df, target)
    text = F.concat("class", F.lit("="), F.col("class_count").cast("string"))
    kept = [c for c in rows.columns if c not in ("class", "class_count")]
    classes = F.array_join(F.sort_array(F.collect_list(text)), ",")
    return rows.groupBy(*kept).agg(classes.alias("classes"))


_REGRESSION = """SELECT 'o_totalprice' AS "column",
  CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'regression' ELSE 'classification' END
    AS problem_type, 0 AS n_classes, 1.0 AS imbalance_ratio, 'explicit' AS detection_method,
  true AS has_datetime_index, '' AS classes FROM orders"""


@query(
    "resolve_target",
    f"{_REGRESSION} UNION ALL {_class_sql('orders', 'o_orderstatus', 'explicit', 'true')} "
    f"UNION ALL {_class_sql('labels', 'quality', 'explicit', 'false')}",
)
def resolve_target(spark, sf):
    orders, labels = table(spark, sf, "orders"), table(spark, sf, "labels")
    return (
        _show(orders, tg.resolve_target(orders, "o_totalprice"))
        .unionByName(_show(orders, tg.resolve_target(orders, "o_orderstatus")))
        .unionByName(_show(labels, tg.resolve_target(labels, "quality")))
    )


@query(
    "target_of_many_classes",
    """SELECT 'buyer' AS "column", 'classification' AS problem_type,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS n_classes,
  (SELECT round(max(n) / min(n), 2) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))
    AS imbalance_ratio, 'explicit' AS detection_method, false AS has_datetime_index,
  'c' || o_custkey AS class, count(*) AS class_count
FROM orders GROUP BY o_custkey""",
)
def target_of_many_classes(spark, sf):
    """Every class has its row, however many there are."""
    buyers = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("buyer"), "o_totalprice"
    )
    return tg.target_table(buyers, tg.classify_target(buyers, "buyer"))


@query(
    "text_dates",
    """SELECT count(*) AS n, true AS all_parse, false AS one_bad FROM orders""",
)
def text_dates(spark, sf):
    """Text dates of which all parse, and the same with one bad value, wherever it stands."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    good = orders.select("o_orderkey", day.alias("order_date"))
    bad = good.withColumn("order_date", F.when(F.col("o_orderkey") != last, F.col("order_date")).otherwise("soon"))
    return orders.agg(F.count("*").alias("n")).select(
        "n",
        F.lit(tg.has_datetime_column(good)).alias("all_parse"),
        F.lit(tg.has_datetime_column(bad)).alias("one_bad"),
    )


@query(
    "detect_target",
    f"""{_class_sql('embeddings', 'label', 'name_heuristic', 'false')}
UNION ALL {_class_sql('labels', 'toxic', 'position_heuristic', 'false')}
UNION ALL {_class_sql('part', 'p_type', 'position_heuristic', 'false')}""",
)
def detect_target(spark, sf):
    parts = []
    for name in ("embeddings", "labels", "part"):
        df = table(spark, sf, name)
        parts.append(_show(df, tg.detect_target(df)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PROFILED = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_suppkey"]
_DTYPES = {"l_linenumber": "int", "l_suppkey": "bigint"}
_PROFILES = union_all(
    [
        f"""SELECT '{c}' AS "column", '{_DTYPES.get(c, 'double')}' AS dtype,
  count(DISTINCT {c}) AS nunique, count(*) AS n_rows,
  array_to_string(list_slice(list_sort(list_distinct(list(CAST({c} AS DOUBLE)))), 1, 15), ',')
    AS sample_values,
  CAST(min({c}) AS DOUBLE) AS min_val, CAST(max({c}) AS DOUBLE) AS max_val,
  bool_and({c} = floor({c})) AS is_all_integer FROM lineitem"""
        for c in _PROFILED
    ]
)


def _profiles(spark, sf):
    df = table(spark, sf, "lineitem").select(*_PROFILED)
    return tg.low_cardinality_profiles(df)


def _sample_text(df):
    return df.withColumn("sample_values", F.array_join(F.col("sample_values").cast("array<string>"), ","))


@query("low_cardinality_profiles", f"SELECT * FROM ({_PROFILES}) WHERE nunique <= 30")
def low_cardinality_profiles(spark, sf):
    return _sample_text(_profiles(spark, sf))


@query(
    "match_encoded_suspects",
    f"""SELECT p.*, s.reason, coalesce(s.subtype, 'nominal') AS subtype
FROM (SELECT * FROM ({_PROFILES}) WHERE nunique <= 30) p JOIN
     (VALUES ('l_linenumber', 'small whole numbers', 'ordinal'), ('l_tax', 'few rates', NULL),
             ('no_such_column', 'made up', 'nominal')) s("column", reason, subtype)
USING ("column")""",
)
def match_encoded_suspects(spark, sf):
    suspects = spark.createDataFrame(
        [
            ("l_linenumber", "small whole numbers", "ordinal"),
            ("l_tax", "few rates", None),
            ("no_such_column", "made up", "nominal"),
        ],
        "column string, reason string, subtype string",
    )
    return _sample_text(tg.match_encoded_suspects(_profiles(spark, sf), suspects))


_BINARY = """SELECT 'o_totalprice' AS target, o_orderpriority AS part,
  count(*) AS n, CAST(sum(CASE WHEN o_totalprice >= m THEN 1 ELSE 0 END) AS DOUBLE) AS positives
FROM orders, (SELECT median(o_totalprice) AS m FROM orders) GROUP BY ALL
UNION ALL
SELECT 'l_returnflag', l_linestatus, count(*),
  CAST(sum(CASE WHEN l_returnflag = m THEN 1 ELSE 0 END) AS DOUBLE)
FROM lineitem, (SELECT l_returnflag AS m FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
GROUP BY ALL
UNION ALL
SELECT 'l_linestatus', l_returnflag, count(*),
  CAST(sum(CASE WHEN l_linestatus = m THEN 1 ELSE 0 END) AS DOUBLE)
FROM lineitem, (SELECT l_linestatus AS m FROM lineitem GROUP BY 1
                ORDER BY count(*), 1 DESC LIMIT 1) GROUP BY ALL"""


@query("binarise_target", _BINARY)
def binarise_target(spark, sf):
    """Median split, most common of three classes, and the rarer of two text classes."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    out = None
    for df, name, part in (
        (orders, "o_totalprice", "o_orderpriority"),
        (lines, "l_returnflag", "l_linestatus"),
        (lines, "l_linestatus", "l_returnflag"),
    ):
        rows = (
            tg.binarise_target(df, tg.classify_target(df, name))
            .groupBy(F.lit(name).alias("target"), F.col(part).alias("part"))
            .agg(F.count("*").alias("n"), F.sum("positive").alias("positives"))
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "class_distribution",
    f"""WITH {LABELLED} SELECT CAST(quality AS VARCHAR) AS class, count(*) AS "count",
  round(count(*) / (SELECT count(*) FROM labelled) * 100, 2) AS pct
FROM labelled WHERE quality IS NOT NULL GROUP BY quality""",
)
def class_distribution(spark, sf):
    return ta.class_distribution(labelled(spark, sf), "quality")


_NUMERIC = ["doc_id", "toxic", "n_chars"]
_PER_CLASS = per_column(
    "labelled",
    _NUMERIC,
    "CAST(quality AS VARCHAR) AS class, '{c}' AS feature, count({c}) AS n, "
    "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std",
    "GROUP BY quality",
)


@query("per_class_feature_stats", f"WITH {LABELLED} {_PER_CLASS}")
def per_class_feature_stats(spark, sf):
    return ta.per_class_feature_stats(labelled(spark, sf), "quality")


@query(
    "per_class_feature_stats_three",
    "WITH " + LINEITEM_NET + " " + per_column(
        "lineitem_net",
        NET_NUMERIC,
        "l_returnflag AS class, '{c}' AS feature, count({c}) AS n, "
        "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std",
        "GROUP BY l_returnflag",
    ),
)
def per_class_feature_stats_three(spark, sf):
    return ta.per_class_feature_stats(lineitem_net(spark, sf), "l_returnflag")


@query(
    "regression_target_stats",
    """SELECT 'o_totalprice' AS "column", round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std,
  round(skewness(o_totalprice), 4) AS skewness, round(kurtosis(o_totalprice), 4) AS kurtosis,
  round(min(o_totalprice), 4) AS "min", round(max(o_totalprice), 4) AS "max" FROM orders""",
)
def regression_target_stats(spark, sf):
    return ta.regression_target_stats(table(spark, sf, "orders"), "o_totalprice")


@query(
    "cohens_d_ranking",
    """WITH stats AS (
  SELECT p_name AS class, 'l_quantity' AS feature, round(avg(l_quantity), 4) AS mean,
         round(stddev_samp(l_quantity), 4) AS std
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
  UNION ALL
  SELECT p_name, 'l_extendedprice', round(avg(l_extendedprice), 4),
         round(stddev_samp(l_extendedprice), 4)
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
  UNION ALL
  SELECT p_name, 'l_tax', round(avg(l_tax), 4), round(stddev_samp(l_tax), 4)
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
d AS (SELECT a.feature, max(CASE WHEN a.std = 0 AND b.std = 0 THEN 0 ELSE
             abs(a.mean - b.mean) / sqrt((a.std * a.std + b.std * b.std) / 2) END) AS d
      FROM stats a JOIN stats b ON a.feature = b.feature AND a.class < b.class GROUP BY a.feature)
SELECT feature, round(d, 6) AS cohens_d, row_number() OVER (ORDER BY d DESC) AS place FROM d""",
)
def cohens_d_ranking(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    df = lines.join(
        table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    ).select("p_name", "l_quantity", "l_extendedprice", "l_tax")
    stats = ta.per_class_feature_stats(df, "p_name")
    return rounded(ta.cohens_d_ranking(stats, df.columns), 6, "cohens_d")


@query(
    "imbalance_band",
    f"""WITH {LABELLED}, c AS (SELECT count(*) AS n FROM labelled GROUP BY quality)
SELECT count(*) AS n_classes, round(max(n) / min(n), 2) AS imbalance_ratio,
  CASE WHEN round(max(n) / min(n), 2) <= 1.5 THEN 'balanced'
       WHEN round(max(n) / min(n), 2) <= 3 THEN 'moderate' ELSE 'significant' END AS band FROM c""",
)
def imbalance_band(spark, sf):
    return ta.imbalance(ta.class_distribution(labelled(spark, sf), "quality"))
