"""Pearson and Spearman correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.inputs import (
    LINEITEM_NET, NET_NUMERIC, ORDER_QUANTITIES, QUANTITIES, lineitem_net, order_quantities,
    rounded, table, union_all,
)
from catalog.registry import query
from tabscope.operators import correlate, plotdata
from tabscope.plans.pairs import pair_correlations


def pairs_sql(relation: str, columns: list[str], targets: list[str] | None = None) -> str:
    """(col_a, col_b, n, r) over the rows where both are present, NULL for constants."""
    pairs = combinations(columns, 2) if targets is None else [(c, t) for c in columns for t in targets]
    return union_all(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, count({a} + {b}) AS n, "
            f"CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL "
            f"ELSE corr({a}, {b}) END AS r FROM {relation} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            for a, b in pairs
        ]
    )


_NET_PAIRS = f"{LINEITEM_NET}, pairs AS ({pairs_sql('lineitem_net', NET_NUMERIC)})"
_QTY_PAIRS = f"{ORDER_QUANTITIES}, pairs AS ({pairs_sql('order_quantities', QUANTITIES)})"


def _strength(r: str) -> str:
    return (
        f"CASE WHEN abs({r}) > 0.9 THEN 'VERY STRONG' WHEN abs({r}) > 0.7 THEN 'STRONG' "
        f"WHEN abs({r}) > 0.5 THEN 'MODERATE' WHEN abs({r}) > 0.3 THEN 'WEAK' "
        "ELSE 'NEGLIGIBLE' END"
    )


@query(
    "correlation_matrix",
    f"""WITH {_NET_PAIRS}
SELECT col_a, col_b, round(r, 4) AS r FROM pairs
UNION ALL SELECT col_b, col_a, round(r, 4) FROM pairs
UNION ALL SELECT unnest({NET_NUMERIC}), unnest({NET_NUMERIC}), 1.0""",
)
def correlation_matrix(spark, sf):
    return correlate.correlation_matrix(lineitem_net(spark, sf), NET_NUMERIC)


@query(
    "pair_correlations_missing",
    f"WITH {_QTY_PAIRS} SELECT col_a, col_b, n, round(r, 6) AS r FROM pairs",
)
def pair_correlations_missing(spark, sf):
    """Every column has missing values, so each pair has rows of its own."""
    return rounded(pair_correlations(order_quantities(spark, sf), QUANTITIES), 6, "r")


_WIDE = [f"w_{i}" for i in range(1, 27)]
_WIDE_SQL = (
    "wide AS (SELECT "
    + ", ".join(
        f"CASE WHEN l_linenumber % 7 <> {i % 7} THEN l_quantity * {i} + l_tax * {(i * i) % 11} "
        f"* l_extendedprice / 1000 END AS w_{i}"
        for i in range(1, 27)
    )
    + " FROM lineitem)"
)


@query(
    "pair_correlations_wide",
    f"WITH {_WIDE_SQL}, pairs AS ({pairs_sql('wide', _WIDE)}) "
    "SELECT col_a, col_b, n, round(r, 6) AS r FROM pairs",
)
def pair_correlations_wide(spark, sf):
    """Enough columns for the matrix-product path."""
    q, t = F.col("l_quantity"), F.col("l_tax")
    wide = table(spark, sf, "lineitem").select(
        *[
            F.when(
                F.col("l_linenumber") % 7 != i % 7,
                q * i + t * ((i * i) % 11) * F.col("l_extendedprice") / 1000,
            ).alias(f"w_{i}")
            for i in range(1, 27)
        ]
    )
    return rounded(pair_correlations(wide), 6, "r")


@query(
    "ranked_pairs",
    f"WITH {_NET_PAIRS} SELECT col_a, col_b, round(coalesce(r, 0), 4) AS r, "
    f"{_strength('r')} AS strength FROM pairs",
)
def ranked_pairs(spark, sf):
    return correlate.ranked_pairs(pair_correlations(lineitem_net(spark, sf)))


@query(
    "strongest_pair",
    f"WITH {_NET_PAIRS} SELECT col_a, col_b, round(r, 4) AS r, {_strength('r')} AS strength "
    "FROM pairs WHERE r IS NOT NULL ORDER BY abs(r) DESC LIMIT 1",
)
def strongest_pair(spark, sf):
    return correlate.strongest_pair(pair_correlations(lineitem_net(spark, sf)))


@query(
    "collinear_pairs",
    f"WITH {_NET_PAIRS} SELECT col_a, col_b, round(abs(r), 6) AS abs_r, "
    "round(1 / (1 - pow(least(abs(r), 0.9999), 2)), 1) AS vif FROM pairs WHERE abs(r) > 0.85",
)
def collinear_pairs(spark, sf):
    pairs = correlate.collinear_pairs(pair_correlations(lineitem_net(spark, sf)), 0.85)
    return rounded(pairs, 6, "abs_r")


@query(
    "feature_target_correlation",
    f"""WITH {LINEITEM_NET}, pairs AS ({pairs_sql('lineitem_net', NET_NUMERIC[:4], ['net_price'])}),
ranked AS (SELECT col_a AS feature, round(coalesce(r, 0), 4) AS r,
  row_number() OVER (ORDER BY abs(round(coalesce(r, 0), 4)) DESC,
                     list_position({NET_NUMERIC}, col_a)) AS place FROM pairs)
SELECT feature, r, CASE WHEN place <= 3 THEN place END AS place FROM ranked""",
)
def feature_target_correlation(spark, sf):
    return correlate.feature_target_correlation(lineitem_net(spark, sf), "net_price")


_ORDINALS = ["line", "quantity", "size"]
_ORDINAL_SQL = """ordinals AS (
  SELECT CAST(l_linenumber AS VARCHAR) AS line,
         CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS VARCHAR) END AS quantity,
         CAST(p_size + CAST(floor(l_quantity / 2) AS INTEGER) AS VARCHAR) AS "size"
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _ordinals(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_quantity")
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_linenumber").cast("string").alias("line"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("string")).alias("quantity"),
        (F.col("p_size") + F.floor(F.col("l_quantity") / 2).cast("int")).cast("string").alias("size"),
    )


def _spearman_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, corr(ra, rb) AS rho FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS ra,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS rb
  FROM (SELECT CAST("{a}" AS DOUBLE) AS x, CAST("{b}" AS DOUBLE) AS y FROM ordinals
        WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL))"""


_SPEARMAN = union_all([_spearman_sql(a, b) for a, b in combinations(_ORDINALS, 2)])


@query(
    "ordinal_spearman",
    f"WITH {_ORDINAL_SQL} SELECT col_a, col_b, n, round(rho, 6) AS rho FROM ({_SPEARMAN})",
)
def ordinal_spearman(spark, sf):
    return rounded(correlate.ordinal_spearman(_ordinals(spark, sf), _ORDINALS), 6, "rho")


@query(
    "notable_ordinal_pairs",
    f"WITH {_ORDINAL_SQL} SELECT col_a, col_b, n, round(rho, 6) AS rho FROM ({_SPEARMAN}) "
    "WHERE abs(rho) >= 0.3",
)
def notable_ordinal_pairs(spark, sf):
    pairs = correlate.ordinal_spearman(_ordinals(spark, sf), _ORDINALS)
    return rounded(correlate.notable_ordinal_pairs(pairs, 0.3), 6, "rho")


@query(
    "plot_ordinal",
    f"WITH {_ORDINAL_SQL} SELECT col_a, col_b, n, round(rho, 6) AS rho FROM ({_SPEARMAN})",
)
def plot_ordinal(spark, sf):
    return rounded(plotdata.plot_data(_ordinals(spark, sf), "ordinal", encoded=_ORDINALS), 6, "rho")
