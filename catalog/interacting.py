"""Interaction signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import ORDER_QUANTITIES, QUANTITIES, order_quantities, union_all
from catalog.registry import query
from tabscope.operators.describe import describe_numeric
from tabscope.operators import interact
from tabscope.operators.target import classify_target

COLUMNS = [
    "type", "subject", "group", "count", "rate_pct", "positives", "spread_pp", "overall_rate_pct",
    "top_share_pct",
]


def _show(signals):
    return signals.withColumn("columns", F.array_join("columns", ",")).drop("group_no")


def _target(df):
    return classify_target(df, "large")


_MEDIANS = "medians AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in QUANTITIES) + (
    ", median(o_totalprice) AS m_price FROM order_quantities)"
)


def signal_sql(kind: str, subject: str, columns: str, group: str, where: str = "true", least: int = 10,
               target: str = "large", top: str = "NULL") -> str:
    """Groups of one signal, kept if two groups are large enough and differ by five points."""
    return f"""SELECT '{kind}' AS type, '{subject}' AS subject, '{columns}' AS columns, *
FROM (SELECT "group", "count", rate_pct, positives, round(spread, 1) AS spread_pp,
        (SELECT round(avg({target}) * 100, 1) FROM order_quantities, medians) AS overall_rate_pct,
        {top} AS top_share_pct
      FROM (SELECT *, max(rate_pct) OVER () - min(rate_pct) OVER () AS spread, count(*) OVER () AS k
            FROM (SELECT {group} AS "group", count(*) AS "count",
                    round(avg({target}) * 100, 1) AS rate_pct,
                    CAST(sum({target}) AS DOUBLE) AS positives
                  FROM order_quantities, medians WHERE {where} GROUP BY 1
                  HAVING count(*) >= {least}))
      WHERE k >= 2 AND spread >= 5)"""


def _hi(c: str, op: str = ">", m: str | None = None) -> str:
    return f"coalesce({c} {op} {m or 'm_' + c}, false)"


_LEVEL = "CAST(" + " + ".join(f"CAST({_hi(c)} AS INTEGER)" for c in QUANTITIES) + " AS VARCHAR)"
PERSISTENCE = signal_sql("persistence_gradient", "qty", ",".join(QUANTITIES), _LEVEL)
_MOVE = (
    f"CASE WHEN NOT {_hi('qty_1')} AND NOT {_hi('qty_7')} THEN 'stable_low' "
    f"WHEN NOT {_hi('qty_1')} THEN 'deteriorating' "
    f"WHEN NOT {_hi('qty_7')} THEN 'improving' ELSE 'stable_high' END"
)
TRAJECTORY = signal_sql("trajectory", "qty", "qty_1,qty_7", _MOVE)
_BASE = f"WITH {ORDER_QUANTITIES}, {_MEDIANS}"


@query(
    "column_families",
    f"WITH {ORDER_QUANTITIES} "
    + union_all(
        [
            f"SELECT 'qty' AS family, {i} AS member, '{c}' AS \"column\", count({c}) AS n, "
            f"round(avg({c}), 6) AS mean FROM order_quantities"
            for i, c in enumerate(QUANTITIES)
        ]
    ),
)
def column_families(spark, sf):
    """The members of each family with what they hold."""
    df = order_quantities(spark, sf)
    stats = describe_numeric(df, QUANTITIES).select("column", F.col("count").alias("n"), F.round("mean", 6).alias("mean"))
    return interact.family_table(df, "large").join(stats, "column")


@query("persistence_gradient", f"{_BASE} {PERSISTENCE}")
def persistence_gradient(spark, sf):
    df = order_quantities(spark, sf)
    return _show(interact.persistence_gradient(df, _target(df)))


@query("trajectory", f"{_BASE} {TRAJECTORY}")
def trajectory(spark, sf):
    df = order_quantities(spark, sf)
    return _show(interact.trajectory(df, _target(df)))


_HALVES = (
    f"'qty_1_' || CASE WHEN {_hi('qty_1', '>=')} THEN 'hi' ELSE 'lo' END || '_qty_2_' || "
    f"CASE WHEN {_hi('qty_2', '>=')} THEN 'hi' ELSE 'lo' END"
)


@query(
    "cross_feature_segments",
    f"{_BASE} {signal_sql('cross_feature_segments', 'qty_1 x qty_2', 'qty_1,qty_2', _HALVES)}",
)
def cross_feature_segments(spark, sf):
    df = order_quantities(spark, sf)
    return _show(interact.cross_feature_segments(df, _target(df), "qty_1", "qty_2"))


_EDGES = "(SELECT quantile_cont(CAST(qty_4 AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) FROM order_quantities)"
_QUINTILE = f"'Q' || greatest(1, len(list_filter(list_distinct({_EDGES}), lambda e: e < qty_4)))"
_TOP = (
    'round(arg_min(positives, (-rate_pct, "group")) OVER () * 100 / '
    "(SELECT sum(large) FROM order_quantities), 1)"
)


@query(
    "quintile_concentration",
    _BASE + " " + signal_sql(
        "portfolio_concentration", "qty_4", "qty_4", _QUINTILE, "qty_4 IS NOT NULL", 5, top=_TOP
    ),
)
def quintile_concentration(spark, sf):
    df = order_quantities(spark, sf)
    return _show(interact.quintile_concentration(df, _target(df), "qty_4"))


@query("interaction_signals", f"{_BASE} {PERSISTENCE} UNION ALL {TRAJECTORY}")
def interaction_signals(spark, sf):
    """Signals of the numbered columns; segments and quintiles need ranked features."""
    df = order_quantities(spark, sf)
    return _show(interact.interaction_signals(df, _target(df)))


_PRICE = "CASE WHEN o_totalprice >= m_price THEN 1 ELSE 0 END"


@query(
    "interaction_signals_regression",
    f"{_BASE} "
    + signal_sql("persistence_gradient", "qty", ",".join(QUANTITIES), _LEVEL, target=_PRICE)
    + " UNION ALL "
    + signal_sql("trajectory", "qty", "qty_1,qty_7", _MOVE, target=_PRICE),
)
def interaction_signals_regression(spark, sf):
    df = order_quantities(spark, sf).drop("large")
    return _show(interact.interaction_signals(df, classify_target(df, "o_totalprice")))


@query("interaction_signals_ranked")
def interaction_signals_ranked(spark, sf):
    """All kinds of signals, with the features that the associations rank first."""
    from tabscope.operators.associate import feature_associations

    df = order_quantities(spark, sf)
    target = _target(df)
    ranked = feature_associations(df, target, key=["o_orderkey"])
    return _show(interact.interaction_signals(df, target, ranked))
