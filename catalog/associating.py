"""Effect sizes, mutual information and fused ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cleaning import KEY
from catalog.correlating import pairs_sql
from catalog.inputs import (
    LABELLED, LINEITEM_NET, MIXED_CATEGORIES, MIXED_ORDERS, NET_NUMERIC, SEGMENTS, labelled,
    lineitem_net, long_sql, mixed_orders, rounded, segments, table, union_all,
)
from catalog.registry import query
from tabscope.functions.tails import chi2_sf, f_sf, t_sf2
from tabscope.operators import associate, categorical
from tabscope.operators.mutual_info import mutual_information
from tabscope.operators.target import classify_target


def _eta(groups: str) -> str:
    """eta squared and F from rows (feature, grp, x)."""
    return f"""grouped AS ({groups}),
means AS (SELECT feature, grp, count(x) AS n, avg(x) AS m, var_pop(x) * count(x) AS m2
          FROM grouped WHERE x IS NOT NULL AND grp IS NOT NULL GROUP BY ALL),
grand AS (SELECT feature, sum(n * m) / sum(n) AS g FROM means GROUP BY 1),
sums AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * pow(m - g, 2)) AS between_,
                sum(m2) AS within FROM means JOIN grand USING (feature) GROUP BY 1),
eta AS (SELECT feature, round(least(between_ / (between_ + within), 1), 6) AS effect_size,
  'eta2' AS effect_size_type,
  round((between_ / (k - 1)) / (within / (n - k)), 4) AS statistic FROM sums)"""


_BY_CLASS = union_all(
    [
        f"SELECT '{c}' AS feature, l_returnflag AS grp, CAST({c} AS DOUBLE) AS x FROM lineitem_net"
        for c in NET_NUMERIC
    ]
)


@query("eta_squared_by_class", f"WITH {LINEITEM_NET}, {_eta(_BY_CLASS)} SELECT * FROM eta")
def eta_squared_by_class(spark, sf):
    df = lineitem_net(spark, sf)
    moments = associate.group_moments_by_class(df, "l_returnflag", NET_NUMERIC)
    return associate.eta_squared(moments).drop("p_value")


_BY_VALUE = union_all(
    [
        f"SELECT '{c}' AS feature, {c} AS grp, CAST(l_quantity AS DOUBLE) AS x FROM mixed_orders"
        for c in MIXED_CATEGORIES
    ]
)


@query("eta_squared_by_value", f"WITH {MIXED_ORDERS}, {_eta(_BY_VALUE)} SELECT * FROM eta")
def eta_squared_by_value(spark, sf):
    df = mixed_orders(spark, sf)
    moments = associate.group_moments_by_value(df, "l_quantity", MIXED_CATEGORIES)
    return associate.eta_squared(moments).drop("p_value")


def cramers_sql(relation: str, columns: list[str], target: str) -> str:
    """All cells of each table, occurring or not, with Yates' correction for two by two."""
    rows = long_sql(f"(SELECT *, {target} AS class FROM {relation})", columns, "class")
    return f"""seen AS (SELECT "column" AS feature, value, class, count(*) AS o FROM ({rows})
         WHERE class IS NOT NULL GROUP BY ALL),
r AS (SELECT feature, value, sum(o) AS r FROM seen GROUP BY ALL),
c AS (SELECT feature, class, sum(o) AS c FROM seen GROUP BY ALL),
shape AS (SELECT feature, count(DISTINCT value) AS nv, count(DISTINCT class) AS nc, sum(o) AS n
          FROM seen GROUP BY 1),
cells AS (SELECT feature, nv, nc, n, coalesce(o, 0) AS o, r * c / n AS e
          FROM r JOIN c USING (feature) JOIN shape USING (feature)
          LEFT JOIN seen USING (feature, value, class)),
chi AS (SELECT feature, any_value(nv) AS nv, any_value(nc) AS nc, any_value(n) AS n,
  sum(CASE WHEN nv = 2 AND nc = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e
           ELSE pow(o - e, 2) / e END) AS chi2 FROM cells GROUP BY feature)
SELECT feature, round(least(sqrt(chi2 / (n * (least(nv, nc) - 1))), 1), 6) AS effect_size,
  'cramer_v' AS effect_size_type, round(chi2, 4) AS statistic FROM chi
WHERE least(nv, nc) >= 2"""


@query(
    "cramers_v",
    f"WITH {MIXED_ORDERS}, {cramers_sql('mixed_orders', MIXED_CATEGORIES[1:], 'l_returnflag')}",
)
def cramers_v(spark, sf):
    df = mixed_orders(spark, sf)
    return associate.cramers_v(df, "l_returnflag", MIXED_CATEGORIES[1:]).drop("p_value")


@query(
    "cramers_v_two_by_two",
    f"WITH {LABELLED}, {cramers_sql('labelled', ['quality', 'lang', 'source'], 'toxic')}",
)
def cramers_v_two_by_two(spark, sf):
    return associate.cramers_v(labelled(spark, sf), "toxic", ["quality", "lang", "source"]).drop(
        "p_value"
    )


@query(
    "pearson_effect",
    f"""WITH {LINEITEM_NET}, pairs AS ({pairs_sql('lineitem_net', NET_NUMERIC[:4], ['net_price'])})
SELECT col_a AS feature, round(abs(r), 6) AS effect_size, 'pearson_r' AS effect_size_type,
  round(abs(r), 4) AS statistic FROM pairs""",
)
def pearson_effect(spark, sf):
    return associate.pearson_effect(lineitem_net(spark, sf), "net_price", NET_NUMERIC[:4]).drop(
        "p_value"
    )


# Tails that are finite sums: F with two degrees above, chi-squared with an even number, and Student's
# t in terms of r, for even and odd degrees.
_CHI = cramers_sql("mixed_orders", MIXED_CATEGORIES[1:], "l_returnflag").rpartition("\nSELECT feature")[0]
_R2 = "ln(1 - r * r)"
EFFECT_P = f"""WITH {LINEITEM_NET}, {MIXED_ORDERS}, {_eta(_BY_CLASS)}, {_CHI},
f AS (SELECT feature, n - k AS m, (between_ / (k - 1)) / (within / (n - k)) AS f FROM sums WHERE k = 3),
pairs AS ({pairs_sql('lineitem_net', NET_NUMERIC[:4], ['net_price'])}),
t AS (SELECT col_a AS feature, abs(r) AS r, (SELECT count(*) FROM lineitem_net) - 2 AS nu FROM pairs)
SELECT feature, 'eta2' AS effect_size_type, round(f, 4) AS statistic,
  round(pow(1 + 2 * f / m, -m / 2.0), 6) AS p_value FROM f
UNION ALL
SELECT feature, 'cramer_v', round(chi2, 4), round(list_sum([exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1))
  FOR i IN range(0, CAST((nv - 1) * (nc - 1) / 2 AS BIGINT))]), 6)
FROM chi WHERE least(nv, nc) >= 2
UNION ALL
SELECT feature, 'pearson_r', round(r, 4), round(greatest(0, CASE WHEN nu % 2 = 0 THEN
  1 - r * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5) + j * {_R2}) FOR j IN range(0, nu // 2)])
  ELSE 1 - 2 / pi() * (asin(r) + r * sqrt(1 - r * r) * list_sum([exp(lgamma(j + 1) + lgamma(1.5)
    - lgamma(j + 1.5) + j * {_R2}) FOR j IN range(0, (nu - 1) // 2)])) END), 6)
FROM t"""


@query("effect_p_values", EFFECT_P)
def effect_p_values(spark, sf):
    """p-values of all three families."""
    net, mixed = lineitem_net(spark, sf), mixed_orders(spark, sf)
    by_class = associate.group_moments_by_class(net, "l_returnflag", NET_NUMERIC)
    parts = [
        associate.eta_squared(by_class),
        associate.cramers_v(mixed, "l_returnflag", MIXED_CATEGORIES[1:]),
        associate.pearson_effect(net, "net_price", NET_NUMERIC[:4]),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(rows.select("feature", "effect_size_type", "statistic", "p_value"), 6, "p_value")


@query(
    "tail_probabilities",
    """SELECT l_orderkey % 40 AS k, count(*) AS n,
  round(exp(-(l_orderkey % 40) / 2.0), 9) AS chi2_two_freedoms,
  round(pow(1 + (l_orderkey % 40) / 10.0, -10), 9) AS f_two_and_twenty,
  round(1 - (l_orderkey % 40) / sqrt(2 + pow(l_orderkey % 40, 2)), 9) AS t_two_freedoms
FROM lineitem GROUP BY ALL""",
)
def tail_probabilities(spark, sf):
    """Tails with closed forms, at statistics taken from the data."""
    k = F.col("k")
    rows = (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_orderkey") % 40).alias("k"))
        .agg(F.count("*").alias("n"))
    )
    return rows.select(
        "k",
        "n",
        F.round(chi2_sf(k, F.lit(2)), 9).alias("chi2_two_freedoms"),
        F.round(f_sf(k, F.lit(2), F.lit(20)), 9).alias("f_two_and_twenty"),
        F.round(t_sf2(k, F.lit(2)), 9).alias("t_two_freedoms"),
    )


PSI = """psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / (i - 1)) FILTER (i > 1)
  OVER (ORDER BY i), 0) - 0.5772156649015329::DOUBLE AS p FROM range(1, 100000) t(i))"""


def _noise_sql(key: str, start: int) -> str:
    digest = f"md5('42|' || {key})"
    return f"CAST(('0x' || substr({digest}, {start}, 8)) AS BIGINT) / 2147483648.0 - 1"


def mi_classes_sql(relation: str, key: str, target: str, feature: str, value: str) -> str:
    """Brute force over all pairs of rows, with the same noise on equal values."""
    return f"""(WITH raw AS (
  SELECT CAST({target} AS VARCHAR) AS y, CAST({value} AS DOUBLE) AS v, {_noise_sql(key, 13)} AS u
  FROM {relation}),
pts AS (SELECT row_number() OVER () AS id, y, v + 1e-10::DOUBLE *
          (SELECT greatest(stddev_pop(v), avg(abs(v))) FROM raw) * u AS x FROM raw),
sized AS (SELECT *, count(*) OVER (PARTITION BY y) AS ny FROM pts),
near AS (SELECT a.id, a.ny, least(3, a.ny - 1) AS k,
    list_sort(list(abs(a.x - b.x)))[least(3, a.ny - 1)] AS d
  FROM sized a JOIN sized b ON a.y = b.y AND a.id <> b.id WHERE a.ny > 1 GROUP BY a.id, a.ny),
within AS (SELECT n.id, n.ny, n.k, count(*) AS m
  FROM near n JOIN pts a ON a.id = n.id JOIN sized b ON b.ny > 1 AND abs(a.x - b.x) < n.d
  GROUP BY ALL)
SELECT '{feature}' AS feature, greatest(0, (SELECT p FROM psi WHERE i = (SELECT count(*) FROM within))
  + avg(pk.p) - avg(pn.p) - avg(pm.p)) AS mi_score
FROM within w JOIN psi pk ON pk.i = w.k JOIN psi pn ON pn.i = w.ny JOIN psi pm ON pm.i = w.m)"""


def mi_regression_sql(relation: str, key: str, target: str, feature: str, value: str) -> str:
    """The same for a continuous target: neighbours by the larger coordinate distance."""

    def spread(v, u):
        return f"{v} + 1e-10::DOUBLE * (SELECT greatest(1, avg(abs({v}))) FROM unit) * {u}"

    return f"""(WITH raw AS (
  SELECT CAST({value} AS DOUBLE) AS a, CAST({target} AS DOUBLE) AS b,
    {_noise_sql(key, 13)} AS ua, {_noise_sql(key, 21)} AS ub FROM {relation}),
unit AS (SELECT a / (SELECT stddev_pop(a) FROM raw) AS a, b / (SELECT stddev_pop(b) FROM raw) AS b,
         ua, ub FROM raw),
pts AS (SELECT row_number() OVER () AS id, {spread('a', 'ua')} AS x, {spread('b', 'ub')} AS y FROM unit),
near AS (SELECT p.id, list_sort(min(greatest(abs(p.x - q.x), abs(p.y - q.y)), 3))[3] AS d
         FROM pts p JOIN pts q ON p.id <> q.id GROUP BY p.id),
within AS (SELECT p.id, count(*) FILTER (abs(p.x - q.x) < d) AS nx,
             count(*) FILTER (abs(p.y - q.y) < d) AS ny
           FROM pts p JOIN near USING (id) JOIN pts q ON p.id <> q.id GROUP BY p.id)
SELECT '{feature}' AS feature, greatest(0, (SELECT p FROM psi WHERE i = (SELECT count(*) FROM pts))
  + (SELECT p FROM psi WHERE i = 3) - avg(px.p + py.p)) AS mi_score
FROM within JOIN psi px ON px.i = nx + 1 JOIN psi py ON py.i = ny + 1)"""


_FEATURES = ["c_acctbal", "c_nationkey", "segment_no"]


@query(
    "mutual_information_classes",
    f"WITH {SEGMENTS}, {PSI} SELECT feature, round(mi_score, 4) AS mi_score FROM ("
    + union_all(
        [
            f"SELECT * FROM {mi_classes_sql('segments', 'c_custkey', 'c_mktsegment', c, c)}"
            for c in _FEATURES
        ]
    )
    + ")",
)
def mutual_information_classes(spark, sf):
    scores = mutual_information(
        segments(spark, sf), "c_mktsegment", "classification", _FEATURES, [], key=["c_custkey"]
    )
    return rounded(scores, 4, "mi_score")


@query(
    "mutual_information_numeric",
    f"WITH {SEGMENTS}, {PSI} SELECT feature, round(mi_score, 4) AS mi_score FROM ("
    + union_all(
        [
            f"SELECT * FROM {mi_regression_sql('segments', 'c_custkey', 'c_acctbal', c, v)}"
            for c, v in [
                ("c_custkey", "c_custkey"),
                ("c_nationkey", "c_nationkey"),
                ("segment_no", "segment_no"),
                ("c_mktsegment", "(dense_rank() OVER (ORDER BY c_mktsegment) - 1)"),
            ]
        ]
    )
    + ")",
)
def mutual_information_numeric(spark, sf):
    scores = mutual_information(
        segments(spark, sf),
        "c_acctbal",
        "regression",
        ["c_custkey", "c_nationkey", "segment_no"],
        ["c_mktsegment"],
        key=["c_custkey"],
    )
    return rounded(scores, 4, "mi_score")


@query("mutual_information_regression")
def mutual_information_regression(spark, sf):
    """Needs neighbours in two dimensions; tested against brute force on small fixtures."""
    return rounded(
        mutual_information(
            table(spark, sf, "lineitem").withColumn(
                "net_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))
            ),
            "net_price",
            "regression",
            ["l_quantity", "l_extendedprice", "l_discount"],
            ["l_returnflag"],
            key=KEY,
        ),
        6,
        "mi_score",
    )


def _associations(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    return associate.feature_associations(df, classify_target(df, "l_returnflag"), key=KEY)


@query("feature_associations_classes")
def feature_associations_classes(spark, sf):
    """The estimator and the effect sizes on all rows."""
    return _associations(spark, sf)


_O_NUMERIC, _O_CATEGORIES = ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"]
_O_ORDER = [*_O_NUMERIC, *_O_CATEGORIES]
_O_GROUPS = union_all(
    [f"SELECT '{c}' AS feature, {c} AS grp, CAST(o_totalprice AS DOUBLE) AS x FROM orders" for c in _O_CATEGORIES]
)
_O_SCORES = union_all(
    [
        f"SELECT * FROM {mi_regression_sql('orders', 'o_orderkey', 'o_totalprice', c, v)}"
        for c, v in [(c, c) for c in _O_NUMERIC]
        + [(c, f"(dense_rank() OVER (ORDER BY {c}) - 1)") for c in _O_CATEGORIES]
    ]
)


@query(
    "feature_associations_regression",
    f"""WITH {PSI}, {_eta(_O_GROUPS)},
pairs AS ({pairs_sql('orders', _O_NUMERIC, ['o_totalprice'])}),
effects AS (
  SELECT feature, effect_size, effect_size_type, statistic FROM eta
  UNION ALL SELECT col_a, round(abs(r), 6), 'pearson_r', round(abs(r), 4) FROM pairs),
scored AS (SELECT *, list_position({_O_ORDER}, feature) AS position FROM effects JOIN ({_O_SCORES}) USING (feature)),
placed AS (SELECT *, row_number() OVER (ORDER BY round(mi_score, 9) DESC, position) AS mi_rank,
             row_number() OVER (ORDER BY effect_size DESC, position) AS effect_size_rank FROM scored)
SELECT row_number() OVER (ORDER BY mi_rank + effect_size_rank, effect_size DESC, position) AS place, feature,
  CASE WHEN position <= 2 THEN 'numerical' ELSE 'categorical' END AS feature_type,
  round(mi_score, 4) AS mi_score, mi_rank, effect_size, effect_size_type,
  CASE WHEN effect_size < CASE WHEN effect_size_type = 'eta2' THEN 0.01 ELSE 0.1 END THEN 'weak'
       WHEN effect_size < CASE WHEN effect_size_type = 'eta2' THEN 0.06 ELSE 0.3 END THEN 'moderate'
       ELSE 'strong' END AS effect_size_label,
  effect_size_rank, mi_rank + effect_size_rank AS borda_score, abs(statistic) AS f_stat_or_chi2,
  4 AS total_features FROM placed""",
)
def feature_associations_regression(spark, sf):
    """All of the ranking but its p-values, against all pairs of orders."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    rows = associate.feature_associations(df, classify_target(df, "o_totalprice"), key=["o_orderkey"]).drop(
        "p_value", "missingness_strategy", "mi_sample_size", "mi_sample_note"
    )
    return rounded(rows, 4, "mi_score")


_L_NUMERIC = ["doc_id", "toxic", "n_chars"]
_L_CATEGORIES = ["lang", "source"]
_L_GROUPS = union_all(
    [
        f"SELECT '{c}' AS feature, quality AS grp, CAST({c} AS DOUBLE) AS x FROM labelled"
        for c in _L_NUMERIC
    ]
)
_L_SCORES = union_all(
    [
        f"SELECT * FROM {mi_classes_sql('labelled', 'doc_id', 'quality', c, v)}"
        for c, v in [(c, c) for c in _L_NUMERIC]
        + [(c, f"(dense_rank() OVER (ORDER BY {c}) - 1)") for c in _L_CATEGORIES]
    ]
)
_L_ORDER = [*_L_NUMERIC, *_L_CATEGORIES]
RANKED = f"""{LABELLED}, {PSI}, {_eta(_L_GROUPS)},
effects AS (SELECT * FROM eta UNION ALL (WITH {cramers_sql('labelled', _L_CATEGORIES, 'quality')})),
ranked AS (SELECT *, list_position({_L_ORDER}, feature) AS position FROM effects JOIN ({_L_SCORES})
           USING (feature)),
placed AS (SELECT *, row_number() OVER (ORDER BY round(mi_score, 9) DESC, position) AS mi_rank,
             row_number() OVER (ORDER BY effect_size DESC, position) AS effect_size_rank FROM ranked),
associations AS (
  SELECT row_number() OVER (ORDER BY mi_rank + effect_size_rank, effect_size DESC, position) AS place,
    feature, CASE WHEN position <= 3 THEN 'numerical' ELSE 'categorical' END AS feature_type,
    round(mi_score, 4) AS mi_score, mi_rank, effect_size, effect_size_type,
    CASE WHEN effect_size < CASE WHEN effect_size_type = 'eta2' THEN 0.01 ELSE 0.1 END THEN 'weak'
         WHEN effect_size < CASE WHEN effect_size_type = 'eta2' THEN 0.06 ELSE 0.3 END THEN 'moderate'
         ELSE 'strong' END AS effect_size_label,
    effect_size_rank, mi_rank + effect_size_rank AS borda_score, abs(statistic) AS f_stat_or_chi2,
    5 AS total_features FROM placed)"""


def _labelled_associations(spark, sf):
    df = labelled(spark, sf)
    return associate.feature_associations(df, classify_target(df, "quality"), key=["doc_id"])


@query("feature_associations", f"WITH {RANKED} SELECT * FROM associations")
def feature_associations(spark, sf):
    """All of the ranking but its p-values, against brute force."""
    rows = _labelled_associations(spark, sf).drop(
        "p_value", "missingness_strategy", "mi_sample_size", "mi_sample_note"
    )
    return rounded(rows, 4, "mi_score")


@query(
    "association_quadrants",
    f"""WITH {RANKED} SELECT * FROM (
  SELECT feature, mi_rank, effect_size, effect_size_label,
    CASE WHEN mi_rank <= 3 AND effect_size_label = 'weak' THEN 'NONLINEAR SIGNAL'
         WHEN mi_rank > 3 AND effect_size_label = 'strong' THEN 'SUSPICIOUS ASSOCIATION' END AS quadrant
  FROM associations) WHERE quadrant IS NOT NULL""",
)
def association_quadrants(spark, sf):
    return associate.association_quadrants(_labelled_associations(spark, sf))


@query(
    "borda_not_in_top_spread",
    f"""WITH {RANKED},
rates AS (
  SELECT "column", value, count(*) AS n, count(*) FILTER (quality = 1) AS ones, count(quality) AS k
  FROM (SELECT 'lang' AS "column", lang AS value, quality FROM labelled
        UNION ALL SELECT 'source', source, quality FROM labelled) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)
                         AS rank FROM rates) WHERE rank <= 10),
spread AS (SELECT "column", max(round(ones / k * 100, 2)) - min(round(ones / k * 100, 2)) AS spread
           FROM top GROUP BY "column")
SELECT feature, borda_score FROM associations
WHERE feature_type = 'categorical' AND feature NOT IN (
  SELECT "column" FROM spread ORDER BY spread DESC, "column" LIMIT 1)""",
)
def borda_not_in_top_spread(spark, sf):
    """Quality 1 leads in every frequent value, so the spreads are over its rate."""
    df = labelled(spark, sf)
    rates = categorical.target_rates(df, "quality", _L_CATEGORIES)
    widest = categorical.discriminative_columns(rates, _L_CATEGORIES, "quality", top=1)
    return categorical.borda_not_in_top_spread(_labelled_associations(spark, sf), widest)
