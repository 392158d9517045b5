import pytest

from tabscope.operators import quality
from tabscope.operators.profile import Profile
from tabscope.operators.target import Target, classify_target, detect_target


def flags_of(rule, df, **kwargs):
    return rule(Profile(df, **kwargs)).orderBy("seq").collect()


@pytest.mark.parametrize(
    "rows, missing, severity",
    [(10, 9, "BLOCKER"), (10, 5, "HIGH"), (10, 4, "HIGH"), (10, 3, "MEDIUM"), (10, 2, "MEDIUM"),
     (20, 1, None), (100, 6, "MEDIUM")],
)
def test_missing_values(spark, rows, missing, severity):
    df = spark.range(rows).selectExpr(f"IF(id < {missing}, NULL, id) AS a", "id AS b")
    got = flags_of(quality.missing_values, df)
    assert [f["severity"] for f in got] == ([severity] if severity else [])


def test_missing_values_worst_first(spark):
    df = spark.range(10).selectExpr("IF(id < 2, NULL, 1) AS a", "IF(id < 6, NULL, 1) AS b")
    assert [f["column"] for f in flags_of(quality.missing_values, df)] == ["b", "a"]


def test_dataset_missingness(spark):
    df = spark.range(10).selectExpr("IF(id < 4, NULL, 1) AS a", "IF(id < 4, NULL, 1) AS b")
    assert flags_of(quality.dataset_missingness, df)[0]["severity"] == "HIGH"
    exact = spark.range(10).selectExpr("IF(id < 3, NULL, 1) AS a")
    assert flags_of(quality.dataset_missingness, exact) == []


def test_duplicate_rows(spark):
    two = spark.range(10).selectExpr("id % 2 AS a")
    assert flags_of(quality.duplicate_rows, two)[0]["severity"] == "HIGH"
    one = spark.range(200).selectExpr("IF(id = 199, 0, id) AS a")
    assert flags_of(quality.duplicate_rows, one)[0]["severity"] == "MEDIUM"
    removed = flags_of(quality.duplicate_rows, spark.range(2), duplicates=3)
    assert removed[0]["value"] == pytest.approx(0.6)
    assert flags_of(quality.duplicate_rows, spark.range(50)) == []


def test_outliers(spark, frame):
    got = flags_of(quality.outliers_iqr, frame(x=[*range(1, 10), 100]))
    assert got[0]["severity"] == "MEDIUM" and got[0]["value"] == pytest.approx(0.1)
    assert flags_of(quality.outliers_iqr, frame(x=[1, 2, 1000])) == []
    assert flags_of(quality.outliers_iqr, frame(x=[1] * 9 + [50])) == []


def test_outliers_at_and_above_a_fifth(spark):
    at = spark.range(100).selectExpr("IF(id < 20, 1000 + id, id % 10) AS x")
    assert flags_of(quality.outliers_iqr, at)[0]["severity"] == "MEDIUM"
    clusters = spark.range(700).selectExpr(
        "CASE WHEN id < 100 THEN 20 WHEN id < 600 THEN 39.5 + (id % 11) / 10 ELSE 60 END AS x"
    )
    got = flags_of(quality.outliers_iqr, clusters)
    assert got[0]["severity"] == "LOW" and "spike" in got[0]["message"]


def test_unreliability_hint(spark):
    rows = [(5, 0.0, 0.0), (50, 0.0, -1.0), (50, 3.0, 9.0), (50, 0.5, 2.0), (50, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "n long, g double, k double")
    from pyspark.sql import functions as F

    hint = quality.unreliability_hint(F.col("n"), F.col("g"), F.col("k"))
    assert [r[0] for r in df.select(hint).collect()] == [
        "unclear", "platykurtic", "heavy_tail", "central_spike", "unreliable",
    ]


def test_skewness(spark, frame):
    few = flags_of(quality.skewness, frame(x=[1.0] * 9 + [100.0]))
    assert few[0]["severity"] == "MEDIUM" and "only 10 rows" in few[0]["message"]
    many = flags_of(quality.skewness, frame(x=[1.0] * 90 + [100.0] * 3))
    assert many[0]["severity"] == "HIGH" and many[0]["value"] > 2
    mild = flags_of(quality.skewness, frame(x=[1, 2, 2, 3, 3, 4, 4, 5, 6, 11]))
    assert mild[0]["severity"] == "MEDIUM"
    assert flags_of(quality.skewness, frame(x=[5] * 9)) == []
    assert flags_of(quality.skewness, frame(x=[1, 9])) == []


def test_skewness_advice_and_limit(spark):
    df = spark.range(100).selectExpr(
        "IF(id < 50, 0, POW(id, 4)) AS zeros", "-POW(id, 12) AS left", "POW(id, 12) - 5 AS minus"
    )
    advice = {f["column"]: f["suggestion"] for f in flags_of(quality.skewness, df)}
    assert "zero" in advice["zeros"].lower() and "reflect" in advice["left"]
    assert "negative" in advice["minus"]
    wide = spark.range(60).selectExpr(*[f"POW(id, {6 + i / 10}) AS c{i}" for i in range(24)])
    got = flags_of(quality.skewness, wide)
    assert len(got) == 24 and got[0]["column"] == "c23"
    most = flags_of(lambda p: quality.skewness(p, most=20), wide)
    assert [f["column"] for f in most] == [f["column"] for f in got[:20]]


def test_variance_rules(frame):
    assert flags_of(quality.zero_variance, frame(a=[1, 2], k=[42, 42], m=[7, 7]))[0]["column"] == "k"
    near = frame(x=[100.0, 100.0, 100.0, 100.0, 100.1])
    assert flags_of(quality.near_zero_variance, near)[0]["severity"] == "LOW"
    assert flags_of(quality.near_zero_variance, frame(x=[-1.0, 1.0])) == []
    assert flags_of(quality.near_zero_variance, frame(x=[5.0, 5.0])) == []


def test_near_perfect_correlation(frame):
    got = flags_of(quality.near_perfect_correlation, frame(x=[1, 2, 3, 4, 5], y=[2, 4, 6, 8, 10]))
    assert got[0]["severity"] == "HIGH" and got[0]["value"] == pytest.approx(1.0)
    mid = frame(x=[1, 2, 3, 4, 5], y=[1, 2, 4, 3, 5])
    assert flags_of(quality.near_perfect_correlation, mid)[0]["severity"] == "MEDIUM"
    assert flags_of(quality.near_perfect_correlation, frame(x=[1, 2, 3, 4, 5], y=[5, 1, 3, 2, 4])) == []


def test_redundancy(spark):
    pair = spark.range(150).selectExpr("ELT(id % 3 + 1, 'a', 'b', 'c') AS s", "id % 3 + 1 AS n", "4 AS k")
    got = flags_of(quality.categorical_numeric_redundancy, pair)
    assert [(f["severity"], f["value"]) for f in got] == [("HIGH", 1.0)]
    loose = spark.range(150).selectExpr("ELT(id % 3 + 1, 'a', 'b', 'c') AS s", "id % 7 AS n")
    assert flags_of(quality.categorical_numeric_redundancy, loose) == []
    ids = spark.range(100).selectExpr("CONCAT('k', id) AS s", "id AS n")
    assert flags_of(quality.categorical_numeric_redundancy, ids) == []
    sparse = spark.range(100).selectExpr("CONCAT('k', id % 60) AS s", "id % 60 AS n")
    assert flags_of(quality.categorical_numeric_redundancy, sparse) == []
    few = spark.range(9).selectExpr("CONCAT('k', id % 2) AS s", "id % 2 AS n")
    assert flags_of(quality.categorical_numeric_redundancy, few) == []


def test_redundancy_with_missing_values(spark):
    df = spark.range(90).selectExpr(
        "IF(id % 10 = 0, NULL, CONCAT('k', id % 3)) AS s", "IF(id % 7 = 0, NULL, id % 3) AS n"
    )
    assert flags_of(quality.categorical_numeric_redundancy, df)[0]["value"] == 1.0


def test_unique_and_single(spark):
    df = spark.range(5).selectExpr("id % 2 AS a", "id + 101 AS b", "id AS c", "IF(id = 0, NULL, 'on') AS s")
    assert [f["column"] for f in flags_of(quality.all_unique_column, df)] == ["b"]
    got = flags_of(quality.single_value_categorical, df)
    assert [(f["column"], f["severity"]) for f in got] == [("s", "HIGH")]


@pytest.mark.parametrize("values, severity", [(51, "HIGH"), (50, "MEDIUM"), (25, "MEDIUM"), (21, "MEDIUM"), (20, None)])
def test_high_cardinality(spark, values, severity):
    df = spark.range(values * 2).selectExpr(f"CONCAT('v', id % {values}) AS s")
    assert [f["severity"] for f in flags_of(quality.high_cardinality, df)] == ([severity] if severity else [])


def test_high_cardinality_skips_identifiers(spark):
    assert flags_of(quality.high_cardinality, spark.range(60).selectExpr("CONCAT('v', id) AS s")) == []


def test_rare_category(spark):
    df = spark.range(2000).selectExpr("IF(id < 5, CONCAT('r', id), 'usual') AS s")
    got = flags_of(quality.rare_category, df)[0]
    assert got["value"] == 5 and "'r0', 'r1', 'r2' (+2 more)" in got["message"]
    assert flags_of(quality.rare_category, spark.range(99).selectExpr("CONCAT('r', id) AS s")) == []
    at = spark.range(200).selectExpr("IF(id = 0, 'r', 'u') AS s")
    assert flags_of(quality.rare_category, at) == []


def test_class_imbalance(spark):
    def severities(df, target):
        return [f["severity"] for f in flags_of(quality.class_imbalance, df, target=target)]

    df = spark.range(110).selectExpr("IF(id < 9, 1, 0) AS ten", "IF(id < 20, 1, 0) AS four", "id % 2 AS two")
    assert severities(df, classify_target(df, "ten")) == ["HIGH"]
    assert severities(df, classify_target(df, "four")) == ["MEDIUM"]
    assert severities(df, classify_target(df, "two")) == []
    assert severities(df, detect_target(df)) == ["LOW"]
    assert severities(df, Target(None)) == []
    prices = spark.range(100).selectExpr("IF(id < 90, 1, 1000) AS target_price", "id AS x")
    assert severities(prices, Target("target_price", "regression")) == ["MEDIUM"]


def status(df, **kwargs):
    return quality.quality_status(quality.run_quality_rules(Profile(df, **kwargs))).first()


def test_status(spark):
    clean = spark.range(40).selectExpr("id % 7 AS a", "(id * 13) % 11 AS b", "CONCAT('s', id % 3) AS s")
    row = status(clean, duplicates=0)
    assert (row["status"], row["flags"]) == ("APPROVED", 0)
    low = status(spark.range(40).selectExpr("id AS a"))
    assert (low["status"], low["flags"], low["blocking_flags"]) == ("APPROVED", 1, 0)
    assert status(spark.range(40).selectExpr("id AS a", "3 AS k"))["status"] == "REVISION_NEEDED"


def test_nested_and_empty_tables(spark):
    nested = spark.range(40).selectExpr("id % 5 AS a", "named_struct('k', id % 3) AS s", "array(1) AS l")
    rules = {f["rule"] for f in quality.run_quality_rules(Profile(nested)).collect()}
    assert "single_value_categorical" in rules
    empty = spark.createDataFrame([], "a double, s string")
    assert status(empty)["status"] == "APPROVED"


def test_own_rule(spark):
    def always(p):
        return p.spark.createDataFrame(
            [(0, 1, None, "always", "LOW", "here", float(p.n_rows), "")], quality.flags_schema()
        )

    quality.register_rule(always)
    try:
        got = quality.run_quality_rules(Profile(spark.range(3))).filter("rule = 'always'").first()
    finally:
        quality.unregister_rule(always)
    assert (got["rule_no"], got["value"]) == (15, 3.0)


def test_unresolved(spark):
    df = spark.range(40).selectExpr("id AS a", "3 AS k")
    flags = quality.run_quality_rules(Profile(df))
    assert {f["severity"] for f in quality.unresolved_flags(flags).collect()} == {"HIGH"}
    assert quality.unresolved_flags(flags, final_pass=False).count() == 0
