import pytest

from tabscope.operators import target as tg
from tabscope.plans.few import few_values, without_repeats
from tabscope.plans.widest import widest_pairs
from tabscope.operators import target_analysis as ta
from tests.conftest import by


@pytest.mark.parametrize(
    "columns, expected",
    [
        (["a", "Target"], "Target"),
        (["label", "target"], "target"),
        (["my_class", "x_target"], "x_target"),
        (["y", "outcome"], "y"),
        (["is_paid", "default_flag"], "default_flag"),
        (["has_car", "is_paid"], "is_paid"),
    ],
)
def test_detect_by_name(spark, columns, expected):
    df = spark.range(30).selectExpr(*[f"id % 3 AS {c}" for c in columns])
    found = tg.detect_target(df)
    assert (found.column, found.detection_method) == (expected, "name_heuristic")


def test_detect_by_place_and_not_at_all(spark):
    df = spark.range(100).selectExpr("id % 4 AS a", "id % 9 AS b", "id AS c", "id % 10 AS d")
    found = tg.detect_target(df)
    assert (found.column, found.detection_method) == ("b", "position_heuristic")
    none = tg.detect_target(df.select("c", "d"))
    assert none.column is None and none.problem_type == "unsupervised"


def test_classify(spark):
    df = spark.range(100).selectExpr(
        "id % 10 AS ten", "id % 11 AS eleven", "CAST(id AS STRING) AS s", "CAST(NULL AS INT) AS n",
        "IF(id < 10, 1, 0) AS b",
    )
    assert tg.classify_target(df, "ten").problem_type == "classification"
    assert tg.classify_target(df, "eleven").problem_type == "regression"
    text = tg.classify_target(df, "s")
    assert text.problem_type == "classification" and text.n_classes == 100
    assert tg.classify_target(df, "n").n_classes == 0
    assert tg.classify_target(df, "b").imbalance_ratio == 9.0
    rows = tg.target_table(df, tg.classify_target(df, "b")).collect()
    assert {r["class"]: r["class_count"] for r in rows} == {"0": 90, "1": 10}
    none = tg.target_table(df, tg.resolve_target(df, no_target=True)).collect()
    assert [(r["class"], r["class_count"]) for r in none] == [(None, None)]
    assert tg.target_table(df, tg.classify_target(df, "n")).count() == 1


def test_all_of_many_classes(spark):
    df = spark.range(3000).selectExpr("CONCAT('k', id % 1200) AS kind")
    assert tg.target_table(df, tg.classify_target(df, "kind")).count() == 1200


def test_one_bad_date_anywhere(spark):
    good = spark.range(500).selectExpr("CONCAT('2021-01-', LPAD(id % 28 + 1, 2, '0')) AS start_date", "id")
    bad = good.selectExpr("IF(id = 400, 'later', start_date) AS start_date")
    assert tg.has_datetime_column(good) and not tg.has_datetime_column(bad)


def test_few_values_are_exact(spark):
    df = spark.range(5000).repartition(7).selectExpr(
        "id % 9 AS nine", "id % 10 AS ten", "CAST(NULL AS INT) AS none", "id", "IF(id % 2 = 0, 'x', NULL) AS one"
    )
    assert few_values(df, df.columns, 9) == {"nine": 9, "none": 0, "one": 1}
    assert without_repeats(df, df.columns[:4]) == ["id"]


def test_unknown_target(spark):
    with pytest.raises(ValueError):
        tg.resolve_target(spark.range(3), "nope")


def test_datetime_columns(spark):
    dates = spark.createDataFrame([("2020-01-01",), ("2020-05-02",)], "order_date string")
    words = spark.createDataFrame([("soon",), ("later",)], "order_date string")
    assert tg.has_datetime_column(dates) and not tg.has_datetime_column(words)
    assert tg.has_datetime_column(spark.sql("SELECT current_date() AS d"))
    assert not tg.has_datetime_column(spark.createDataFrame([("2020-01-01",)], "s string"))


def test_low_cardinality_profiles(spark):
    df = spark.range(60).selectExpr(
        "id % 2 + 1 AS SEX", "id % 4 + 1 AS EDUCATION", "id + 22 AS AGE", "id * 1000.5D AS SALARY",
        "'n' AS name", "CAST(NULL AS DOUBLE) AS gone", "id % 31 AS over", "id % 30 / 2 AS at_limit",
    )
    got = by(tg.low_cardinality_profiles(df))
    assert set(got) == {"SEX", "EDUCATION", "gone", "at_limit"}
    assert got["EDUCATION"]["sample_values"] == [1.0, 2.0, 3.0, 4.0]
    assert len(got["at_limit"]["sample_values"]) == 15 and not got["at_limit"]["is_all_integer"]
    assert got["gone"]["nunique"] == 0 and got["gone"]["n_rows"] == 60
    assert "SEX" not in by(tg.low_cardinality_profiles(df, target="SEX"))
    listed = tg.match_encoded_suspects(tg.low_cardinality_profiles(df), categoricals=["SEX", "AGE"])
    assert [r["column"] for r in listed.collect()] == ["SEX"]
    assert tg.match_encoded_suspects(listed, categoricals=["SEX"], enabled=False).count() == 0


def test_binarise(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 0, 2.0), ("b", None, None), ("b", 1, 4.0)], "s string, n int, x double"
    )

    def positives(name):
        found = tg.classify_target(df, name)
        return [r["positive"] for r in tg.binarise_target(df, found).collect()]

    assert positives("s") == [0.0, 0.0, 1.0, 1.0]
    assert positives("n") == [1.0, 0.0, None, 1.0]
    regression = tg.Target("x", "regression")
    assert [r["positive"] for r in tg.binarise_target(df, regression).collect()] == [0, 1, 0, 1]


def test_class_shares_count_missing_targets(frame):
    got = by(ta.class_distribution(frame(y=["a", "a", "b", None]), "y"), "class")
    assert got["a"]["pct"] == 50.0 and got["b"]["pct"] == 25.0 and len(got) == 2
    assert ta.imbalance(ta.class_distribution(frame(y=["a", "a", "b"]), "y")).first()["band"] == "moderate"


def test_cohens_d_top_ten(spark):
    rows = []
    for i in range(15):
        for c, shift in (("p", 0.0), ("q", 5.0)):
            rows.append((c, f"f{i}", 10, i * 10 + shift, 5.0))
    stats = spark.createDataFrame(rows, "class string, feature string, n long, mean double, std double")
    ranked = ta.cohens_d_ranking(stats, [f"f{i}" for i in range(15)]).orderBy("place").collect()
    assert [r["feature"] for r in ranked] == [f"f{i}" for i in range(10)]
    assert all(r["cohens_d"] == 1.0 for r in ranked)


def test_cohens_d_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [
        (f"c{k}", f, 5, round(float(rng.normal(0, 5)), 2), float(rng.choice([0, 0, 0.5, 1.0, 2.5])))
        for k in range(60)
        for f in ("x", "y", "z")
    ] + [("only", "w", 1, 3.0, None)]
    stats = spark.createDataFrame(rows, "class string, feature string, n long, mean double, std double")
    got = {r["feature"]: r["cohens_d"] for r in ta.cohens_d_ranking(stats, list("xyzw")).collect()}
    for f in "xyz":
        part = [(m, s) for _, g, _, m, s in rows if g == f]
        best = max(
            abs(m1 - m2) / ((s1 * s1 + s2 * s2) / 2) ** 0.5 if s1 or s2 else 0.0
            for m1, s1 in part
            for m2, s2 in part
        )
        assert got[f] == pytest.approx(best)
    assert got["w"] == 0.0


def test_widest_distance_among_two_sided_classes(spark):
    """Spread grows with the distance from zero on both sides, so many classes are unbeaten."""
    rows = [(f"c{i}", "f", (i - 200) * 1.0, 0.5 + abs(i - 200) ** 1.2) for i in range(401)]
    stats = spark.createDataFrame(rows, "class string, feature string, mean double, std double")
    want = max(
        abs(a[2] - b[2]) / ((a[3] ** 2 + b[3] ** 2) / 2) ** 0.5 for a in rows for b in rows if a is not b
    )
    assert ta.cohens_d_ranking(stats, ["f"]).first()["cohens_d"] == pytest.approx(want)


def _widest(rows):
    """All pairs in blocks."""
    import numpy as np

    m, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    best = 0.0
    for i in range(len(m)):
        pooled = np.sqrt((s * s + s[i] * s[i]) / 2)
        d = np.divide(np.abs(m - m[i]), pooled, out=np.zeros_like(m), where=pooled > 0)
        best = max(best, d.max())
    return best


@pytest.mark.parametrize("kind", ["two-sided", "cloud", "heavy", "ties", "flat", "one"])
def test_branch_and_bound_equals_all_pairs(spark, kind):
    import numpy as np

    r = np.random.default_rng(8)
    n = 3000
    m = np.arange(n) - n / 2
    rows = {
        "two-sided": list(zip(m, 0.5 + np.abs(m) ** 1.01)),
        "cloud": list(zip(r.normal(size=n), 0.1 + r.random(n))),
        "heavy": list(zip(r.standard_cauchy(n) ** 3, np.exp(6 * r.normal(size=n)))),
        "ties": list(zip(r.integers(0, 3, n) * 1.0, r.integers(0, 3, n) * 1.0)),
        "flat": [(float(i), 0.0) for i in range(n)],
        "one": [(1.5, 2.0)],
    }[kind]
    df = spark.createDataFrame([("f", float(a), float(b)) for a, b in rows] + [("g", 1.0, None)], "feature string, mean double, std double")
    got = {x["feature"]: x for x in widest_pairs(df).collect()}
    assert set(got) <= {"f"} and (got["f"]["d"] if got else 0.0) == pytest.approx(_widest(rows), rel=1e-12)
    if got and n == len(rows):
        assert got["f"]["compared"] < n * n / 10


def test_compared_pairs_stay_few_for_many_two_sided_classes(spark):
    """Spread grows in proportion to the mean on both sides: all classes are unbeaten."""
    half = 50_000
    df = spark.range(-half, half).selectExpr("'f' AS feature", "double(id) AS mean", "double(10 + abs(id)) AS std")
    row = widest_pairs(df).first()
    want = max((i + i) / (10 + i) for i in (half - 1, half)) * 1.0
    assert row["d"] == pytest.approx(want, rel=1e-3) and row["d"] >= want * (1 - 1e-4)
    assert row["compared"] < 4_000_000  # of 10 000 000 000
