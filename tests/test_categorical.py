import math

import pytest

from tabscope.operators import categorical, correlate
from tabscope.plans.counts import value_counts
from tabscope.plans import pairs
from tabscope.plans.pairs import pair_correlations
from tabscope.plans.moments import basic_stats
from tests.conftest import by


def test_summary(spark):
    df = spark.range(1000).selectExpr(
        "CONCAT('v', IF(id < 4, 100 + id, id % 4)) AS s", "CAST(NULL AS STRING) AS gone", "id % 2 = 0 AS b"
    )
    got = by(categorical.categorical_summary(df))
    assert (got["s"]["cardinality"], got["s"]["rare_count"]) == (8, 4)
    assert got["s"]["entropy_bits"] <= math.log2(8)
    assert (got["gone"]["cardinality"], got["gone"]["entropy_bits"]) == (0, 0.0)
    assert got["b"]["entropy_bits"] == 1.0


def test_top_values_and_more(spark):
    df = spark.range(120).selectExpr("CAST(id % 12 AS STRING) AS s")
    top = categorical.top_values(df).orderBy("rank").collect()
    assert len(top) == 10 and [r["value"] for r in top][:3] == ["0", "1", "10"]
    assert by(categorical.categorical_summary(df))["s"]["more_values"] == 2


def test_one_value_holds_most_rows(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 < 2, 'hot', CAST(id AS STRING)) AS s").repartition(6)
    got = by(categorical.categorical_summary(df))["s"]
    top = categorical.top_values(df, n=1).first()
    hot = sum(1 for i in range(5000) if i % 3 < 2)
    assert (top["value"], top["count"]) == ("hot", hot)
    assert got["cardinality"] == 5000 - hot + 1 and got["rare_count"] == 5000 - hot


def test_rates_leave_missing_targets_out(spark):
    df = spark.createDataFrame(
        [("a", "yes"), ("a", "no"), ("a", None), ("b", "yes"), ("c", None)], "s string, y string"
    )
    got = {(r["value"], r["class"]): r for r in categorical.target_rates(df, "y", ["s"]).collect()}
    assert got[("a", "yes")]["rate"] == 50.0 and got[("a", "yes")]["count"] == 3
    assert got[("b", "yes")]["rate"] == 100.0 and not any(k[0] == "c" for k in got)


def test_rates_with_columns_named_like_results(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "`column` string, value string")
    got = categorical.target_rates(df, "value", ["column"]).collect()
    assert sorted((r["column"], r["value"], r["class"]) for r in got) == [
        ("column", "a", "x"), ("column", "b", "y"),
    ]


def test_anomalous_rate_uses_weighted_column_rate(spark):
    rates = spark.createDataFrame(
        [("s", 1, "A", 200, "1", 20, 10.0), ("s", 2, "B", 100, "1", 80, 80.0)],
        "column string, rank int, value string, count long, class string, class_count long, rate double",
    )
    got = categorical.anomalous_rates(rates).collect()
    flagged = {r["value"]: r for r in got}
    assert flagged["B"]["column_rate"] == pytest.approx(33.3333, abs=1e-3)
    assert flagged["B"]["ratio"] == pytest.approx(2.4) and "A" in flagged


@pytest.mark.parametrize("n, margin, level", [(16, 24.0, "VERY_LOW_N"), (30, 18.0, "LOW_N"), (99, 10.0, "LOW_N")])
def test_reliability(spark, n, margin, level):
    df = spark.createDataFrame([("s", "v", n)], "column string, value string, count long")
    row = categorical.rate_reliability(df).first()
    assert (row["margin_pp"], row["level"]) == (margin, level)


def test_reliability_stops_at_hundred(spark):
    df = spark.createDataFrame([("s", "v", 100)], "column string, value string, count long")
    assert categorical.rate_reliability(df).count() == 0


def test_values_of_other_types(spark):
    df = spark.sql("SELECT true AS b, 1.5D AS d, 3 AS i")
    assert {r["value"] for r in value_counts(df, ["b", "d", "i"]).collect()} == {"true", "1.5", "3"}


@pytest.mark.parametrize("block", [256, 2, 1])
def test_pairwise_complete_correlation(spark, monkeypatch, block):
    """One tile, or many with blocks of a few columns."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(pairs, "COLUMNS_PER_BLOCK", block)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(0, 1, (300, 5)), columns=list("abcde"))
    pdf["b"] += pdf["a"]
    pdf["k"] = 3.0
    pdf["none"] = np.nan
    pdf.loc[::3, "a"] = None
    pdf.loc[1::4, "c"] = None
    pdf.loc[:150, "d"] = None
    pdf.loc[149:, "e"] = None
    df = spark.createDataFrame(pdf)
    want = pdf.corr()
    rows = pair_correlations(df).collect()
    assert len(rows) == 21
    for r in rows:
        expected = want.loc[r["col_a"], r["col_b"]]
        assert r["n"] == (pdf[r["col_a"]].notna() & pdf[r["col_b"]].notna()).sum()
        if np.isnan(expected):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(expected, abs=1e-12)
    matrix = {(r["col_a"], r["col_b"]): r["r"] for r in correlate.correlation_matrix(df).collect()}
    assert matrix[("a", "a")] == 1.0 and matrix[("k", "k")] is None
    assert matrix[("b", "a")] == matrix[("a", "b")] == round(want.loc["a", "b"], 4)


def test_given_pairs_far_values_and_empty_tables(spark):
    df = spark.range(1000).selectExpr("id AS x", "1e12D + id % 7 AS far", "-id AS down", "id % 7 AS near")
    got = {(r["col_a"], r["col_b"]): r for r in pair_correlations(df, pairs=[("x", "down"), ("far", "near")]).collect()}
    assert set(got) == {("x", "down"), ("far", "near")}
    assert got["x", "down"]["r"] == -1.0 and got["far", "near"]["r"] == pytest.approx(1.0, abs=1e-6)
    none = pair_correlations(df.limit(0)).collect()
    assert [(r["n"], r["r"]) for r in none] == [(0, None)] * 6


def test_a_tile_reads_only_its_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "COLUMNS_PER_BLOCK", 2)
    spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(6)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tile = pairs._tile(df, df.columns, [(0, 4), (1, 5)], basic_stats(df))
    plan = tile._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c0:bigint,c1:bigint,c4:bigint,c5:bigint>" in plan and tile.count() >= 2


def test_column_constant_inside_shared_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 3.0), (5.0, None)], "a double, b double")
    assert pair_correlations(df).first()["r"] is None


def test_strength_and_collinearity(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 9, 0.95), ("a", "c", 9, -0.71), ("a", "d", 9, 0.5), ("b", "c", 9, 0.31),
         ("b", "d", 9, None), ("c", "d", 9, 1.0)],
        "col_a string, col_b string, n long, r double",
    )
    labels = {(r["col_a"], r["col_b"]): r["strength"] for r in correlate.ranked_pairs(pairs).collect()}
    assert labels[("a", "b")] == "VERY STRONG" and labels[("a", "c")] == "STRONG"
    assert labels[("a", "d")] == "WEAK" and labels[("b", "d")] == "NEGLIGIBLE"
    assert correlate.strongest_pair(pairs).first()["col_a"] == "c"
    close = correlate.collinear_pairs(pairs).collect()
    assert [r["vif"] for r in close] == [5000.3, 10.3]


def test_spearman_ranks_inside_pairs(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({c: rng.integers(0, 6, 200).astype(float) for c in "abc"})
    pdf["b"] = pdf["a"] + rng.integers(0, 2, 200)
    pdf.loc[::5, "a"] = None
    df = spark.createDataFrame(pdf)
    want = pdf.corr("spearman")
    for r in correlate.spearman_pairs(df, list("abc")).collect():
        assert r["rho"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], abs=1e-12)
    assert correlate.ordinal_spearman(df, ["a"]).count() == 0
    only = correlate.ordinal_spearman(df, ["a", "b", "c"], {"a": "ordinal", "b": "ordinal", "c": "nominal"})
    assert only.count() == 1


def test_notable_pairs(spark):
    pairs = spark.createDataFrame(
        [("A", "B", 5, 0.82), ("B", "C", 5, -0.55), ("A", "C", 5, 0.3)],
        "col_a string, col_b string, n long, rho double",
    )
    assert [r["rho"] for r in correlate.notable_ordinal_pairs(pairs).collect()] == [0.82, -0.55]


def test_feature_target_correlation(spark):
    df = spark.range(50).selectExpr("id AS size", "id % 7 AS rooms", "id * 1000.0D AS price", "1 AS flat")
    got = by(correlate.feature_target_correlation(df, "price"), "feature")
    assert got["size"]["r"] == 1.0 and got["size"]["place"] == 1 and got["flat"]["r"] == 0.0


@pytest.mark.parametrize("bound", [2_000_000, 3])
def test_columns_missing_in_the_same_rows_share_a_ranking(spark, monkeypatch, bound):
    """Three kinds of missing rows; only pairs across them are ranked for themselves."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(correlate, "RANKED_VALUES", bound)
    asked = []
    real = correlate._by_pair
    monkeypatch.setattr(correlate, "_by_pair", lambda numbers, pairs: (asked.extend(pairs), real(numbers, pairs))[1])
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: rng.integers(0, 5, 200) * 1.0 for c in "abcdefg"})
    pdf["b"] += pdf["a"]
    pdf["k"] = 1.0
    pdf.loc[::3, ["c", "d"]] = None
    pdf.loc[1::3, "e"] = None
    pdf.loc[:150, "f"] = None
    pdf.loc[150:, "g"] = None
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r for r in correlate.spearman_pairs(df, list("abcdefgk")).collect()}
    want = pdf.corr("spearman")
    assert ("f", "g") not in got and len(got) == 27
    for (a, b), r in got.items():
        assert r["n"] == (pdf[a].notna() & pdf[b].notna()).sum()
        assert (r["rho"] is None) == np.isnan(want.loc[a, b]) and (r["rho"] is None or r["rho"] == pytest.approx(want.loc[a, b], abs=1e-12))
    alike = {("a", "b"), ("c", "d"), ("a", "k"), ("b", "k")}
    assert (alike & set(asked) == set()) == (bound > 3)


def test_thirty_complete_columns_shuffle_their_values_once(spark, monkeypatch):
    seen = []
    real = correlate.materialise
    monkeypatch.setattr(correlate, "materialise", lambda df, name: (seen.append((name, df)), real(df, name))[1])
    monkeypatch.setattr(correlate, "_by_pair", None)
    df = spark.range(300).selectExpr(*[f"(id * {i + 3}) % 7 AS c{i}" for i in range(30)])
    assert correlate.spearman_pairs(df, df.columns).count() == 435
    cells = {name: df for name, df in seen}["column-values"]
    assert cells.count() <= 30 * 7 and cells.agg({"n": "sum"}).first()[0] == 30 * 300
