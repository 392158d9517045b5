import math

import numpy as np
import pandas as pd
import pytest

from tabscope.functions import tails
from tabscope.operators import associate
from tabscope.operators import mutual_info as mi
from tabscope.operators.target import Target, classify_target
from tabscope.plans import cells
from tests.conftest import by


def test_tails():
    assert tails.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-7)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.f_tail(0.0, 3, 9) == 1.0 and tails.chi2_tail(0.0, 2) == 1.0
    assert tails.chi2_tail(900.0, 400) == pytest.approx(tails.gamma_upper(200.0, 450.0))
    assert tails.t_two_sided(math.inf, 5) == 0.0
    for x in (0.1, 1.0, 5.0, 40.0, 300.0):
        assert tails.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert tails.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)


@pytest.mark.parametrize("n", [1e2, 1e5, 1e6, 1e7, 1e10, 1e12, 1e14])
def test_tails_at_large_degrees_of_freedom(n):
    """Nine digits: closed forms of F, the first term beside the normal limit for t, symmetry."""
    for f in (0.1, 1.0, 3.0, 12.0):
        assert tails.f_tail(f, 2, n) == pytest.approx(math.exp(-n / 2 * math.log1p(2 * f / n)), rel=1e-9)
        # I_x(a, 2) = x^a (1 + a (1 - x)) with a = n / 2.
        want = math.exp(-n / 2 * math.log1p(4 * f / n)) * (1 + n / 2 * 4 * f / (n + 4 * f))
        assert tails.f_tail(f, 4, n) == pytest.approx(want, rel=2e-9)
    for t in (0.5, 2.0, 4.0):
        normal = math.erfc(t / math.sqrt(2))
        first = (t**3 + t) / (2 * n) * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        assert tails.t_two_sided(t, n) == pytest.approx(normal + first, rel=1e-9 + max(1, t**8) / n**2)
    if n <= 1e10:
        assert tails.f_tail(1.0, n, n) == pytest.approx(0.5, abs=1e-9)
        half = tails.f_tail(1 + 1 / math.sqrt(n), n, n) + tails.f_tail(1 / (1 + 1 / math.sqrt(n)), n, n)
        assert half == pytest.approx(1.0, abs=1e-9)


def test_tails_equal_finite_sums():
    from decimal import Decimal, getcontext

    getcontext().prec = 50
    for df in (2, 20, 400, 20_000):
        for share in (0.7, 0.99, 1.0, 1.02, 1.3):
            rate = Decimal(df * share) / 2
            term = total = (-rate).exp()
            for k in range(1, df // 2):
                term = term * rate / k
                total += term
            assert tails.chi2_tail(df * share, df) == pytest.approx(float(total), rel=1e-9, abs=1e-300)
    for a, b in ((12, 15), (50, 10), (300, 700), (5000, 4000), (3, 900)):
        for d in (-0.05, -0.01, 0.0, 0.01, 0.05):
            x = Decimal(a / (a + b) + d)
            if 0 < x < 1:
                term = total = Decimal(math.comb(a + b - 1, a)) * x**a * (1 - x) ** (b - 1)
                for k in range(a + 1, a + b):
                    term = term * (a + b - k) / k * x / (1 - x)
                    total += term
                assert tails.beta_regularised(a, b, float(x)) == pytest.approx(float(total), rel=1e-9, abs=1e-15)


def eta(df, target, numeric):
    return by(associate.eta_squared(associate.group_moments_by_class(df, target, numeric)), "feature")


def test_eta_squared(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0, 5.0), ("a", 1.0, 2.0, 5.0), ("b", 9.0, 3.0, 5.0), ("b", 9.0, 5.0, 5.0)],
        "y string, apart double, mixed double, flat double",
    )
    got = eta(df, "y", ["apart", "mixed", "flat"])
    assert got["apart"]["effect_size"] == 1.0 and math.isinf(got["apart"]["statistic"])
    assert got["apart"]["p_value"] == 0.0
    # means 1.5 and 4, within 0.5 + 2, between 6.25
    assert got["mixed"]["effect_size"] == pytest.approx(6.25 / 8.75, abs=1e-6)
    assert got["mixed"]["statistic"] == pytest.approx(5.0)
    assert got["mixed"]["p_value"] == pytest.approx(tails.f_tail(5.0, 1, 2), abs=1e-6)
    assert (got["flat"]["effect_size"], got["flat"]["statistic"], got["flat"]["p_value"]) == (0, 0, 1)
    one = eta(df.filter("y = 'a'"), "y", ["mixed"])["mixed"]
    assert (one["effect_size"], one["statistic"], one["p_value"]) == (0.0, 0.0, 1.0)


def test_eta_squared_keeps_digits_far_from_zero(spark):
    df = spark.range(1000).selectExpr("id % 2 AS y", "1e9D + (id % 2) + (id % 5) / 10 AS x")
    got = eta(df, "y", ["x"])["x"]["effect_size"]
    near = eta(df.selectExpr("y", "x - 1e9D AS x"), "y", ["x"])["x"]["effect_size"]
    assert got == pytest.approx(near, abs=1e-6) and near > 0.5


def test_cramers_v(spark):
    diagonal = spark.range(30).selectExpr("IF(id < 15, 'p', 'q') AS s", "IF(id < 15, 'u', 'v') AS y")
    row = associate.cramers_v(diagonal, "y", ["s"]).first()
    assert row["statistic"] == pytest.approx(26.1333, abs=1e-4)
    assert row["effect_size"] == pytest.approx(0.933333, abs=1e-6)
    free = spark.range(36).selectExpr("CONCAT('s', id % 3) AS s", "CONCAT('y', id DIV 3 % 4) AS y")
    row = associate.cramers_v(free, "y", ["s"]).first()
    assert (row["effect_size"], row["statistic"], row["p_value"]) == (0.0, 0.0, 1.0)
    three = spark.range(30).selectExpr("CONCAT('s', id % 3) AS s", "CONCAT('y', id % 3) AS y")
    row = associate.cramers_v(three, "y", ["s"]).first()
    assert (row["effect_size"], row["statistic"]) == (1.0, 60.0)
    assert associate.cramers_v(diagonal.selectExpr("'k' AS s", "y"), "y", ["s"]).count() == 0


def test_cramers_v_counts_absent_cells(spark):
    table = np.array([[10, 0, 5], [3, 8, 0]])
    rows = [(f"r{i}", f"c{j}") for (i, j), n in np.ndenumerate(table) for _ in range(n)]
    row = associate.cramers_v(spark.createDataFrame(rows, "s string, y string"), "y", ["s"]).first()
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert row["statistic"] == pytest.approx(chi2, abs=1e-4)


def test_pearson_effect(spark):
    df = spark.range(12).selectExpr("id AS x", "-2.0D * id AS down", "id % 5 AS part", "1 AS flat")
    got = by(associate.pearson_effect(df, "x", ["down", "part", "flat"]), "feature")
    assert got["down"]["effect_size"] == 1.0 and got["down"]["p_value"] == 0.0
    r = np.corrcoef(np.arange(12), np.arange(12) % 5)[0, 1]
    assert got["part"]["effect_size"] == pytest.approx(abs(r), abs=1e-6)
    t = abs(r) * math.sqrt(10 / (1 - r * r))
    assert got["part"]["p_value"] == pytest.approx(tails.t_two_sided(t, 10), abs=1e-6)
    assert (got["flat"]["effect_size"], got["flat"]["p_value"]) == (0.0, 1.0)


def _psi(n):
    return float(mi.digamma(int(n)))


def test_digamma():
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 2000))])
    assert mi.digamma(np.arange(1, 2001)) == pytest.approx(harmonic - np.euler_gamma, abs=1e-11)


def _brute_discrete(x, y, k=3):
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        own = np.sort(np.abs(x[(y == y[i]) & (np.arange(len(x)) != i)] - x[i]))
        kk = min(k, len(own))
        total += _psi(kk) - _psi(len(own) + 1) - _psi(max(np.sum(np.abs(x - x[i]) < own[kk - 1]), 1))
    return max(0.0, _psi(len(x)) + total / len(x))


def _brute_continuous(x, y, k=3):
    n, total = len(x), 0.0
    for i in range(n):
        others = np.arange(n) != i
        dx, dy = np.abs(x - x[i])[others], np.abs(y - y[i])[others]
        d = np.sort(np.maximum(dx, dy))[k - 1]
        total += _psi(np.sum(dx < d) + 1) + _psi(np.sum(dy < d) + 1)
    return max(0.0, _psi(n) + _psi(k) - total / n)


@pytest.mark.parametrize("rows", [250_000, 70, 9])
def test_estimators_equal_brute_force(spark, monkeypatch, rows):
    """Parts that hold everything, some or hardly any of a feature."""
    monkeypatch.setattr(mi, "ROWS_PER_PART", rows)
    monkeypatch.setattr(cells, "ROWS_PER_CELL", rows)
    rng = np.random.default_rng(rows)
    n = 260
    y = rng.choice(["a", "b", "c", "d", "e"], n, p=[0.5, 0.3, 0.18, 0.015, 0.005])
    x = rng.normal(0, 1, n) + (y == "a") * 1.5
    # Levels that differ by much less than they lie apart, and a far outlier.
    steps = np.round(x) + 1e-4 * rng.random(n)
    far = np.where(np.arange(n) == 17, 1e3, rng.exponential(1, n))
    z = 0.7 * x + rng.normal(0, 0.6, n)
    pdf = pd.DataFrame({"id": range(n), "x": x, "steps": steps, "far": far, "z": z, "y": y, "flat": 0.0})
    df = spark.createDataFrame(pdf)
    classes = mi.mutual_information(df, "y", "classification", ["x", "steps", "far", "flat"], [], ["id"])
    got = {r["feature"]: r["mi_score"] for r in classes.collect()}
    for c in ("x", "steps", "far"):
        assert got[c] == pytest.approx(_brute_discrete(pdf[c].to_numpy(), y), abs=1e-6)
    assert got["flat"] == 0.0
    numbers = mi.mutual_information(df, "z", "regression", ["x", "steps", "far", "flat"], [], ["id"])
    got = {r["feature"]: r["mi_score"] for r in numbers.collect()}
    for c in ("x", "steps", "far"):
        unit = pdf[c].to_numpy() / np.std(pdf[c].to_numpy())
        assert got[c] == pytest.approx(_brute_continuous(unit, z / np.std(z)), abs=1e-6)
    assert got["flat"] == 0.0


def test_a_sample_only_on_request(spark):
    df = spark.range(400).selectExpr("id", "id % 2 AS c", "(id % 2) * 10 + id / 1000 AS x")
    whole = mi.mutual_information(df, "c", "classification", ["x"], [], ["id"]).first()["mi_score"]
    part = mi.mutual_information(df, "c", "classification", ["x"], [], ["id"], max_rows=100).first()["mi_score"]
    assert whole == pytest.approx(math.log(2), abs=0.01) and part != whole


def test_information_of_known_relations(spark):
    rng = np.random.default_rng(9)
    n = 4000
    x = rng.normal(0, 1, n)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "noise": rng.normal(0, 1, n), "close": 0.8 * x + 0.6 * rng.normal(0, 1, n),
            "y": x, "square": x * x, "c": np.where(x > 0, "hi", "lo"),
        }
    )
    df = spark.createDataFrame(pdf)
    got = {
        r["feature"]: r["mi_score"]
        for r in mi.mutual_information(df, "y", "regression", ["noise", "close", "square"], [], ["id"]).collect()
    }
    # Two jointly normal variables share -log(1 - r^2) / 2 nats.
    assert got["noise"] < 0.05
    assert got["close"] == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.05)
    assert got["square"] > 1.0
    classes = {
        r["feature"]: r["mi_score"]
        for r in mi.mutual_information(df, "c", "classification", ["y", "noise"], ["c"], ["id"]).collect()
    }
    assert classes["y"] == pytest.approx(math.log(2), abs=0.02) and classes["noise"] < 0.03
    assert classes["c"] == pytest.approx(math.log(2), abs=0.02)


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    assert mi.mutual_information(df, "y", "classification", ["x"], []).first()["mi_score"] == 0.0


def _table(spark, n=600):
    rng = np.random.default_rng(12)
    y = rng.choice(["no", "yes"], n)
    yes = y == "yes"
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "id": [f"k{i}" for i in range(n)],
                "strong": yes * 4.0 + rng.normal(0, 1, n),
                "ring": np.where(yes, rng.normal(0, 0.3, n), rng.choice([-3.0, 3.0], n) + rng.normal(0, 0.3, n)),
                "noise": rng.normal(0, 1, n),
                "kind": np.where(rng.random(n) < 0.9, np.where(yes, "p", "q"), "r"),
                "y": y,
            }
        )
    ).select("strong", "ring", "noise", "kind", "y", "id")


def test_feature_associations(spark):
    df = _table(spark)
    data = df.drop("id")
    ranked = associate.feature_associations(data, classify_target(data, "y")).orderBy("place").collect()
    got = {r["feature"]: r for r in ranked}
    assert [r["place"] for r in ranked] == [1, 2, 3, 4]
    assert got["strong"]["effect_size_type"] == "eta2" and got["kind"]["effect_size_type"] == "cramer_v"
    assert got["noise"]["place"] == 4 and got["noise"]["effect_size_label"] == "weak"
    assert all(r["borda_score"] == r["mi_rank"] + r["effect_size_rank"] for r in ranked)
    assert [r["borda_score"] for r in ranked] == sorted(r["borda_score"] for r in ranked)
    assert got["strong"]["missingness_strategy"] == "complete-case: N=600, 100.0% retained"
    assert got["strong"]["mi_sample_size"] is None and got["strong"]["total_features"] == 4
    again = associate.feature_associations(data.repartition(5), classify_target(data, "y"))
    assert sorted(r["mi_score"] for r in again.collect()) == sorted(r["mi_score"] for r in ranked)
    quadrants = {
        r["feature"]: r["quadrant"] for r in associate.association_quadrants(
            associate.feature_associations(data, classify_target(data, "y"))
        ).collect()
    }
    assert quadrants.get("ring") == "NONLINEAR SIGNAL"


def test_sampled_associations(spark):
    df = _table(spark)
    target = classify_target(df, "y")
    got = associate.feature_associations(df.drop("id"), target, max_rows=300).first()
    assert got["mi_sample_size"] == 300 and "300 of 600" in got["mi_sample_note"]


def test_top_n_and_empty_cases(spark):
    df = _table(spark).drop("id")
    target = classify_target(df, "y")
    assert associate.feature_associations(df, target, top_n=2).count() == 2
    assert associate.feature_associations(df, Target(None)).count() == 0
    assert associate.feature_associations(df.select("y"), target).count() == 0


def test_regression_and_encoded_features(spark):
    df = spark.range(400).selectExpr(
        "(id * 37) % 400 AS x", "((id * 37) % 400) * 2.0D + id % 3 AS price", "id % 4 AS grade"
    )
    got = by(
        associate.feature_associations(df, classify_target(df, "price"), encoded=["grade"]), "feature"
    )
    assert got["x"]["effect_size_type"] == "pearson_r" and got["x"]["place"] == 1
    assert got["grade"]["effect_size_type"] == "eta2" and got["grade"]["feature_type"] == "categorical"


@pytest.mark.parametrize(
    "mi_rank, label, expected",
    [(1, "weak", "NONLINEAR SIGNAL"), (2, "strong", "SUSPICIOUS ASSOCIATION"), (1, "strong", None),
     (2, "weak", None), (1, "moderate", None)],
)
def test_quadrants(spark, mi_rank, label, expected):
    df = spark.createDataFrame(
        [("f", mi_rank, 0.5, label, 2)],
        "feature string, mi_rank int, effect_size double, effect_size_label string, total_features int",
    )
    got = [r["quadrant"] for r in associate.association_quadrants(df).collect()]
    assert got == ([expected] if expected else [])


def test_missing_values_follow_the_strategy(spark):
    df = spark.range(300).selectExpr(
        "IF(id % 3 = 0, NULL, id % 2 + id / 1000) AS x", "IF(id % 4 = 0, NULL, CONCAT('s', id % 2)) AS s",
        "CONCAT('y', id % 2) AS y",
    )
    got = by(associate.feature_associations(df, classify_target(df, "y")), "feature")
    assert got["x"]["missingness_strategy"].startswith("imputed")
    assert set(got) == {"x", "s"}
