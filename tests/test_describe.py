import math

import numpy as np
import pandas as pd
import pytest

from tabscope.operators import describe
from tabscope.plans import quantiles
from tabscope.plans.moments import basic_stats
from tabscope.plans import quantiles
from tabscope.plans.quantiles import exact_quantiles
from tests.conftest import by


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"a b": rng.normal(5, 2, 400), "c.d": rng.exponential(3, 400), "[e]": rng.integers(0, 9, 400)}
    )
    got = by(describe.describe_numeric(spark.createDataFrame(pdf)))
    for c in pdf:
        want = pdf[c]
        for key, value in {
            "mean": want.mean(), "std": want.std(), "min": want.min(), "max": want.max(),
            "q25": want.quantile(0.25), "median": want.median(), "q75": want.quantile(0.75),
            "skewness": want.skew(), "kurtosis": want.kurt(),
        }.items():
            assert got[c][key] == pytest.approx(value, rel=1e-9, abs=1e-12), (c, key)


def test_constant_and_tiny_columns(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, None), (0.1, None)], "k double, one double")
    got = by(describe.describe_numeric(df))
    assert got["k"]["std"] == 0.0 and got["k"]["skewness"] == 0.0
    assert got["one"]["count"] == 1 and got["one"]["std"] is None and got["one"]["skewness"] is None
    assert got["one"]["median"] == 1.0


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (3.0,)], "x double")
    row = describe.describe_numeric(df).first()
    assert (row["n_rows"], row["count"], row["mean"]) == (4, 2, 2.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    row = describe.describe_numeric(df).first()
    assert row["count"] == 0 and row["median"] is None
    assert describe.describe_categorical(df).count() == 0
    assert describe.missing_total(df).first()["total_pct"] == 0.0
    assert describe.histogram(df).count() == 0


@pytest.mark.parametrize("shape", ["uniform", "ties", "heavy", "huge", "two"])
def test_quantiles_by_passes(spark, monkeypatch, shape):
    """All columns take the narrowing passes, whatever their shape."""
    monkeypatch.setattr(quantiles, "READ_OUT_ROWS", 20)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(11)
    x = {
        "uniform": rng.random(3000),
        "ties": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(7, 1, 3000)),
        "heavy": rng.pareto(0.3, 3000),
        "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 1e-300], 3000),
        "two": np.repeat([1.0, 2.0], 1500),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    probabilities = [0.0, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probabilities)["x"]
    ordered = np.sort(x)
    for p, v in zip(probabilities, got):
        place = (len(x) - 1) * p
        low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
        part = place - math.floor(place)
        assert v == pytest.approx(low if low == high else low * (1 - part) + high * part, rel=1e-12)


def test_missing(spark):
    df = spark.createDataFrame(
        [(1.0, 10, "x"), (None, 20, None), (3.0, None, "z"), (None, 40, None), (5.0, 50, None)],
        "a double, b int, c string",
    )
    got = by(describe.missing_analysis(df))
    assert [got[c]["missing_pct"] for c in "abc"] == [40.0, 20.0, 60.0]
    assert describe.missing_total(df).first()["total_pct"] == 40.0


def test_describe_categorical_breaks_ties_by_value(frame):
    row = describe.describe_categorical(frame(s=["y", "x", "y", "x", "z"])).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (5, 3, "x", 2)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_histogram_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 3, 2000), 1)
    got = describe.histogram(spark.createDataFrame(pd.DataFrame({"x": x}))).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=30)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["low"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1]["high"] == edges[-1]


def test_histogram_of_constant(frame):
    got = describe.histogram(frame(x=[4.0] * 6)).collect()
    assert sum(r["count"] for r in got) == 6
    assert min(r["low"] for r in got) == 3.5 and max(r["high"] for r in got) == 4.5


def test_modality(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.4, 3000), rng.normal(10, 0.4, 3000)])
    df = spark.createDataFrame(pd.DataFrame({"two": x, "flat": np.arange(6000) * 1.0}))
    bins = describe.histogram(df)
    assert {r["column"]: r["modality"] for r in describe.modality(bins).collect()} == {
        "two": "2-modal", "flat": "unimodal",
    }
    assert describe.histogram_gaps(bins).filter("column = 'flat'").count() == 0


def test_edge_peak_has_one_neighbour(spark):
    bins = spark.createDataFrame(
        [("x", i, float(i), i + 1.0, n) for i, n in enumerate([90, 1, 1, 1, 80])],
        "column string, bin int, low double, high double, count long",
    )
    assert [r["bin"] for r in describe.histogram_peaks(bins).orderBy("bin").collect()] == [0, 4]


def test_skew_labels(spark):
    df = spark.createDataFrame(
        [("a", 0.2, 1.0, 1.0), ("b", 0.7, 1.0, 1.0), ("c", -1.5, 1.0, 1.0), ("d", None, 1.2, 1.0),
         ("e", None, 0.5, 1.0), ("f", None, 1.0, 1.0), ("g", None, 1.0, 0.0)],
        "column string, skewness double, mean double, median double",
    )
    got = {r["column"]: r["skew_direction"] for r in describe.skew_labels(df).collect()}
    assert got == {
        "a": "approximately symmetric", "b": "slightly RIGHT-SKEWED", "c": "LEFT-SKEWED",
        "d": "RIGHT-SKEWED", "e": "LEFT-SKEWED or BIMODAL", "f": "approximately symmetric",
        "g": "undetermined",
    }


def test_zero_inflation(frame):
    df = frame(t=[0, 0, 0, 1], z=[0.0, 0.0, 5.0, 7.0], n=[0, 1, 2, 3])
    got = by(describe.zero_inflation(df, target="t"))
    assert got["t"]["label"] == "class_imbalance" and got["z"]["label"] == "zero_inflation"
    assert got["z"]["zero_count"] == 2 and "n" not in got


def test_kde_integrates_to_one(spark):
    x = np.random.default_rng(1).normal(0, 1, 500)
    curve = describe.kde_curve(spark.createDataFrame(pd.DataFrame({"x": x})), "x").orderBy("point")
    rows = curve.collect()
    width = np.std(x, ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((rows[50]["x"] - x) / width) ** 2).sum() / (
        len(x) * width * math.sqrt(2 * math.pi)
    )
    assert len(rows) == 200 and rows[50]["density"] == pytest.approx(want)
    assert 0.95 < np.trapezoid([r["density"] for r in rows], [r["x"] for r in rows]) < 1.01


@pytest.mark.parametrize("kind", ["far", "cauchy", "steps", "ties", "even", "both ends"])
@pytest.mark.parametrize("moments", [True, False])
def test_quantiles_of_far_outliers_take_few_scans(spark, monkeypatch, kind, moments):
    """A sketch instead of pass after pass of bins that all rows share; exact all the same."""
    monkeypatch.setattr(quantiles, "READ_OUT_ROWS", 200)
    monkeypatch.setattr(quantiles, "SKETCH", 500)
    scans = []
    for name in ("_narrow", "_bracketed", "_read_out"):
        real = getattr(quantiles, name)
        # A bracket takes two: the sketch and the count.
        monkeypatch.setattr(quantiles, name, lambda *a, real=real, name=name: (scans.extend([name] * (2 if name == "_bracketed" else 1)), real(*a))[1])
    r = np.random.default_rng(6)
    n = 20_000
    x = {
        "far": np.concatenate([r.normal(size=n - 1), [1e300]]),
        "cauchy": r.standard_cauchy(n) ** 5,
        "steps": 10.0 ** r.integers(-200, 200, n),
        "ties": np.where(r.random(n) < 0.7, 0.0, r.standard_cauchy(n) ** 7),
        "even": r.random(n),
        "both ends": np.concatenate([r.normal(size=n - 2), [1.7e308, -1.7e308]]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    stats = basic_stats(df)
    if moments:
        stats["x"]["std"] = float(np.std(x / 1e10) * 1e10)
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x"], p, stats)["x"]
    order = np.sort(x)
    for share, value in zip(p, got):
        place = (n - 1) * share
        low, high, part = order[math.floor(place)], order[math.ceil(place)], place - math.floor(place)
        assert value == (low if low == high else low * (1 - part) + high * part)
    # At full size a bracket is read out at once; with the small bounds here one pass of bins may come between.
    if kind in ("far", "both ends") and moments:
        assert len(scans) <= 4 and scans[0] == "_bracketed"
    assert len(scans) <= 9


@pytest.mark.parametrize("kind", ["even", "heavy", "levels", "two", "far"])
def test_kde_equals_the_sum_of_kernels(spark, kind):
    r = np.random.default_rng(5)
    x = {
        "even": r.random(3000), "heavy": r.standard_cauchy(2000), "levels": r.integers(0, 4, 900) * 1.0,
        "two": np.array([1.0, 2.0]), "far": np.concatenate([r.normal(0, 1, 500), [1e9]]) + 1e6,
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(3)
    curve = describe.kde_curve(df, "x")
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan
    got = np.array([r["density"] for r in curve.orderBy("point").collect()])
    width = np.std(x, ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * math.sqrt(2 * math.pi))
    assert len(got) == 200 and np.abs(got - want).max() < 1e-11 / width


def test_kde_series_stays_within_its_bound():
    """One kernel anywhere in a cell, seen from anywhere."""
    rows = describe._hermite_powers(describe.KDE_ORDER)
    for u in np.linspace(-0.25, 0.25, 11):
        t = np.linspace(-9, 9, 400)
        series = sum(u**k / math.factorial(k) * np.polyval(row[::-1], t) for k, row in enumerate(rows))
        assert np.abs(np.exp(-t * t / 2) * series - np.exp(-((t - u) ** 2) / 2)).max() < 3e-13


def test_results_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.normal(0, 1, 500), "s": rng.choice(list("abc"), 500)})
    df = spark.createDataFrame(pdf)
    shuffled = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7)
    assert basic_stats(df)["x"]["count"] == basic_stats(shuffled)["x"]["count"]
    assert sorted(describe.describe_categorical(df).collect()) == sorted(
        describe.describe_categorical(shuffled).collect()
    )
    assert exact_quantiles(df, ["x"], [0.1, 0.5]) == exact_quantiles(shuffled, ["x"], [0.1, 0.5])
