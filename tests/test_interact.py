import numpy as np
import pandas as pd
import pytest

from tabscope.operators import interact
from tabscope.operators.target import Target, classify_target


@pytest.mark.parametrize(
    "columns, families",
    [
        (["w1", "w2"], {}),
        (["w2", "w11", "w1"], {"w": ["w1", "w2", "w11"]}),
        (["b_3", "a9", "b_1", "a7", "b_2", "a8", "c"], {"a": ["a7", "a8", "a9"], "b": ["b_1", "b_2", "b_3"]}),
        (["q01", "q1", "q2"], {"q": ["q1", "q01", "q2"]}),
        (["v_1", "v2", "v3"], {"v": ["v_1", "v2", "v3"]}),
        (["1", "22", "333"], {}),
        (["x.1", "x.2", "x.3", "n1m1", "n1m2", "n1m3"], {}),
        ([], {}),
    ],
)
def test_names_that_differ_in_a_number(columns, families):
    assert interact.column_families(columns) == families


@pytest.fixture(scope="module")
def sensors(spark):
    """Four readings per device, some missing; devices fail where readings run high."""
    rng = np.random.default_rng(77)
    n = 1200
    level = rng.gamma(2.0, 1.0, n)
    pdf = pd.DataFrame({f"reading{i}": np.round(level + rng.gamma(1.0, 1.0, n), 2) for i in (1, 2, 3, 4)})
    pdf["weight"] = np.round(rng.uniform(1, 9, n), 3)
    total = pdf.filter(like="reading").sum(axis=1)
    pdf["failed"] = np.where(total > total.quantile(0.7), "yes", "no")
    pdf.loc[::11, "reading2"] = None
    return pdf, spark.createDataFrame(pdf)


def groups(signals, kind):
    return {r["group"]: r for r in signals.filter(f"type = '{kind}'").collect()}


def shares(pdf, by, least):
    rows = pdf.assign(hit=(pdf["failed"] == "yes"), by=by).dropna(subset=["by"]).groupby("by")["hit"].agg(["size", "mean"])
    return {k: (r["size"], round(r["mean"] * 100, 1)) for k, r in rows[rows["size"] >= least].iterrows()}


def plain(found):
    return {k: (r["count"], r["rate_pct"]) for k, r in found.items()}


def test_levels_and_moves_of_a_family(sensors):
    pdf, df = sensors
    signals = interact.interaction_signals(df, classify_target(df, "failed"))
    own = pdf[[f"reading{i}" for i in (1, 2, 3, 4)]]
    above = own.gt(own.median())
    levels = groups(signals, "persistence_gradient")
    assert plain(levels) == {str(k): v for k, v in shares(pdf, above.sum(axis=1), 10).items()}
    rates = [r["rate_pct"] for r in levels.values()]
    assert {r["spread_pp"] for r in levels.values()} == {round(max(rates) - min(rates), 1)}
    assert {r["overall_rate_pct"] for r in levels.values()} == {round((pdf["failed"] == "yes").mean() * 100, 1)}
    names = {(0, 0): "stable_low", (0, 1): "deteriorating", (1, 0): "improving", (1, 1): "stable_high"}
    moves = [names[int(a), int(b)] for a, b in zip(above["reading1"], above["reading4"])]
    assert plain(groups(signals, "trajectory")) == shares(pdf, moves, 10)


def test_fifths_and_halves(sensors):
    pdf, df = sensors
    target = classify_target(df, "failed")
    edges = pdf["reading1"].quantile([0, 0.2, 0.4, 0.6, 0.8, 1.0]).to_numpy()
    fifth = np.maximum(np.searchsorted(edges, pdf["reading1"], side="left"), 1)
    found = groups(interact.quintile_concentration(df, target, "reading1"), "portfolio_concentration")
    assert plain(found) == {f"Q{k}": v for k, v in shares(pdf, fifth, 5).items()}
    best = max(found.values(), key=lambda r: r["rate_pct"])
    assert best["top_share_pct"] == pytest.approx(best["positives"] / (pdf["failed"] == "yes").sum() * 100, abs=0.05)
    first, second = pdf["reading2"] >= pdf["reading2"].median(), pdf["weight"] >= pdf["weight"].median()
    side = np.array(["lo", "hi"])
    names = [f"reading2_{a}_weight_{b}" for a, b in zip(side[first.astype(int)], side[second.astype(int)])]
    halves = interact.cross_feature_segments(df, target, "reading2", "weight")
    assert plain(groups(halves, "cross_feature_segments")) == shares(pdf, names, 10)


def test_small_groups_and_small_spreads_are_left_out(spark):
    """Nine rows are too few for a level, ten are enough; a spread below five points is no signal."""
    rows = [(1, 1, 1, 1)] * 9 + [(0, 0, 0, 0)] * 300 + [(0, 0, 1, 1)] * 10 + [(0, 1, 1, 1)] * 10
    df = spark.createDataFrame(rows, "p1 int, p2 int, p3 int, hit int")
    levels = groups(interact.persistence_gradient(df, classify_target(df, "hit")), "persistence_gradient")
    assert {k: r["count"] for k, r in levels.items()} == {"0": 300, "1": 10, "2": 10}
    even = spark.range(400).selectExpr("id % 3 AS p1", "id % 5 AS p2", "id % 7 AS p3", "id div 200 AS hit")
    assert interact.persistence_gradient(even, classify_target(even, "hit")).count() == 0


def test_nothing_to_report(spark):
    df = spark.range(60).selectExpr("id AS size", "id % 2 AS hit", "3 AS same")
    target = classify_target(df, "hit")
    assert interact.interaction_signals(df, target).count() == 0
    assert interact.interaction_signals(df, Target(None)).count() == 0
    assert interact.quintile_concentration(df, target, "same").count() == 0


def test_continuous_target_counts_from_its_median_up(spark):
    df = spark.range(1, 102).selectExpr("id AS m1", "102 - id AS m2", "id * id AS m3", "id / 4 AS cost")
    rows = interact.persistence_gradient(df, classify_target(df, "cost")).collect()
    assert {r["overall_rate_pct"] for r in rows} == {round(51 / 101 * 100, 1)}
