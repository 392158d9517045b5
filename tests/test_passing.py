"""Work on many points leaves nothing on disk, and little at a time."""

import os
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import associate
from tabscope.operators import mutual_info as mi
from tabscope.operators.target import classify_target
from tabscope.plans import blocks, cells, scratch
from tests.test_associate import _brute_continuous


def _folder(spark):
    return urlparse(os.path.dirname(scratch.scratch_folder(spark, "x"))).path


def _bytes(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}


def _watched(monkeypatch, folder):
    """Sizes of all scratch tables after each that is written."""
    before, sizes = set(_bytes(folder)), []

    def watch(df, name, real=scratch.materialise):
        out = real(df, name)
        sizes.append((name, sum(n for f, n in _bytes(folder).items() if f not in before)))
        return out

    for module in (mi, cells):
        monkeypatch.setattr(module, "materialise", watch)
    return sizes


def _frame(spark, n, features):
    r = np.random.default_rng(n)
    pdf = pd.DataFrame({f"x{i}": r.normal(size=n) for i in range(features)})
    pdf["z"] = pdf["x0"] + r.normal(size=n)
    pdf["id"] = np.arange(n)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("at_once", [10**7, 700, 100])
def test_features_and_rounds_in_turn_equal_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(mi, "POINTS_AT_ONCE", at_once)
    monkeypatch.setattr(mi, "ROWS_PER_PART", 40)
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 60)
    pdf, df = _frame(spark, 300, 2)
    got = {r["feature"]: r["mi_score"] for r in mi.mutual_information(df, "z", "regression", ["x0", "x1"], [], ["id"]).collect()}
    for c in ("x0", "x1"):
        want = _brute_continuous(pdf[c].to_numpy() / np.std(pdf[c].to_numpy()), pdf.z.to_numpy() / np.std(pdf.z.to_numpy()))
        assert got[c] == pytest.approx(want, abs=1e-6)


def test_nothing_is_left_and_features_do_not_add_up(spark, monkeypatch):
    folder = _folder(spark)
    monkeypatch.setattr(mi, "POINTS_AT_ONCE", 3_000)
    sizes = _watched(monkeypatch, folder)
    peaks = []
    for features in (1, 4):
        before = set(_bytes(folder))
        _, df = _frame(spark, 3_000, features)
        mi.mutual_information(df, "z", "regression", [f"x{i}" for i in range(features)], [], ["id"])
        assert set(_bytes(folder)) <= before
        rows = next(n for name, n in sizes if name == "rows")
        peaks.append(max(n for _, n in sizes) - rows)
        sizes.clear()
    assert peaks[1] < 1.2 * peaks[0]


def test_associations_leave_results_only(spark, monkeypatch):
    """The ranking of features can still be read; of the points behind it nothing is on disk any more."""
    folder = _folder(spark)
    sizes = _watched(monkeypatch, folder)
    _, df = _frame(spark, 3_000, 3)
    before = set(_bytes(folder))
    ranked = associate.feature_associations(df, classify_target(df, "z"), key=["id"])
    left = sum(n for f, n in _bytes(folder).items() if f not in before)
    assert max(n for _, n in sizes) > 100_000 and left < 10_000  # pairs of columns
    assert [r["feature"] for r in ranked.orderBy("mi_rank").collect()][0] == "x0" and ranked.count() == 4


def test_tables_are_deleted_after_errors_too_and_settings_come_back(spark):
    folder, before = _folder(spark), spark.conf.get(scratch.CLEANUP, None)
    files = set(_bytes(folder))
    with pytest.raises(RuntimeError), scratch.passing(spark):
        kept = scratch.materialise(spark.range(5), "x")
        with scratch.passing(spark):
            scratch.materialise(spark.range(5), "y")
        assert kept.count() == 5 and spark.conf.get(scratch.CLEANUP) == "true"
        raise RuntimeError
    assert set(_bytes(folder)) <= files and spark.conf.get(scratch.CLEANUP, None) == before
    assert scratch.materialise(spark.range(5), "z").count() == 5


def test_equal_values_are_not_cut_into_strips(spark, monkeypatch):
    """Three levels, much closer to themselves than neighbours are: cut among them, all of a strip would ask."""
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 200)
    seen = {}

    def keep(df, name, real=scratch.materialise):
        seen[name] = df.cache()
        return seen[name]

    monkeypatch.setattr(cells, "materialise", keep)
    r = np.random.default_rng(8)
    n = 4_000
    pdf = pd.DataFrame({"x": r.choice([0.0, 1.0, 2.0], n, p=[0.2, 0.5, 0.3]), "z": r.normal(size=n), "id": np.arange(n)})
    got = mi.mutual_information(spark.createDataFrame(pdf), "z", "regression", ["x"], [], ["id"]).first()["mi_score"]
    first = seen["neighbours"]
    assert first.count() == n
    assert first.filter("id >= 0").count() < 0.1 * n
    noisy = pdf.x / np.std(pdf.x) + 1e-10 * r.uniform(-1, 1, n)
    assert got == pytest.approx(_brute_continuous(noisy.to_numpy(), pdf.z.to_numpy() / np.std(pdf.z)), abs=0.02)


def test_parts_inside_an_interval_are_not_asked(spark, monkeypatch):
    """Intervals that hold all equal values end between them and others: nobody asks the parts at their ends."""
    monkeypatch.setattr(mi, "ROWS_PER_PART", 50)
    questions = []
    real = mi._asked
    monkeypatch.setattr(mi, "_asked", lambda dealt, q, f, s: (questions.append(q), real(dealt, q, f, s))[1])
    r = np.random.default_rng(5)
    v, radius = r.choice([0.0, 1.0, 2.0], 2000, p=[0.2, 0.5, 0.3]) + 1e-10 * r.uniform(-1, 1, 2000), r.choice([1e-3, 1e-11], 2000, p=[0.9, 0.1])
    df = spark.createDataFrame(pd.DataFrame({"pos": 0, "v": v, "radius": radius}), "pos int, v double, radius double")
    got = mi._margin_sums(df, 2000, 1, [2e-10]).first()["total"]
    inside = np.array([np.sum(np.abs(v - a) < b) for a, b in zip(v, radius)])
    assert got == pytest.approx(mi.digamma(np.maximum(inside, 1)).sum(), rel=1e-12)
    assert questions[0].filter("radius = 1e-3").count() == 0 < questions[0].count()


def test_cells_without_an_answer(spark, monkeypatch):
    """Points ask a cell in which nobody is nearer."""
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 4)
    x = np.array([0.0, 0.1, 0.2, 0.3, 5.0, 9.0, 9.1, 9.2, 9.3, 9.4, 50.0, 90.0])
    pdf = pd.DataFrame({"pos": np.zeros(12, "int32"), "x": x, "y": x[::-1].copy()})
    dealt, grids = cells.deal_cells(spark.createDataFrame(pdf), 12, 1)
    got = cells.neighbour_distances(dealt, grids, 1).toPandas().sort_values("x")["radius"].to_numpy()
    d = np.maximum(np.abs(x[:, None] - x), np.abs(x[::-1][:, None] - x[::-1]))
    np.fill_diagonal(d, np.inf)
    assert np.array_equal(got, d.min(axis=0))


def test_blocks_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 100)
    rows = spark.range(1, 1001, numPartitions=3).select("id", (F.col("id") % 7 - 1).alias("part"), (F.col("id") / 2).alias("v"))
    dealt = blocks.deal_blocks(rows, "part", lambda i, part, v: part, ["v", "id"])
    got = {}
    for r in dealt.collect():
        v, i = np.frombuffer(r["v"]), np.frombuffer(r["id"], "int64")
        assert (v == i / 2).all() and (i % 7 - 1 == r["part"]).all()
        got.setdefault(r["part"], []).extend(i.tolist())
    # Numbers below 0 are left out.
    assert set(got) == set(range(6)) and sorted(sum(got.values(), [])) == [i for i in range(1, 1001) if i % 7]
    ends = blocks.extents(rows, "part", lambda i, part, v: part, "v").groupBy("part").agg(F.min("low"), F.max("high"), F.sum("n"))
    assert {tuple(r) for r in ends.collect()} == {(p, min(i) / 2, max(i) / 2, len(i)) for p, i in got.items()}
