"""Nearest neighbours in cells of the plane, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.operators import mutual_info as mi
from tabscope.plans import cells
from tabscope.plans.cells import Grid, Neighbours, deal_cells, neighbour_distances


def all_pairs(x, y, k, qx=None, qy=None):
    own = qx is None
    qx, qy = (x, y) if own else (qx, qy)
    d = np.maximum(np.abs(x - qx[:, None]), np.abs(y - qy[:, None]))
    if own:
        np.fill_diagonal(d, np.inf)
    d = np.sort(d, axis=1)[:, :k].T
    return np.vstack([d, np.full((k - len(d), d.shape[1]), np.inf)])


KINDS = {
    "spread": lambda r, n: r.normal(size=n),
    "levels": lambda r, n: r.integers(0, 4, n) + 1e-9 * r.random(n),
    "ties": lambda r, n: r.integers(0, 3, n) * 1.0,
    "heavy": lambda r, n: np.exp(6 * r.normal(size=n)),
    "even": lambda r, n: np.arange(n) * 1.0,
}


@settings(max_examples=120, deadline=None)
@given(
    st.integers(0, 10**6), st.sampled_from([1, 2, 3, 5, 30, 300]), st.integers(1, 4),
    st.sampled_from(list(KINDS)), st.sampled_from(list(KINDS)),
)
def test_neighbours_equal_all_pairs(seed, n, k, x_kind, y_kind):
    r = np.random.default_rng(seed)
    x, y = KINDS[x_kind](r, n), KINDS[y_kind](r, n)
    points = Neighbours(x, y, k)
    assert np.array_equal(points.among_themselves(), all_pairs(x, y, k))
    qx, qy = r.normal(size=6), r.normal(size=6)
    want = all_pairs(x, y, k, qx, qy)
    bound = want[-1] * r.choice([0.5, 1.0, 2.0], 6)
    got = points.from_outside(qx, qy, bound)
    near = want < bound
    assert np.array_equal(got[near], want[near]) and (got[~near] >= np.broadcast_to(bound, want.shape)[~near]).all()


def test_a_grid_reaches_every_cell_of_a_square():
    r = np.random.default_rng(4)
    grid = Grid(10, np.array([0.2, 0.5]), [np.array([0.3]), np.array([]), np.array([0.1, 0.2, 0.9])])
    x, y = r.random(500), r.random(500)
    own = grid.cell_of(x, y)
    assert set(own) == set(range(10, 17)) and grid.firsts[-1] == 17
    radius = r.random(500) * 0.3
    point, cell = grid.reached(x, y, radius)
    asked = set(zip(point.tolist(), cell.tolist()))
    for i in range(500):
        near = np.maximum(np.abs(x - x[i]), np.abs(y - y[i])) < radius[i]
        assert {(i, int(c)) for c in own[near]} <= asked
    for c in range(10, 17):
        left, right, below, above = grid.borders(c)
        mine = own == c
        assert (x[mine] > left).all() and (x[mine] <= right).all() and (y[mine] > below).all() and (y[mine] <= above).all()


def _points(spark, n, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    pdf = pd.DataFrame({"pos": 0, "x": x, "y": 0.5 * x + r.normal(size=n)})
    far = pd.DataFrame({"pos": 1, "x": np.exp(3 * r.normal(size=n)), "y": r.integers(0, 5, n) + 1e-9 * r.random(n)})
    both = pd.concat([pdf, far]).astype({"pos": "int32"})
    return both, spark.createDataFrame(both)


@pytest.mark.parametrize("per_cell", [10**6, 60, 7])
def test_distances_across_cells_equal_all_pairs(spark, monkeypatch, per_cell):
    monkeypatch.setattr(cells, "ROWS_PER_CELL", per_cell)
    pdf, df = _points(spark, 400)
    dealt, grids = deal_cells(df, 800, 2)
    got = neighbour_distances(dealt, grids, 3).toPandas()
    assert len(got) == 800
    for pos in (0, 1):
        own = pdf[pdf.pos == pos]
        want = dict(zip(zip(own.x, own.y), all_pairs(own.x.to_numpy(), own.y.to_numpy(), 3)[-1]))
        mine = got[got.pos == pos]
        assert all(want[x, y] == d for x, y, d in zip(mine.x, mine.y, mine.radius))


def test_few_points_ask_and_few_cells_are_asked_at_any_size(spark, monkeypatch):
    """Four times the points in four times the cells: the share that asks and what each asks stay."""
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 400)
    seen = []
    monkeypatch.setattr(cells, "materialise", lambda df, name: (seen.append(df.cache()), df)[1] if name == "neighbours" else df.cache())
    shares, asked = [], []
    for n in (6_000, 24_000):
        r = np.random.default_rng(n)
        pdf = pd.DataFrame({"pos": np.zeros(n, "int32"), "x": r.random(n), "y": r.random(n)})
        dealt, grids = deal_cells(spark.createDataFrame(pdf), n, 1)
        assert grids[0].firsts[-1] >= n / 400
        neighbour_distances(dealt, grids, 3).count()
        waiting = seen[-1].filter("id >= 0").agg(F.count("*").alias("n"), F.avg(F.size("cells")).alias("cells")).first()
        shares.append(waiting["n"] / n)
        asked.append(waiting["cells"])
    assert max(asked) < 1.5 and max(shares) < 0.35 and shares[1] < 1.25 * shares[0]


def test_margins_ask_two_parts_at_most(spark, monkeypatch):
    """However many parts an interval spans, its count comes from its ends."""
    monkeypatch.setattr(mi, "ROWS_PER_PART", 50)
    questions = []
    real = mi._asked
    monkeypatch.setattr(mi, "_asked", lambda dealt, q, f, s: (questions.append(q), real(dealt, q, f, s))[1])
    r = np.random.default_rng(3)
    v, radius = r.normal(size=2000), r.choice([0.0, 1e-3, 0.3, 5.0], 2000)
    df = spark.createDataFrame(pd.DataFrame({"pos": 0, "v": v, "radius": radius}), "pos int, v double, radius double")
    got = mi._margin_sums(df, 2000).first()["total"]
    inside = np.array([np.sum(np.abs(v - a) < b) for a, b in zip(v, radius)])
    assert got == pytest.approx(mi.digamma(np.maximum(inside, 1)).sum(), rel=1e-12)
    most = questions[0].groupBy("pos", "id").count().agg(F.max("count")).first()[0]
    assert most <= 2
