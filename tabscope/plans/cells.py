"""Points in the plane dealt into cells of bounded size, and exact nearest neighbours across them.

The plane of each feature is cut at quantiles of x into strips and each strip at quantiles of y into
cells, so a cell holds about the same number of points wherever they lie, and a point's neighbourhood,
which shrinks in both coordinates as points grow denser, reaches into few cells besides its own. A cell is
solved in one task. Only points whose neighbourhood crosses a border of their cell ask the cells beyond it.

The cuts are quantile sketches, a few numbers a cell; they decide the balance of the cells and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.plans.blocks import deal_blocks, numbers
from tabscope.plans.scratch import materialise

ROWS_PER_CELL = 100_000
LEAST_PER_CELL = 10_000  # fewer are not dealt out further for the sake of parallel tasks
TRIED = 48  # points of a cell that tell how far neighbours lie
SLACK = 1e-12  # widens what is asked by more than distances are rounded


class Grid:
    """The cells of one feature: ``first`` is the number of its first cell."""

    def __init__(self, first: int, x_cuts: np.ndarray, y_cuts: list[np.ndarray]):
        self.x_cuts, self.y_cuts = x_cuts, y_cuts
        self.firsts = first + np.concatenate([[0], np.cumsum([len(c) + 1 for c in y_cuts])]).astype(np.int64)

    def strip_of(self, x: np.ndarray) -> np.ndarray:
        """A value that equals a cut is below it."""
        return np.searchsorted(self.x_cuts, x, side="left")

    def _in_strips(self, strips: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(y), np.int64)
        for s in np.unique(strips):
            at = strips == s
            out[at] = self.firsts[s] + np.searchsorted(self.y_cuts[s], y[at], side="left")
        return out

    def cell_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._in_strips(self.strip_of(x), y)

    def borders(self, cell: int) -> tuple[float, float, float, float]:
        """Points of other cells have x at or below the first or above the second number, or else
        y at or below the third or above the fourth."""
        s = int(np.searchsorted(self.firsts, cell, side="right")) - 1
        x, y, t = self.x_cuts, self.y_cuts[s], cell - int(self.firsts[s])
        return (
            x[s - 1] if s else -np.inf,
            x[s] if s < len(x) else np.inf,
            y[t - 1] if t else -np.inf,
            y[t] if t < len(y) else np.inf,
        )

    def reached(self, x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for every cell that a square around a point touches."""

        def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = last - first + 1
            owner = np.repeat(np.arange(len(first)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            return owner, first[owner] + place

        wide = radius * (1 + SLACK) + SLACK * (np.abs(x) + np.abs(y))
        point, strip = spread(self.strip_of(x - wide), self.strip_of(x + wide))
        low = self._in_strips(strip, (y - wide)[point])
        high = self._in_strips(strip, (y + wide)[point])
        pair, cell = spread(low, high)
        return point[pair], cell


def quantile_cuts(points: DataFrame, keys: list[str], value: str, pieces: int) -> dict:
    """Approximate quantiles of each group that cut it into that many pieces."""
    shares = [i / pieces for i in range(1, pieces)]
    if not shares:
        return {}
    cuts = F.percentile_approx(value, shares, max(1000, 20 * pieces))
    rows = points.groupBy(*keys).agg(cuts.alias("cuts")).collect()  # one row per feature or strip
    return {tuple(r[k] for k in keys): np.unique(np.array(r["cuts"], float)) for r in rows}


def by_feature(number: Callable) -> Callable:
    """``number(pos, values...)``, taken for all rows of a feature at once, as a function of arrays."""

    def of_rows(pos: np.ndarray, *values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(pos), np.int64)
        for p in np.unique(pos):
            at = pos == p
            found[at] = number(int(p), *[v[at] for v in values])
        return found

    return of_rows


def _numbered(points: DataFrame, name: str, number: Callable) -> DataFrame:
    """The points with one more integer column ``number(pos, x, y)``."""
    of_rows = by_feature(number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of_rows(*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["pos", "x", "y", name])

    return points.select(F.col("pos").cast("int"), "x", "y").mapInArrow(work, f"pos int, x double, y double, {name} long")


def _past_ties(cuts: np.ndarray, width: float) -> np.ndarray:
    """The cuts moved past values that lie closer above them than the width, one cut where several meet."""
    kept: list[float] = []
    for cut in cuts:
        if not kept or cut + width - kept[-1] > width:
            kept.append(cut + width)
    return np.array(kept, float)


def deal_cells(
    points: DataFrame, n: int, features: int, widths: list[float] | None = None
) -> tuple[DataFrame, dict[int, Grid]]:
    """(cell, x, y) in blocks, and the grid of each feature, of about ``n / features`` points.

    Strips do not end among values that lie within the feature's width of each other (equal ones, told apart by
    noise), because all of these would ask beyond; a strip that grows by this gets more cells.
    """
    wanted = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, -(-n // ROWS_PER_CELL), min(wanted, n // LEAST_PER_CELL))
    each = max(1, -(-most // max(1, features)))
    strips = max(1, round(each**0.5))
    widths = widths or [0.0] * features
    x_cuts = {pos: _past_ties(cuts, widths[pos]) for (pos,), cuts in quantile_cuts(points, ["pos"], "x", strips).items()}
    none = np.zeros(0)

    def strip(pos: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(x_cuts.get(pos, none), x, side="left")

    found = _strips(_numbered(points, "strip", strip), each, -(-each // strips)) if each > 1 else {}
    grids, first = {}, 0
    for pos in range(features):
        grids[pos] = Grid(first, *found.get(pos, (none, [none])))
        first = int(grids[pos].firsts[-1])
    cell = by_feature(lambda pos, x, y: grids[pos].cell_of(x, y))
    return deal_blocks(points.select(F.col("pos").cast("int"), "x", "y"), "cell", cell, ["x", "y"]), grids


def _strips(numbered: DataFrame, each: int, pieces: int) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """Where the strips of a feature end, halfway to the next value, and approximate quantiles of y that cut each
    strip into its share of the feature's ``each`` cells."""
    shares = [i / each for i in range(1, each)]
    cuts = F.percentile_approx("y", shares, max(1000, 80 * pieces))
    aggregates = [F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), cuts.alias("cuts")]
    strips: dict[int, list] = {}
    for r in numbered.groupBy("pos", "strip").agg(*aggregates).sort("strip").collect():  # one row per strip
        strips.setdefault(r["pos"], []).append(r)
    found = {}
    for pos, rows in strips.items():
        n = sum(r["n"] for r in rows)
        x_cuts, y_cuts = [], []
        for r, beyond in zip(rows, [*rows[1:], None]):
            own = -(-r["n"] * each // n)
            y_cuts.append(np.unique(np.array(r["cuts"], float)[np.arange(1, own) * each // own - 1]))
            if beyond:
                half = r["high"] / 2 + beyond["low"] / 2
                x_cuts.append(half if r["high"] <= half < beyond["low"] else r["high"])
        found[pos] = np.array(x_cuts, float), y_cuts
    return found


class Neighbours:
    """The points of a cell, in strips along one coordinate that are sorted by the other.

    Which coordinate makes the strips and how wide they are comes from a few points of the cell: about as
    wide as neighbours are far, along the coordinate that has fewer points so near.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int):
        self.k, n = k, len(x)
        by = [np.sort(x), np.sort(y)]
        tried = np.argsort(x, kind="stable")[np.linspace(0, n - 1, min(n, TRIED)).astype(int)]
        near = [[], []]
        for i in tried:
            d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
            radius = np.partition(d, min(k, n - 1))[min(k, n - 1)]
            for axis, v in enumerate((x[i], y[i])):
                first, last = np.searchsorted(by[axis], [v - radius, v + radius])
                near[axis].append(last - first)
        typical = [np.median(c) if c else 1 for c in near]
        self.turned = bool(typical[1] < typical[0])
        a, b = (y, x) if self.turned else (x, y)
        self.size = int(max(8, typical[self.turned]))
        strip = np.empty(n, np.int64)
        strip[np.argsort(a, kind="stable")] = np.arange(n) // self.size
        self.order = np.lexsort((b, strip))
        self.a, self.b, self.strip = a[self.order], b[self.order], strip[self.order]
        self.strips = -(-n // self.size)
        starts = np.arange(self.strips) * self.size
        self.low = np.minimum.reduceat(self.a, starts) if n else self.a
        self.high = np.maximum.reduceat(self.a, starts) if n else self.a
        self.sorted_b = by[0] if self.turned else by[1]
        self.keys = self.strip * (n + 1) + np.searchsorted(self.sorted_b, self.b)

    def _walk(self, active, at, step, first, last, a, b, best, bound) -> None:
        while len(active):
            ok = (at >= first) & (at < last)
            active, at, first, last = active[ok], at[ok], first[ok], last[ok]
            gap = np.abs(self.b[at] - b[active])
            ok = gap < np.minimum(best[-1, active], bound[active])
            active, at, first, last = active[ok], at[ok], first[ok], last[ok]
            d = np.maximum(gap[ok], np.abs(self.a[at] - a[active]))
            for place in range(self.k):
                old = best[place, active]
                best[place, active] = np.minimum(old, d)
                d = np.maximum(old, d)
            at = at + step

    def _visit(self, active, strip, a, b, best, bound, own=None) -> None:
        n = len(self.a)
        first, last = strip * self.size, np.minimum((strip + 1) * self.size, n)
        if own is None:
            up = np.searchsorted(self.keys, strip * (n + 1) + np.searchsorted(self.sorted_b, b[active]))
            down = up - 1
        else:
            up, down = own + 1, own - 1
        self._walk(active, up, 1, first, last, a, b, best, bound)
        self._walk(active, down, -1, first, last, a, b, best, bound)

    def _search(self, a, b, bound, home, own=None) -> np.ndarray:
        best = np.full((self.k, len(a)), np.inf)
        everyone = np.arange(len(a))
        self._visit(everyone, home, a, b, best, bound, own)
        for step in (1, -1):
            active, strip = everyone, home + step
            while len(active):
                ok = (strip >= 0) & (strip < self.strips)
                active, strip = active[ok], strip[ok]
                gap = self.low[strip] - a[active] if step > 0 else a[active] - self.high[strip]
                ok = gap < np.minimum(best[-1, active], bound[active])
                active, strip = active[ok], strip[ok]
                self._visit(active, strip, a, b, best, bound)
                strip = strip + step
        return best

    def among_themselves(self) -> np.ndarray:
        """The k least distances of each point to others, the larger coordinate counting; a column a point."""
        n = len(self.a)
        best = np.empty((self.k, n))
        best[:, self.order] = self._search(self.a, self.b, np.full(n, np.inf), self.strip, np.arange(n))
        return best

    def from_outside(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The k least distances below the bound from other points to these."""
        a, b = (y, x) if self.turned else (x, y)
        home = np.clip(np.searchsorted(self.high, a), 0, self.strips - 1)
        return self._search(a, b, bound, home)


FOUND = "pos int, id long, x double, y double, radius double, best array<double>, cells array<long>"
NEARER = "pos int, id long, x double, y double, best array<double>"


def _lists(values: np.ndarray, sizes: np.ndarray, none: np.ndarray) -> pa.Array:
    """One list per size, cut from the values; NULL where there is none."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.append(none, False))
    return pa.ListArray.from_arrays(ends, pa.array(values))


def neighbour_distances(dealt: DataFrame, grids: dict[int, Grid], k: int) -> DataFrame:
    """(pos, x, y, radius): the distance of the k-th nearest other point of the feature for every point."""
    features = sorted(grids)
    firsts = np.array([grids[pos].firsts[0] for pos in features])

    def feature_of(cell: int) -> int:
        return features[int(np.searchsorted(firsts, cell, side="right")) - 1]

    def solve(cell: pa.Table) -> pa.Table:
        number = cell["cell"][0].as_py()
        pos = feature_of(number)
        x, y = numbers(cell["x"]), numbers(cell["y"])
        best = Neighbours(x, y, k).among_themselves()
        radius = best[-1]
        left, right, below, above = grids[pos].borders(number)
        inside = (x - left >= radius) & (right - x >= radius) & (y - below >= radius) & (above - y >= radius)
        at = np.flatnonzero(~inside)
        point, asked = grids[pos].reached(x[at], y[at], radius[at])
        other = asked != number
        point, asked = point[other], asked[other]
        by_point = np.argsort(point, kind="stable")
        name, own, asks = np.full(len(x), -1), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        name[at], own[at], asks[at] = (number << 32) | at, k, np.bincount(point, minlength=len(at))
        return pa.table(
            {
                "pos": pa.array(np.full(len(x), pos, np.int32)),
                "id": name,
                "x": x,
                "y": y,
                "radius": radius,
                "best": _lists(best[:, at].T.ravel(), own, inside),
                "cells": _lists(asked[by_point], asks, inside),
            }
        )

    def nearer(asked: pa.Table, cell: pa.Table) -> pa.Table:
        x, y, bound = (numbers(asked[c]) for c in ("x", "y", "radius"))
        names = numbers(asked["id"], "int64")
        best = np.full((k, len(x)), np.inf)
        if len(x) and cell.num_rows:
            best = Neighbours(numbers(cell["x"]), numbers(cell["y"]), k).from_outside(x, y, bound)
        some = np.flatnonzero(np.isfinite(best[0]))
        pos = feature_of(asked["cell"][0].as_py()) if len(x) else 0
        none = pa.nulls(len(some), pa.float64())
        return pa.table(
            {
                "pos": pa.array(np.full(len(some), pos, np.int32)),
                "id": names[some],
                "x": none,
                "y": none,
                "best": _lists(best[:, some].T.ravel(), np.full(len(some), k), np.zeros(len(some), bool)),
            }
        )

    first = materialise(dealt.groupBy("cell").applyInArrow(solve, FOUND), "neighbours")
    settled = first.filter("id < 0").select("pos", "x", "y", "radius")
    if all(len(g.firsts) == 2 and not len(g.y_cuts[0]) for g in grids.values()):
        return settled  # one cell a feature
    waiting = first.filter("id >= 0")
    questions = waiting.select("id", "x", "y", "radius", F.explode("cells").alias("cell"))
    questions = deal_blocks(questions, "cell", lambda i, x, y, radius, cell: cell, ["id", "x", "y", "radius"])
    more = questions.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(nearer, NEARER)
    answers = waiting.select("pos", "id", "x", "y", "best").unionByName(more)
    # As many lists for each point as cells that its square touches, and its own.
    moved = answers.groupBy("pos", "id").agg(
        F.max("x").alias("x"),
        F.max("y").alias("y"),
        F.element_at(F.array_sort(F.flatten(F.collect_list("best"))), k).alias("radius"),
    )
    return settled.unionByName(materialise(moved.drop("id"), "moved"))
