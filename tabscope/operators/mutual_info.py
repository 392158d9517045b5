"""Nearest-neighbour mutual information over all rows.

The points of all features are dealt by (feature, value) into parts of bounded size, so no feature and
no class is one task. A task works on the sorted values of its part:

* For classes, a point's nearest neighbours of its own class are next to it in the order of that class.
  The three values of each class on either side of a part come along with it. How many points lie within
  that distance is read off the part, or asked of the part that holds the end of the interval.
* For a continuous target, the third distance is found in cells of the plane (``plans.cells``). The counts
  along both coordinates are differences of ranks: of a second dealing, by value, only the two parts
  that hold the ends of an interval are looked at. Features, coordinates and rounds of parts that are too
  many points together follow one another, and what one leaves on disk is deleted before the next.

Equal values are told apart by a tiny noise from the row's key, so a frequent value can be cut as well.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from contextlib import nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import col
from tabscope.operators.cleaning import label_encode, row_digest, stratified_sample
from tabscope.plans.blocks import as_blocks, deal_blocks, extents, numbers
from tabscope.plans.cells import by_feature, deal_cells, neighbour_distances, quantile_cuts
from tabscope.plans.local import local_table
from tabscope.plans.scratch import materialise, passing

NEIGHBOURS = 3
JITTER = 1e-10
MIN_ROWS = 3
ROWS_PER_PART = 100_000
LEAST_PER_PART = 10_000  # fewer are not dealt out further for the sake of parallel tasks
POINTS_AT_ONCE = 8_000_000  # more are taken one feature, coordinate and round after the other
MOST_ROUNDS = 4


def digamma(n) -> np.ndarray:
    """digamma of positive whole numbers, by its series after six steps up."""
    n = np.asarray(n, dtype="float64")
    z = n + 6
    inverse = 1 / (z * z)
    series = np.log(z) - 0.5 / z - inverse * (
        1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132)))
    )
    return series - sum(1 / (n + j) for j in range(6))


def _digamma_column(n: Column) -> Column:
    z = n + 6
    inverse = 1 / (z * z)
    series = F.log(z) - 0.5 / z - inverse * (
        F.lit(1 / 12)
        - inverse * (F.lit(1 / 120) - inverse * (F.lit(1 / 252) - inverse * (F.lit(1 / 240) - inverse / 132)))
    )
    for j in range(6):
        series = series - 1 / (n + j)
    return series


class Order:
    """Where the parts of one feature begin and end; sent to the tasks, a few numbers per part."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["part"])
        self.parts = [r["part"] for r in rows]
        self.low = [r["low"] for r in rows]
        self.high = [r["high"] for r in rows]
        self.sizes = [r["n"] for r in rows]
        self.before = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def borders(self, part: int) -> tuple[float, float]:
        """The nearest values below and above a part."""
        i = bisect_left(self.parts, part)
        below = self.high[i - 1] if i else -np.inf
        above = self.low[i + 1] if i + 1 < len(self.parts) else np.inf
        return below, above

    def locate(self, value: float, inclusive: bool) -> tuple[int, int]:
        """(part, rank): how many values are below (or at) the value. The part is -1 where the rank is
        final, else the values of that part are still to be counted."""
        i = (bisect_right if inclusive else bisect_left)(self.low, value) - 1
        if i < 0:
            return -1, 0
        if value > self.high[i] or (inclusive and value == self.high[i]):
            return -1, int(self.before[i + 1])
        return self.parts[i], int(self.before[i])

    def ends(self, v: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first and the last part that may hold values closer to each v than its radius."""
        low, high, last = np.array(self.low), np.array(self.high), len(self.low) - 1
        first = np.clip(np.searchsorted(high, v - radius, side="right"), 0, last)
        end = np.clip(np.searchsorted(low, v + radius, side="left") - 1, 0, last)
        # v - radius and v + radius are rounded; settle the parts next to the ends by distance.
        for _ in range(2):
            first -= (first > 0) & (v - high[np.maximum(first - 1, 0)] < radius)
            first += (first < last) & (v - high[first] >= radius)
            end += (end < last) & (low[np.minimum(end + 1, last)] - v < radius)
            end -= (end > 0) & (low[end] - v >= radius)
        return first, end


def _parts(points: DataFrame, n: int) -> int:
    wanted = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // ROWS_PER_PART), min(wanted, n // LEAST_PER_PART))


def _deal(points: DataFrame, value: str, n: int) -> tuple[DataFrame, dict[int, Order]]:
    """The points with the number of their part, written down, and the order of each feature's parts."""
    parts = _parts(points, n)
    dealt = points.repartitionByRange(parts, "pos", value).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "points")
    # One row per feature and part.
    rows = dealt.groupBy("pos", "part").agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")
    )
    found: dict[int, list] = {}
    for r in rows.collect():
        found.setdefault(r["pos"], []).append(r)
    return dealt, {pos: Order(own) for pos, own in found.items()}


def _of_asked_parts(dealt: DataFrame, questions: DataFrame) -> DataFrame:
    asked = F.broadcast(questions.select("part").distinct())  # part numbers
    return dealt.join(asked, "part", "left_semi")


def _class_reach(ordered: np.ndarray, lead: int, size: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The open interval around each of ``size`` values, from index ``lead`` on, that ends at its
    near-th neighbour in the ordered values and at that neighbour's mirror image."""
    own = ordered[lead : lead + size]
    best, end = np.full(size, np.inf), np.zeros(size)
    padded = np.concatenate([np.full(near, -np.inf), ordered, np.full(near, np.inf)])
    at = np.arange(size) + lead + near
    # The nearest others are a run around the value: try every run.
    for left in range(near + 1):
        low, high = padded[at - left], padded[at + near - left]
        reach = np.maximum(own - low, high - own)
        closer = reach < best
        best = np.where(closer, reach, best)
        end = np.where(closer, np.where(own - low >= high - own, low, high), end)
    mirror = 2 * own - end
    return np.minimum(end, mirror), np.maximum(end, mirror)


PIECES = "pos int, id long, part int, value double, sign int, place long, total double, n long"


def _class_scores(points: DataFrame, n: int, k: int) -> DataFrame:
    """(pos, total, n): sums over (pos, x, class) points, whose classes have two rows or more."""
    dealt, orders = _deal(points, "x", n)
    # Values of one class in one part.
    ends = dealt.groupBy("pos", "class", "part").agg(
        F.count("*").alias("size"), F.sort_array(F.collect_list("x")).alias("xs")
    )
    ends = ends.select(
        "pos", "class", "part", "size",
        F.slice("xs", 1, k).alias("first"),
        F.slice(F.reverse("xs"), 1, k).alias("last"),
    )
    line = Window.partitionBy("pos", "class").orderBy("part")
    none = F.array().cast("array<double>")

    def around(step, ends_of: str) -> Column:
        return F.slice(F.concat(*[F.coalesce(step(ends_of, i).over(line), none) for i in range(1, k + 1)]), 1, k)

    borders = ends.select(
        "pos", "class", "part",
        F.sum("size").over(Window.partitionBy("pos", "class")).alias("size"),
        around(F.lag, "last").alias("below"),
        around(F.lead, "first").alias("above"),
    )

    def solve(part: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pos, own in part.groupby("pos", sort=True):
            own = own.sort_values(["x", "class"], kind="stable")
            x, classes = own["x"].to_numpy(), own["class"].to_numpy()
            number = int(own["part"].iloc[0])
            order = orders[int(pos)]
            below, above = order.borders(number)
            low, high, constant = np.empty(len(x)), np.empty(len(x)), np.empty(len(x))
            codes, names = pd.factorize(classes)
            by_class = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[by_class], np.arange(len(names) + 1))
            info = {r["class"]: r for _, r in sides[sides["pos"] == pos].iterrows()}
            for i, name in enumerate(names):
                at = by_class[cuts[i] : cuts[i + 1]]
                side = info[name]
                near = min(k, int(side["size"]) - 1)
                lead = np.asarray(side["below"], float)[::-1]
                ordered = np.concatenate([lead, x[at], np.asarray(side["above"], float)])
                low[at], high[at] = _class_reach(ordered, len(lead), len(at), near)
                constant[at] = digamma(near) - digamma(side["size"])
            settled = (low >= below) & (high <= above)
            start = np.searchsorted(x, low[settled], side="right")
            stop = np.searchsorted(x, high[settled], side="left")
            total = constant[settled].sum() - digamma(np.maximum(stop - start, 1)).sum()
            out.append((pos, -1, -1, 0.0, 0, 0, total, int(settled.sum())))
            for i in np.flatnonzero(~settled):
                name = number << 40 | int(i)
                where, rank = order.locate(low[i], True)
                out.append((pos, name, where, low[i], -1, -rank, constant[i], 1))
                where, rank = order.locate(high[i], False)
                out.append((pos, name, where, high[i], 1, rank, 0.0, 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    def count(part: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = questions.copy()
        for pos, own in questions.groupby("pos"):
            x = np.sort(part["x"].to_numpy()[part["pos"].to_numpy() == pos])
            value, sign = own["value"].to_numpy(), own["sign"].to_numpy()
            rank = np.where(sign < 0, np.searchsorted(x, value, "right"), np.searchsorted(x, value, "left"))
            out.loc[own.index, "place"] = own["place"].to_numpy() + sign * rank
        return out

    pieces = materialise(
        dealt.groupBy("part").cogroup(borders.groupBy("part")).applyInPandas(solve, PIECES), "pieces"
    )
    open_ends = pieces.filter("id >= 0")
    asked = open_ends.filter("part >= 0")
    points = _of_asked_parts(dealt, asked)
    answered = asked.groupBy("part").cogroup(points.groupBy("part")).applyInPandas(
        lambda questions, part: count(part, questions), PIECES
    )
    within = (
        open_ends.filter("part < 0")
        .unionByName(answered)
        .groupBy("pos", "id")
        .agg(F.sum("place").alias("m"), F.sum("total").alias("total"), F.sum("n").alias("n"))
        .select("pos", (F.col("total") - _digamma_column(F.greatest("m", F.lit(1)))).alias("total"), "n")
    )
    settled = pieces.filter("id < 0").select("pos", "total", "n")
    return settled.unionByName(within).groupBy("pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _closer_than(ordered: np.ndarray, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the ordered values lie closer to each x than its radius."""
    start = np.searchsorted(ordered, x - radius, side="right")
    stop = np.searchsorted(ordered, x + radius, side="left")
    # x - radius and x + radius are rounded; settle the values next to the ends by distance.
    last = len(ordered) - 1
    for _ in range(2):
        start -= (start > 0) & (x - ordered[np.maximum(start - 1, 0)] < radius)
        start += (start <= last) & (x - ordered[np.minimum(start, last)] >= radius)
        stop += (stop <= last) & (ordered[np.minimum(stop, last)] - x < radius)
        stop -= (stop > 0) & (ordered[np.maximum(stop - 1, 0)] - x >= radius)
    return np.maximum(stop - start, 0)


def _with_ends(cuts: np.ndarray, width: float) -> np.ndarray:
    """Also cut before and after equal values that several cuts are among, so that these fill whole parts."""
    width *= 1.01  # more than sums with the noise are rounded
    runs = np.split(cuts, np.flatnonzero(np.diff(cuts) > width) + 1)
    ends = [e for run in runs if len(run) > 1 for e in (run[-1] - width, run[0] + width)]
    return np.unique(np.concatenate([cuts, ends]))


def _deal_values(
    values: DataFrame, n: int, features: int, widths: list[float] | None
) -> tuple[Callable, dict[int, Order]]:
    """The number of a value's part as a function of (pos, v), and the order of each feature's parts."""
    pieces = -(-_parts(values, n) // features)
    cuts, none = quantile_cuts(values, ["pos"], "v", pieces), np.zeros(0)
    if widths:
        cuts = {(pos,): _with_ends(own, widths[pos]) for (pos,), own in cuts.items()}
    pieces = 1 + max([len(own) for own in cuts.values()], default=0)

    def part(pos: int, v: np.ndarray) -> np.ndarray:
        return pos * pieces + np.searchsorted(cuts.get((pos,), none), v, side="left")

    number = by_feature(part)
    rows = extents(values.select("pos", "v"), "part", number, "v").groupBy("part").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    )
    found: dict[int, list] = {}
    for r in rows.collect():  # one row per part
        found.setdefault(r["part"] // pieces, []).append(r)
    return number, {pos: Order(own) for pos, own in found.items()}


def _asked(dealt: DataFrame, questions: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(points, questions)`` in each part that is asked something, both in blocks."""
    asking = ["home", "at", "v", "radius"]
    blocks = deal_blocks(questions.select("part", *asking), "part", lambda part, *_: part, asking)
    points = _of_asked_parts(dealt, questions)
    return blocks.groupBy("part").cogroup(points.groupBy("part")).applyInArrow(
        lambda q, p: answer(p, q), schema
    )


MARGIN_ROWS = "pos int, home int, at int, v double, radius double, inside long, first int, last int, total double"


def _round_sums(values: DataFrame, number: Callable, orders: dict[int, Order], homes: tuple[int, int]) -> list:
    """(pos, total) rows of the values in parts from the first to before the second number."""
    of_part = {part: pos for pos, order in orders.items() for part in order.parts}

    def home(pos: np.ndarray, v: np.ndarray, _) -> np.ndarray:
        parts = number(pos, v)
        return np.where((parts >= homes[0]) & (parts < homes[1]), parts, -1)

    def solve(part: pa.Table) -> pa.Table:
        here = part["part"][0].as_py()
        pos = of_part[here]
        v, radius = numbers(part["v"]), numbers(part["radius"])
        by_value = np.lexsort((radius, v))
        v, radius = v[by_value], radius[by_value]
        order = orders[pos]
        place = bisect_left(order.parts, here)
        first, last = order.ends(v, radius)
        first, last = np.minimum(first, place), np.maximum(last, place)
        inside = _closer_than(v, v, radius)
        # Parts that lie inside as a whole need not be asked: where the ends do, and all between them and this one.
        low, high = np.array(order.low), np.array(order.high)
        cut_first = (first < place) & (v - low[first] >= radius)
        cut_last = (last > place) & (high[last] - v >= radius)
        inside = inside + order.before[place] - order.before[np.minimum(first + cut_first, place)]
        inside = inside + order.before[np.maximum(last + 1 - cut_last, place + 1)] - order.before[place + 1]
        settled = ~cut_first & ~cut_last
        at = np.flatnonzero(~settled)
        numbered = np.array(order.parts, np.int32)
        n = len(at) + 1  # the last row is the sum of those that ask nobody
        return pa.table(
            {
                "pos": np.full(n, pos, np.int32),
                "home": np.append(np.full(n - 1, here), -1).astype(np.int32),
                "at": np.append(np.arange(n - 1), -1).astype(np.int32),
                "v": np.append(v[at], 0.0),
                "radius": np.append(radius[at], 0.0),
                "inside": np.append(inside[at], 0),
                "first": np.append(np.where(cut_first, numbered[first], -1)[at], -1).astype(np.int32),
                "last": np.append(np.where(cut_last, numbered[last], -1)[at], -1).astype(np.int32),
                "total": np.append(np.zeros(n - 1), digamma(np.maximum(inside[settled], 1)).sum()),
            }
        )

    def count(part: pa.Table, asked: pa.Table) -> pa.Table:
        asking, at = numbers(asked["home"], "int32"), numbers(asked["at"], "int32")
        inside = _closer_than(np.sort(numbers(part["v"])), numbers(asked["v"]), numbers(asked["radius"]))
        by_home = np.argsort(asking, kind="stable")
        names, starts = np.unique(asking[by_home], return_index=True)
        answers = [as_blocks(c[by_home], starts) for c in (at, inside.astype(np.int64))]
        return pa.table([pa.array(names.astype(np.int64)), *answers], ["home", "at", "inside"])

    def finish(counts: pa.Table) -> pa.Table:
        at, inside = numbers(counts["at"], "int32"), numbers(counts["inside"], "int64")
        sums = np.zeros(at.max() + 1, np.int64)
        np.add.at(sums, at, inside)
        pos = of_part[counts["home"][0].as_py()]
        return pa.table({"pos": np.array([pos], np.int32), "total": [digamma(np.maximum(sums, 1)).sum()]})

    dealt = deal_blocks(values.select("pos", "v", "radius"), "part", home, ["v", "radius"])
    pieces = materialise(dealt.groupBy("part").applyInArrow(solve, MARGIN_ROWS), "margins")
    waiting = pieces.filter("home >= 0").withColumn("id", F.shiftleft(F.col("home").cast("long"), 32) + F.col("at"))
    questions = waiting.withColumn("part", F.explode(F.array("first", "last"))).filter("part >= 0")
    everyone = deal_blocks(values.select("pos", "v"), "part", number, ["v"])
    answered = _asked(everyone, questions, count, "home long, at binary, inside binary")
    own = deal_blocks(waiting.select("home", "at", "inside"), "home", lambda home, *_: home, ["at", "inside"])
    late = own.unionByName(answered).groupBy("home").applyInArrow(finish, "pos int, total double")
    totals = pieces.filter("home < 0").select("pos", "total").unionByName(late)
    return totals.groupBy("pos").agg(F.sum("total").alias("total")).collect()  # one row per feature


def _margin_sums(values: DataFrame, n: int, features: int = 1, widths: list[float] | None = None) -> DataFrame:
    """(pos, total): sums over (pos, v, radius) of digamma of the values closer than the radius, itself included.

    A count is a difference of two ranks, so at most the two parts that hold the ends of the interval are
    asked, however many lie between, and none of those that lie inside as a whole. Values closer than the widths,
    one for each feature, count as equal but for noise. The values of so many parts at a time ask.
    """
    spark = values.sparkSession
    number, orders = _deal_values(values, n, features, widths)
    parts = sorted(part for order in orders.values() for part in order.parts)
    rounds = min(MOST_ROUNDS, len(parts), -(-n // POINTS_AT_ONCE))
    totals: dict[int, float] = {}
    for i in range(rounds):
        first, last = (len(parts) * j // rounds for j in (i, i + 1))
        homes = parts[first], parts[last] if last < len(parts) else parts[-1] + 1
        with passing(spark) if rounds > 1 else nullcontext():
            for r in _round_sums(values, number, orders, homes):
                totals[r["pos"]] = totals.get(r["pos"], 0.0) + r["total"]
    return local_table(spark, list(totals.items()), "pos int, total double")


def _continuous_scores(points: DataFrame, n: int, widths: list[float], y_width: float, k: int) -> list[dict]:
    """(pos, total, n) rows: sums of digamma of both marginal counts over (pos, x, y) points. The widths tell how
    far apart the noise puts equal values of each feature and of y."""
    features = len(widths)
    dealt, grids = deal_cells(points, n, features, widths)
    found = neighbour_distances(dealt, grids, k)
    sums = {r["pos"]: dict(r.asDict(), total=0.0) for r in found.groupBy("pos").agg(F.count("*").alias("n")).collect()}
    # Both margins at once where they are few, each as a feature of its own.
    for margins in [["x", "y"]] if 2 * n <= POINTS_AT_ONCE else [["x"], ["y"]]:
        m = len(margins)
        each = F.array(*[F.struct((m * F.col("pos") + i).alias("pos"), F.col(c).alias("v")) for i, c in enumerate(margins)])
        values = found.select("radius", F.explode(each).alias("m")).select("m.pos", "m.v", "radius")
        own = [w if c == "x" else y_width for w in widths for c in margins]
        with passing(points.sparkSession):
            for r in _margin_sums(values, m * n, m * features, own).collect():
                sums[r["pos"] // m]["total"] += r["total"]
    return list(sums.values())


def _noise(digest: Column, start: int) -> Column:
    """A whole number of 32 bits from eight hex digits of the row digest."""
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("long") - F.lit(2**31)).cast("int")


def _even(noise: str) -> Column:
    """Even noise in [-1, 1)."""
    return F.col(noise).cast("double") / F.lit(2.0**31)


def _scales(rows: DataFrame, names: list[str], unit: bool) -> dict[str, tuple[float, float] | None]:
    """(divisor, size of the noise) of each column; None where all values are equal."""
    found: dict[str, tuple[float, float] | None] = {}
    for c in range(0, len(names), 16):
        chunk = names[c : c + 16]
        aggregates = []
        for i, name in enumerate(chunk):
            x = col(name).cast("double")
            aggregates += [F.stddev_pop(x).alias(f"s{i}"), F.avg(F.abs(x)).alias(f"a{i}")]
            aggregates += [(F.min(x) < F.max(x)).alias(f"v{i}")]
        r = rows.agg(*aggregates).first()
        for i, name in enumerate(chunk):
            if not r[f"v{i}"]:
                found[name] = None
                continue
            divisor = r[f"s{i}"] if unit else 1.0
            found[name] = (divisor, JITTER * max(r[f"s{i}"], r[f"a{i}"]) / divisor)
    return found


def mutual_information(
    df: DataFrame,
    target: str,
    task: str,
    numeric: list[str],
    categorical: list[str],
    key: list[str] | None = None,
    max_rows: int | None = None,
    k: int = NEIGHBOURS,
    seed: int = 42,
) -> DataFrame:
    """(feature, mi_score) for every feature, in nats, over all rows. Category columns count as codes.

    Rows without a value or target are left out for that feature; a feature with one value scores 0.
    Equal values are told apart by a tiny noise taken from the row's key, so the result does not
    depend on row order. With ``max_rows`` a sample that keeps the class shares is used instead.
    """
    names = [*numeric, *categorical]
    schema = "feature string, mi_score double"
    spark = df.sparkSession
    if not names:
        return local_table(spark, [], schema)
    with passing(spark):
        scores = _scores(df, target, task, names, categorical, key, max_rows, k, seed)
    return local_table(spark, list(scores.items()), schema)


def _scores(
    df: DataFrame,
    target: str,
    task: str,
    names: list[str],
    categorical: list[str],
    key: list[str] | None,
    max_rows: int | None,
    k: int,
    seed: int,
) -> dict[str, float]:
    spark = df.sparkSession
    classification = task == "classification"
    keys = key or df.columns
    rows = df.filter(col(target).isNotNull())
    if max_rows is not None:
        rows = stratified_sample(rows, target if classification else None, max_rows, keys, seed)
    digest = row_digest([F.lit(seed), *[col(c) for c in keys]])
    # Numbers instead of the digest: one for the noise of the features, one for that of the target.
    noise = {f"__noise_{i}": _noise(digest, start) for i, start in enumerate((13,) if classification else (13, 21))}
    rows = rows.withColumns({**noise, "__target": col(target).cast("string" if classification else "double")})
    if classification:
        sizes = rows.groupBy("__target").agg(F.count("*").alias("__size")).filter("__size > 1")
        rows = rows.join(sizes.drop("__size"), "__target", "left_semi")
    rows = label_encode(rows, categorical) if categorical else rows
    rows = materialise(rows.select(*[col(c) for c in dict.fromkeys(names)], *noise, "__target"), "rows")
    scales = _scales(rows, names, unit=not classification)
    used = [c for c in names if scales[c]]
    y_scale = None if classification else _scales(rows, ["__target"], True)["__target"]
    scores = dict.fromkeys(names, 0.0)
    if used and (classification or y_scale):
        entries = []
        for c in used:
            divisor, size = scales[c]
            entries.append(col(c).cast("double") / F.lit(divisor) + F.lit(size) * _even("__noise_0"))
        other = F.col("__target").alias("class")
        if not classification:
            divisor, size = y_scale
            other = (F.col("__target") / F.lit(divisor) + F.lit(size) * _even("__noise_1")).alias("y")

        def points(first: int, last: int) -> DataFrame:
            values = F.posexplode(F.array(*entries[first:last])).alias("pos", "x")
            return rows.select(other, values).filter("x IS NOT NULL")

        n = rows.count()
        if classification:
            sums = [r.asDict() for r in _class_scores(points(0, len(used)), n * len(used), k).collect()]
        else:
            sums = []
            at_once = max(1, POINTS_AT_ONCE // max(n, 1))
            for first in range(0, len(used), at_once):
                widths = [2 * scales[c][1] for c in used[first : first + at_once]]
                last = first + len(widths)
                with passing(spark):
                    own = _continuous_scores(points(first, last), n * len(widths), widths, 2 * y_scale[1], k)
                sums += [{**r, "pos": r["pos"] + first} for r in own]
        # One row per feature.
        for r in sums:
            size = r["n"]
            if classification and size >= MIN_ROWS:
                mi = float(digamma(size)) + r["total"] / size
            elif not classification and size > k:
                mi = float(digamma(size) + digamma(k)) - r["total"] / size
            else:
                mi = 0.0
            scores[used[r["pos"]]] = max(0.0, mi)
    return scores
