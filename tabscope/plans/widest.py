"""The two classes of each feature that lie furthest apart in units of their spread, by branch and bound.

Classes are points (mean, std). They are put into cells, and two bounds tell how far two classes of two cells
can be apart: the widest reach of the cells' means over the least spread of either; and, for any centre c,
sqrt(2 (p^2 + q^2)) with p and q the largest (c - mean) / std of the one and (mean - c) / std of the other
cell (by the inequality of Cauchy and Schwarz), which stays sharp where spread grows with the mean. c is where
it holds with equality for the widest pair known so far. A pair of cells whose bound is no larger than that
pair's distance is dropped; one with few pairs of classes is compared outright; of the others both cells are
cut, and the pairs of their parts are looked at next. So only cells along the frontier are ever opened.

Cells, pairs and bounds are tables; the driver sees one row a feature. Rounding keeps the first bound in
order with the distances, since both are one expression; the second is widened by more than it can lose. So
the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.plans.local import keep_rows
from tabscope.plans.scratch import materialise

CUTS = 4  # a cell becomes CUTS x CUTS
COMPARED = 4096  # pairs of classes in two cells that are compared outright
ROUNDS = 24  # then what is left is compared, whatever it is


def apart(reach: Column, s1: Column, s2: Column) -> Column:
    """Distance in units of the pooled spread; none without any spread."""
    return F.coalesce(F.try_divide(reach, F.sqrt((s1 * s1 + s2 * s2) / 2)), F.lit(0.0))


def _boxes(points: DataFrame, centres: DataFrame | None) -> DataFrame:
    """What a cell holds: its number of classes, its ranges, the three classes at their ends, and how far
    below and above the feature's centre they lie in units of their own spread."""
    own = F.struct("mean", "std")
    rows = points.withColumn("c", F.col("mean")) if centres is None else points.join(F.broadcast(centres), "feature")

    def ratio(distance: Column) -> Column:
        far = F.when(distance > 0, F.lit(float("inf"))).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(distance, F.col("std")), far))

    return rows.groupBy("feature", "flat", "cell").agg(
        F.count("*").alias("n"),
        F.min("mean").alias("lo"),
        F.max("mean").alias("hi"),
        F.min("std").alias("least"),
        F.max("std").alias("most"),
        F.max(ratio(F.col("c") - F.col("mean"))).alias("below"),
        F.max(ratio(F.col("mean") - F.col("c"))).alias("above"),
        F.array(F.min_by(own, "mean"), F.max_by(own, "mean"), F.min_by(own, "std")).alias("ends"),
    )


def _pair(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """The distance of two classes and the centre for which the second bound is their distance."""
    centre = F.try_divide(m1 * s2 * s2 + m2 * s1 * s1, s1 * s1 + s2 * s2)
    return F.struct(apart(F.abs(m1 - m2), s1, s2).alias("d"), F.coalesce(centre, m1).alias("c"))


def _sided(boxes: DataFrame, side: str, *others: Column) -> DataFrame:
    return boxes.select("feature", *others, F.struct(*[c for c in boxes.columns if c != "feature"]).alias(side))


def _with_bounds(pairs: DataFrame, centred: bool) -> DataFrame:
    """(feature, a, b) with their bound and the widest of some pairs of classes that the cells hold."""
    a, b = F.col("a"), F.col("b")
    reach = F.greatest(b["hi"] - a["lo"], a["hi"] - b["lo"])
    known = [
        _pair(a["ends"][i]["mean"], a["ends"][i]["std"], b["ends"][j]["mean"], b["ends"][j]["std"])
        for i in range(3)
        for j in range(3)
    ]
    bound = apart(reach, a["least"], b["least"])
    if centred:
        squares = [a[x] * a[x] + b[y] * b[y] for x, y in (("below", "above"), ("above", "below"))]
        bound = F.least(bound, F.sqrt(2 * F.greatest(*squares)) * F.lit(1 + 1e-12))
    # Two classes without spread have distance 0 by definition, which no bound has to tell.
    kept = pairs.filter(~(a["flat"] & b["flat"]))
    return kept.select("feature", "a", "b", bound.alias("bound"), F.greatest(*known).alias("best"))


def _compare(leaves: DataFrame, points: DataFrame) -> DataFrame:
    """(feature, best, compared) over all pairs of classes of the pairs of cells."""
    keys = leaves.select(
        "feature",
        F.col("a.flat").alias("flat_a"), F.col("a.cell").alias("cell_a"),
        F.col("b.flat").alias("flat_b"), F.col("b.cell").alias("cell_b"),
    )

    def side(s: str) -> DataFrame:
        return points.select(
            "feature", F.col("flat").alias(f"flat_{s}"), F.col("cell").alias(f"cell_{s}"),
            F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}"),
        )

    both = keys.join(side("a"), ["feature", "flat_a", "cell_a"]).join(side("b"), ["feature", "flat_b", "cell_b"])
    found = _pair(F.col("mean_a"), F.col("std_a"), F.col("mean_b"), F.col("std_b"))
    return both.groupBy("feature").agg(F.max(found).alias("best"), F.count("*").alias("compared"))


def _better(*found: DataFrame) -> DataFrame:
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    # One row per feature.
    return keep_rows(rows.groupBy("feature").agg(F.max("best").alias("best"), F.sum("compared").alias("compared")))


def _parts(points: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """The classes of the cells in the pairs, each in a part of its cell: cut in its means and log spreads."""
    cells = open_pairs.select("feature", "a.*").unionByName(open_pairs.select("feature", "b.*"))
    cells = cells.select("feature", "flat", "cell", "lo", "hi", "least", "most").distinct()

    def part(x: Column, low: Column, high: Column) -> Column:
        # Halved, so that the difference stays finite.
        at = F.floor(F.try_divide(x / 2 - low / 2, high / 2 - low / 2) * CUTS)
        return F.coalesce(F.least(at, F.lit(CUTS - 1)), F.lit(0)).cast("long")

    i = part(F.col("mean"), F.col("lo"), F.col("hi"))
    j = F.when(F.col("flat"), F.lit(0)).otherwise(part(F.ln("std"), F.ln("least"), F.ln("most")))
    inside = points.join(cells, ["feature", "flat", "cell"])
    return inside.select("feature", "mean", "std", "flat", (F.col("cell") * CUTS**2 + i * CUTS + j).alias("cell"))


def widest_pairs(classes: DataFrame) -> DataFrame:
    """(feature, d, compared) from (feature, mean, std) rows: the largest distance, and how many pairs of
    classes were compared for it."""
    usable = classes.filter(F.col("mean").isNotNull() & F.col("std").isNotNull())
    points = materialise(
        usable.select("feature", "mean", "std", (F.col("std") == 0).alias("flat"), F.lit(0).cast("long").alias("cell")),
        "classes",
    )
    none = F.lit(0).cast("long").alias("compared")

    def root(centres: DataFrame | None) -> DataFrame:
        boxes = keep_rows(_boxes(points, centres))  # two a feature
        return _with_bounds(_sided(boxes, "a").join(_sided(boxes, "b"), "feature").filter("a.flat <= b.flat"), centres is not None)

    def centres() -> DataFrame:
        return found.select("feature", "best.c")

    found = _better(root(None).groupBy("feature").agg(F.max("best").alias("best"), none))
    pairs = root(centres())
    for step in range(ROUNDS):
        pairs = materialise(pairs, "cell-pairs")
        found = _better(found, pairs.groupBy("feature").agg(F.max("best").alias("best"), none))
        small = F.col("a.n") * F.col("b.n") <= COMPARED if step < ROUNDS - 1 else F.lit(True)

        def alive() -> DataFrame:
            known = F.broadcast(found.select("feature", F.col("best.d").alias("d")))
            return pairs.join(known, "feature").filter("bound > d")

        found = _better(found, _compare(alive().filter(small), points))
        left = alive().filter(~small).select("feature", "a", "b")
        if left.isEmpty():
            break
        points = materialise(_parts(points, left), "class-parts")
        boxes = materialise(_boxes(points, centres()), "class-cells")
        parent = F.expr(f"cell div {CUTS ** 2}")
        a = _sided(boxes, "a", F.col("flat").alias("flat_a"), parent.alias("cell_a"))
        b = _sided(boxes, "b", F.col("flat").alias("flat_b"), parent.alias("cell_b"))
        keys = left.select(
            "feature",
            F.col("a.flat").alias("flat_a"), F.col("a.cell").alias("cell_a"),
            F.col("b.flat").alias("flat_b"), F.col("b.cell").alias("cell_b"),
        )
        pairs = keys.join(a, ["feature", "flat_a", "cell_a"]).join(b, ["feature", "flat_b", "cell_b"])
        # The parts of one cell meet once.
        once = (F.col("flat_a") != F.col("flat_b")) | (F.col("cell_a") != F.col("cell_b"))
        pairs = pairs.filter(once | (F.col("a.cell") <= F.col("b.cell"))).select("feature", "a", "b")
        pairs = _with_bounds(pairs, True)
    return found.select("feature", F.col("best.d").alias("d"), "compared")
