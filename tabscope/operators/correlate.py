"""Pearson and Spearman correlation tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import col, correlation_strength, position_in, vif
from tabscope.plans.counts import value_counts
from tabscope.plans.kinds import clean, infer_kinds
from tabscope.plans.moments import basic_stats
from tabscope.plans.pairs import pair_correlations
from tabscope.plans.scratch import materialise
from tabscope.plans.local import local_table

VALUES_PER_PART = 200_000
RANKED_VALUES = 2_000_000  # different values, over all columns, whose ranks are sent to the tasks: 32 MB
PAIRS_PER_PASS = 128


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, stats: dict | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """(col_a, col_b, r) for all ordered pairs, 4 dp; NULL where a column is constant. ``pairs`` is the
    result of ``pair_correlations`` where that is at hand."""
    names = infer_kinds(df).numeric if columns is None else list(columns)
    stats = stats or basic_stats(df, names)
    pairs = pair_correlations(df, names, stats=stats) if pairs is None else pairs
    pairs = pairs.select("col_a", "col_b", F.round("r", 4).alias("r"))
    ones = [(c, c, 1.0 if stats[c]["min"] != stats[c]["max"] else None) for c in names]
    diagonal = local_table(df.sparkSession, ones, "col_a string, col_b string, r double")
    mirrored = pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    return pairs.unionByName(mirrored).unionByName(diagonal)


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by falling |r| with a strength label, from ``pair_correlations``."""
    r = F.coalesce(F.round("r", 4), F.lit(0.0))
    return (
        pairs.select("col_a", "col_b", r.alias("r"))
        .withColumn("strength", correlation_strength(F.col("r")))
        .orderBy(F.desc(F.abs("r")), "col_a", "col_b")
    )


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """The one pair with the largest |r|; empty when there is none above zero."""
    return ranked_pairs(pairs).filter(F.abs("r") > 0).limit(1)


def collinear_pairs(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs with |r| over the threshold and their variance inflation factor (1 dp)."""
    a = F.abs("r")
    return (
        pairs.filter(a > threshold)
        .select("col_a", "col_b", a.alias("abs_r"), F.round(vif(F.col("r")), 1).alias("vif"))
        .orderBy(F.desc("abs_r"), "col_a", "col_b")
    )


def feature_target_correlation(
    df: DataFrame, target: str, columns: list[str] | None = None, top: int = 3
) -> DataFrame:
    """(feature, r, place): Pearson with a numeric target, 4 dp; ``place`` marks the top ones."""
    names = [c for c in (columns or infer_kinds(df).numeric) if c != target]
    pairs = pair_correlations(df, pairs=[(c, target) for c in names])
    r = F.coalesce(F.round("r", 4), F.lit(0.0))
    best = Window.orderBy(F.desc(F.abs("r")), position_in(df.columns, F.col("feature")))
    return (
        pairs.filter("n > 1")
        .select(F.col("col_a").alias("feature"), r.alias("r"))
        .withColumn("place", F.row_number().over(best))
        .withColumn("place", F.when(F.col("place") <= top, F.col("place")))
    )


def _average_ranks(cells: DataFrame, side: str) -> DataFrame:
    """(pair, side, rank) with average ranks over the rows of each pair.

    Counts are first summed per value. The values are dealt by range into parts of about
    ``VALUES_PER_PART``, however they are spread; running totals are formed inside the parts and added
    to those of the parts below, so no pair has to be ranked in one task.
    """
    values = materialise(cells.groupBy("pair", side).agg(F.sum("n").alias("n")), "rank-values")
    parts = max(1, -(-values.count() // VALUES_PER_PART))
    dealt = values.repartitionByRange(parts, "pair", side).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "rank-parts")
    below = Window.partitionBy("pair").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("pair", "part")
        .agg(F.sum("n").alias("rows"))
        .withColumn("before", F.coalesce(F.sum("rows").over(below), F.lit(0)))
        .select("pair", "part", "before")
    )
    inner = Window.partitionBy("pair", "part").orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("before")
    return dealt.join(offsets, ["pair", "part"]).select(
        "pair", side, (smaller + (F.col("n") + 1) / 2).alias(f"rank_{side}")
    )


def _by_pair(numbers: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, rho) with a ranking for each pair, over the rows that both columns share."""
    both = [
        F.when(
            col(a).isNotNull() & col(b).isNotNull(),
            F.struct(col(a).alias("a"), col(b).alias("b")),
        )
        for a, b in pairs
    ]
    cells = (
        numbers
        .select(F.posexplode(F.array(*both)).alias("pair", "v"))
        .filter("v IS NOT NULL")
        .groupBy("pair", F.col("v.a").alias("a"), F.col("v.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = materialise(cells, "rank-cells")
    ranked = cells.join(_average_ranks(cells, "a"), ["pair", "a"]).join(
        _average_ranks(cells, "b"), ["pair", "b"]
    )
    # Ranks average to (N+1)/2; centred on a per-pair constant the sums keep their digits.
    size = cells.groupBy("pair").agg(F.sum("n").alias("rows"))
    middle = (F.col("rows") + 1) / 2
    da, db, n = F.col("rank_a") - middle, F.col("rank_b") - middle, F.col("n")
    sums = ranked.join(F.broadcast(size), "pair").groupBy("pair").agg(
        F.max("rows").alias("n"),
        F.sum(n * da * db).alias("ab"),
        F.sum(n * da * da).alias("aa"),
        F.sum(n * db * db).alias("bb"),
    )
    left = F.array(*[F.lit(a) for a, _ in pairs])
    right = F.array(*[F.lit(b) for _, b in pairs])
    return sums.select(
        F.element_at(left, F.col("pair") + 1).alias("col_a"),
        F.element_at(right, F.col("pair") + 1).alias("col_b"),
        "n",
        F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("rho"),
    )


def _with_ranks(numbers: DataFrame, columns: list[str]) -> DataFrame | None:
    """The columns as average ranks, each ranked once over all rows that have it; None where there are more
    than ``RANKED_VALUES`` different values to send to the tasks."""
    values = F.array(*[col(c) for c in columns])
    long = numbers.select(F.posexplode(values).alias("pair", "a")).filter("a IS NOT NULL")
    # Counted in the tasks first: a value of a column crosses the shuffle once a task.
    counted = materialise(long.groupBy("pair", "a").agg(F.count("*").alias("n")), "column-values")
    if counted.count() > RANKED_VALUES:
        return None
    found = _average_ranks(counted, "a").toArrow().to_pandas()
    ranks: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(columns)):
        own = found[found["pair"] == i].sort_values("a")
        ranks.append((own["a"].to_numpy(float), own["rank_a"].to_numpy(float)))
    sent = numbers.sparkSession.sparkContext.broadcast(ranks)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (known, rank), given in zip(sent.value, batch.columns):
                x = given.to_numpy(zero_copy_only=False)
                there = ~np.isnan(x)
                found = np.full(len(x), np.nan)
                found[there] = rank[np.searchsorted(known, x[there])]
                out.append(pa.array(found, from_pandas=True))
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    named = numbers.select(*[col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    return named.mapInArrow(ranked, named.schema).toDF(*columns)


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, n, rho) with ranks taken inside the rows that both columns share.

    Columns that are missing in the same rows share their rows with each other, so each is ranked once for
    all its pairs with them, and these are correlated as ranks. Only pairs of columns that are missing in
    different rows are ranked for themselves, and those with too many values to send to the tasks.
    """
    spark = df.sparkSession
    schema = "col_a string, col_b string, n long, rho double"
    pairs = list(combinations(columns, 2))
    if not pairs:
        return local_table(spark, [], schema)
    numbers = clean(df.select(*[col(c).try_cast("double").alias(c) for c in columns]), columns)
    here = numbers.select(*[col(c).isNotNull().cast("double").alias(c) for c in columns])
    shared = here.agg(*[F.sum(col(c)).alias(c) for c in columns]).first()
    both = {(r["col_a"], r["col_b"]): r["rows"] for r in _rows_with_both(here, pairs)}
    present = {c: int(shared[c] or 0) for c in columns}
    # As many rows with both as with either: the same rows.
    alike = [p for p in pairs if both[p] == present[p[0]] == present[p[1]] and both[p]]
    out = []
    if alike:
        used = [c for c in columns if any(c in p for p in alike)]
        ranks = _with_ranks(numbers, used)
        if ranks is None:
            alike = []
        else:
            out.append(pair_correlations(ranks, pairs=alike).select("col_a", "col_b", "n", F.col("r").alias("rho")))
    rest = [p for p in pairs if p not in set(alike) and both[p]]
    if rest:
        out.append(_by_pair(numbers, rest))
    return reduce(DataFrame.unionByName, out) if out else local_table(spark, [], schema)


def _rows_with_both(here: DataFrame, pairs: list[tuple[str, str]]) -> list:
    """Rows in which both columns are there, a row a pair of columns; plain sums, in a few passes."""
    found = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        row = here.agg(*[F.sum(col(a) * col(b)).alias(f"s{i}") for i, (a, b) in enumerate(chunk)]).first()
        found += [{"col_a": a, "col_b": b, "rows": int(row[i] or 0)} for i, (a, b) in enumerate(chunk)]
    return found


def ordinal_spearman(
    df: DataFrame, encoded: list[str], subtypes: dict[str, str] | None = None
) -> DataFrame:
    """Spearman among encoded ordinal columns with at least three values; empty below two."""
    chosen = [
        c for c in encoded if c in df.columns and (not subtypes or subtypes.get(c) == "ordinal")
    ]
    distinct = value_counts(df, chosen).groupBy("column").count().filter("count >= 3")
    enough = {r["column"] for r in distinct.select("column").collect()}
    chosen = [c for c in chosen if c in enough]
    return spearman_pairs(df, chosen if len(chosen) >= 2 else [])


def notable_ordinal_pairs(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.filter(F.abs("rho") >= threshold).orderBy(F.desc(F.abs("rho")), "col_a", "col_b")
