"""Connected components by alternating large-star and small-star rounds.

Every round is written to shared storage, so lineage stays short. Only edges are shuffled; the
smallest neighbour of a node is a partial aggregate, and a hub's rows can be split by adaptive joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.plans.scratch import materialise


def _signature(edges: DataFrame) -> tuple:
    # A sum of 64-bit hashes would overflow; their halves do not.
    h = F.xxhash64("u", "v")
    return tuple(
        edges.select(
            F.count("*"),
            F.sum(F.shiftrightunsigned(h, 32)),
            F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))),
        ).first()
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Missing ends and loops are ignored. No edges give no rows.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    clean = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(clean.select(high, low).distinct(), "edges")
    state = _signature(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(least, "u")
            .filter("v <> low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionAll(least.select("u", F.col("low").alias("v")))
            .distinct()
        )
        now = materialise(small, "edges")
        before, state = state, _signature(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
