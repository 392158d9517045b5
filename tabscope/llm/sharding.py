"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Every (key, shard) pair has a pseudo-random cost -ln(u) / weight; a record goes to the shard with the
least cost. A further shard only adds one cost, so records move into it or stay. Expected shares are
in proportion to the weights. A missing key counts as the empty key. Rows with equal keys share a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_SLOT_GROUP = 100_000


def shard_costs(key: Column, weights: Sequence[float]) -> list[Column]:
    """One struct (cost, shard) for each shard of positive weight."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    costs = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        # The upper 53 bits as a number strictly between 0 and 1.
        unit = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11) + 0.5) / F.lit(float(1 << 53))
        cost = -F.log(unit) / F.lit(float(weight))
        costs.append(F.struct(cost.alias("cost"), F.lit(shard).alias("shard")))
    if not costs:
        raise ValueError("at least one shard needs a positive weight")
    return costs


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a record key. The result depends on the key and the weights alone."""
    return F.array_min(F.array(*shard_costs(key, weights)))["shard"]


def with_slots(rows: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Equal rows are counted before the shuffle and numbered together. A shard is cut by a hash of the
    order columns into groups of about ``ROWS_PER_SLOT_GROUP`` rows; groups are numbered on their own
    and shifted by the rows before them, so no shard has to pass through one task.
    """
    columns = rows.columns
    groups = max(1, rows.count() // ROWS_PER_SLOT_GROUP)
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__copies"))
    cut = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(groups)).cast("int")
    counted = counted.withColumn("__group", cut)
    sizes = counted.groupBy(shard, "__group").agg(F.sum("__copies").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        shard, "__group", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__shift")
    )
    inside = (
        Window.partitionBy(shard, "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("__before", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__copy")
    return (
        placed.join(shifts, [shard, "__group"])
        .select(*columns, "__shift", "__before", copy)
        .select(*columns, (F.col("__shift") + F.col("__before") + F.col("__copy")).alias(slot))
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, and the shard that
    the record would have after one more shard of weight ``grown_weight`` joins."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
