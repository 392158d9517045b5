import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tabscope.llm.queries import QUERIES
from tabscope.llm.sharding import shard_documents, shard_of

ROWS = [(i, f"text {i}") for i in range(3000)] + [(7, "text 7")] * 5 + [(None, None), (9000, ""), (9001, "é" * 9)]


def test_query_follows_the_key_law(spark, folder):
    rows = QUERIES["op6_rendezvous_shards"](spark, folder(*ROWS)).collect()
    assert len(rows) == len(ROWS)
    assert {r.law for r in rows} == {"key"} and {r.shard for r in rows} == set(range(24))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 0.5 / 25 < moved / len(rows) < 2 / 25
    texts = {i: t or "" for i, t in ROWS}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1


def brute(key, weights):
    """The shard of least cost, hashed by another library."""
    text = xxhash.xxh64_intdigest("" if key is None else str(key), seed=42)

    def cost(shard):
        unit = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=text) >> 11) + 0.5) / 2**53
        return -math.log(unit) / weights[shard]

    return min((s for s in range(len(weights)) if weights[s] > 0), key=cost)


def test_query_equals_brute_force(spark, folder):
    rows = QUERIES["op6_rendezvous_shards"](spark, folder(*ROWS)).collect()
    for r in rows:
        assert r.shard == brute(r.doc_id, [1.0] * 24) and r.grown_shard == brute(r.doc_id, [1.0] * 25)


def test_weighted_shards_equal_brute_force(spark):
    weights = [1, 3, 0, 4, 0.25]
    df = spark.range(3000).select("id", shard_of(F.col("id"), weights).alias("shard"))
    assert all(r.shard == brute(r.id, weights) for r in df.collect())


def test_slots_across_groups(documents, monkeypatch):
    monkeypatch.setattr("tabscope.llm.sharding.ROWS_PER_SLOT_GROUP", 50)
    rows = shard_documents(documents(*ROWS), [1.0] * 3).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights_set_the_shares(spark):
    shares = Counter(
        r.shard for r in spark.range(20_000).select(shard_of(F.col("id"), [1, 3, 0, 4]).alias("shard")).collect()
    )
    assert set(shares) == {0, 1, 3}
    assert abs(shares[0] / 20_000 - 1 / 8) < 0.02 and abs(shares[3] / 20_000 - 1 / 2) < 0.02


def test_fewer_shards_move_only_the_lost_rows(spark):
    df = spark.range(2000).select(
        shard_of(F.col("id"), [1.0] * 5).alias("five"), shard_of(F.col("id"), [1.0] * 4).alias("four")
    )
    assert df.filter("five < 4 AND five <> four").count() == 0


def test_empty_table_and_no_shard(spark, documents):
    assert shard_documents(documents(), [1.0]).collect() == []
    with pytest.raises(ValueError):
        shard_of(F.col("id"), [0.0])
