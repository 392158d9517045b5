import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabscope.llm import simhash
from tabscope.llm.components import connected_components
from tabscope.llm.queries import QUERIES


def brute_fingerprint(text, width=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", __import__("re").sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=3):
    """{id: smallest reachable id} from (id, fingerprint) pairs."""
    label = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, x in pairs:
            for j, y in pairs:
                if (x ^ y).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts(n, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(20, 120))) for _ in range(n)]
    out = list(base)
    for t in base:
        words = t.split()
        for _ in range(r.randint(0, 3)):
            w = list(words)
            w[r.randrange(len(w))] = r.choice(["new", "Zz", words[0].upper()])
            out.append("  ".join(w) if r.random() < 0.3 else " ".join(w))
    return out


def test_query_equals_brute_force(spark, folder):
    rows = [(i, t) for i, t in enumerate(texts(60, 1))]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One\x0btwo"), (905, "É é word x"), (905, "É é word x")]
    got = QUERIES["op5_simhash_components"](spark, folder(*rows)).collect()
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    label = brute_components(list(prints.items()))
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == label[r.doc_id]
    assert len(set(label.values())) < len(label)


@pytest.mark.parametrize("n", [300, 10**12])
def test_every_plan_finds_all_components(spark, n, monkeypatch):
    """Planned for few or very many fingerprints, with chunks small enough that keys are cut."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    r = random.Random(5)
    prints = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(50):
            prints.add(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    pairs = list(enumerate(sorted(prints)))
    plan = simhash.search_plan(np.array([p for _, p in pairs], np.uint64), n, 3)
    assert 0 <= sum(t + 1 for _, t in plan) - 4 <= 0
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in pairs], "id long, fp long")
    found = {r.node: r.component for r in connected_components(simhash.links(nodes, plan, 3), "a", "b").collect()}
    want = brute_components(pairs)
    assert {i: found.get(i, i) for i in want} == want


def test_a_large_ball_is_reported_as_a_forest():
    r = np.random.default_rng(1)
    fps = np.unique(np.uint64(1) << r.integers(0, 64, (3000, 2)).astype(np.uint64)).astype(np.uint64)
    a, b = simhash._forest(np.arange(len(fps)), fps, 3)
    assert sum(map(len, a)) == len(fps) - 1


def test_thresholds_leave_a_useless_group_out():
    """Bits that never change make one group worthless; its threshold is -1."""
    r = np.random.default_rng(2)
    sample = r.integers(0, 1 << 62, 2000, dtype=np.int64).astype(np.uint64) & np.uint64(0x0000FFFFFFFFFFFF)
    plan = simhash.search_plan(sample, 10**7, 3)
    assert sum(t + 1 for _, t in plan) == 4


def test_components_of_paths_hubs_loops_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 200)]
    rows = spark.createDataFrame([*path, *hub, (500, 500), (None, 3), (1, 0)], "a long, b long")
    got = {r.node: r.component for r in connected_components(rows, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 300)}}
    assert connected_components(rows.filter("a < 0"), "a", "b").collect() == []


def test_empty_single_and_missing_ids(spark, documents):
    assert simhash.simhash_components(documents()).collect() == []
    assert [r.component_id for r in simhash.simhash_components(documents((4, "a b c d"))).collect()] == [4]
    got = simhash.simhash_components(documents((None, "a b c"), (9, "a b c"), (None, "q r s t u v"))).collect()
    assert sorted((r.component_id for r in got), key=str) == [9, 9, None]


def test_one_of_each_group_stays(documents):
    long = " ".join(f"w{i % 37}" for i in range(4000))
    docs = documents((5, long), (3, long.upper()), (8, "something else entirely here"), (8, "something else entirely here"))
    kept = simhash.keep_one_of_each_group(docs.withColumn("fp", F.lit("x")))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 8]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
