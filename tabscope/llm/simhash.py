"""SimHash near-duplicates, searched by the general pigeonhole principle.

A fingerprint has a bit set where over half of the shingle hashes have it. Two fingerprints within r
bits agree, on at least one of m groups of bits, within that group's own threshold, as long as the
thresholds sum to r - m + 1 (a threshold of -1 leaves a group out). Correlated bits share a group, so
the other groups stay selective. Thresholds come from a dynamic program over estimated costs: probes
written plus candidates compared, measured on a bounded sample of fingerprints. The sample only steers
the plan; every fingerprint is written under its probe keys and every candidate is verified.

Equal fingerprints are one node. Keys held by many fingerprints are cut into chunks whose pairs of
chunks are compared by different tasks; a task reports a spanning forest of the links it sees, not all
pairs. Components are therefore exact for any distribution of fingerprints.

A missing or blank text has fingerprint zero and is linked like any other. A missing id takes part in
no link and gets the component of its fingerprint if other rows have one, else none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.components import connected_components
from tabscope.plans.scratch import materialise

SAMPLE = 4000  # fingerprints that steer the choice of groups and thresholds
CHUNK = 4096  # fingerprints of one key that one task compares at a time
ROW_COST, PAIR_COST = 100.0, 1.0  # a probe written and read against a candidate compared
SMALL = 12  # keys with up to so many fingerprints are compared pair by pair, side by side


def fingerprint_of(text: bytes | None, width: int) -> int:
    """64 bits as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the fingerprint of the text as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def group_bits(bits: np.ndarray, groups: int) -> list[list[int]]:
    """Bit positions in groups of nearly equal size, each grown around its most correlated bits."""
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(centred.T @ centred) / max(1, len(bits))
    np.fill_diagonal(tied, 0)
    free, out = list(range(64)), []
    for g in range(groups):
        size = (64 - sum(map(len, out))) // (groups - g)
        own = [max(free, key=lambda b: tied[b, free].sum())]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: tied[b, own].sum()))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def _close_shares(values: np.ndarray, most: int) -> np.ndarray:
    """Shares of sampled pairs within 0..most bits."""
    counts = np.zeros(65, np.int64)
    for i in range(0, len(values), 256):
        near = np.bitwise_count(values[i : i + 256, None] ^ values[None, :])
        counts += np.bincount(near.ravel(), minlength=65)
    counts[0] -= len(values)
    return np.cumsum(counts)[: most + 1] / max(1, len(values) * (len(values) - 1))


def search_plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[int, int]]:
    """(mask, threshold) for each group in use, of the cheapest number of groups."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(float)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(1, radius + 2):
        masks = [sum(1 << (63 - b) for b in g) for g in group_bits(bits, m)]
        total = radius - m + 1
        # The cheapest way to spend thresholds on the groups so far, by their sum.
        paths: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for mask in masks:
            width = mask.bit_count()
            shares = _close_shares(sample & np.uint64(mask), radius)
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in paths.items():
                for t in range(-1, radius + 1):
                    probes = sum(comb(width, j) for j in range(t + 1))
                    even = probes / 2.0**width
                    pairs = n * n / 2 * max(even, shares[t]) if t >= 0 else 0.0
                    price = cost + n * probes * ROW_COST + pairs * PAIR_COST
                    if used + t not in step or price < step[used + t][0]:
                        step[used + t] = (price, [*chosen, t])
            paths = step
        if total in paths and (best is None or paths[total][0] < best[0]):
            best = (paths[total][0], list(zip(masks, paths[total][1])))
    return [(mask, t) for mask, t in best[1] if t >= 0]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def probe_rows(nodes: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """(id, fp, part, key, own): every node under its own key and the keys within the threshold."""
    out = None
    for part, (mask, threshold) in enumerate(plan):
        places = [1 << b for b in range(64) if mask >> b & 1]
        flips = [sum(c) for j in range(threshold + 1) for c in combinations(places, j)]
        flip = F.explode(F.lit([_signed(f) for f in flips]).cast("array<bigint>")).alias("flip")
        base = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        rows = nodes.select("id", "fp", F.lit(part).alias("part"), base.alias("base"), flip).select(
            "id", "fp", "part", F.col("base").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own")
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def _forest(ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that join what is connected: each node compares itself once with those not yet reached."""
    a, b = [], []
    left = np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[node]) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(len(found), ids[node]))
                b.append(ids[found])
                queue.extend(found)
                left = left[~near]
    return a, b


def links(nodes: DataFrame, plan: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b): links within the radius that connect all nodes which such links connect."""
    probes = probe_rows(nodes, plan)
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("owned"))
    sizes = sizes.filter("n > 1 AND owned").select(
        "part", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")
    )
    # Chunk c of a key meets every other chunk of it in a cell of its own.
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    cells = (
        probes.join(sizes, ["part", "key"])
        .select("id", "fp", "part", "key", chunk.alias("chunk"), other)
        .select("id", "fp", "part", "key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
    )
    cell = ["part", "key", "x", "y"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None

        def solve(ids, fps, starts, ends):
            a, b = [], []
            size = ends - starts
            small = size <= SMALL
            group = np.repeat(np.where(small, np.arange(len(size)), -1 - np.arange(len(size))), size)
            for d in range(1, min(SMALL, len(ids))):
                near = (group[:-d] == group[d:]) & (group[d:] >= 0)
                near &= np.bitwise_count(fps[:-d] ^ fps[d:]) <= radius
                a.append(ids[:-d][near])
                b.append(ids[d:][near])
            for s, e in zip(starts[~small], ends[~small]):
                more = _forest(ids[s:e], fps[s:e], radius)
                a += more[0]
                b += more[1]
            a, b = (np.concatenate(x) if x else np.zeros(0, ids.dtype) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            change = np.zeros(len(now[0]), bool)
            change[0] = True
            for c in now[2:]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            # The last cell may go on in the next batch.
            if len(starts) > 1:
                yield solve(now[0][: starts[-1]], now[1][: starts[-1]].view(np.uint64), starts[:-1], starts[1:])
            rest = tuple(c[starts[-1] :] for c in now)
        if rest is not None:
            yield solve(rest[0], rest[1].view(np.uint64), np.array([0]), np.array([len(rest[0])]))

    kind = nodes.schema["id"].dataType.simpleString()
    ordered = cells.repartition(*cell).sortWithinPartitions(*cell)
    return ordered.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable by links."""
    rows = materialise(fingerprints(docs, width), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    named = nodes.filter("id IS NOT NULL")
    n = named.count()
    sample = named.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"]
    if n > 1:
        plan = search_plan(sample.to_numpy(np.int64).view(np.uint64), n, radius)
        found = connected_components(links(named, plan, radius), "a", "b")
        labels = nodes.join(found, nodes["id"] == found["node"], "left").select(
            "fp", F.coalesce("component", "id").alias("component_id")
        )
    else:
        labels = nodes.select("fp", F.col("id").alias("component_id"))
    return rows.join(labels.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    found = near_duplicates(docs, width, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """The rows, with all their columns, but for those whose component has a smaller id.

    Rows with one id stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, width, radius).filter("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
