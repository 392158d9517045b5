import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.llm import lm_scoring
from tabscope.llm.lm_scoring import _pack_keys, _packed, _unpack_keys, _unpacked, mixture_weights, score_documents
from tabscope.llm.queries import QUERIES


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["<end>"]


def fold_of(doc_id):
    crc = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    return 2 if crc % 5 == 1 else 1 if crc // 5 % lm_scoring.DELETED == 0 else 0


def counted(texts):
    words, pairs, contexts = Counter(), Counter(), Counter()
    for t in texts:
        before = "<start>"
        for w in tokens_of(t):
            words[w] += 1
            pairs[before, w] += 1
            contexts[before] += 1
            before = w
    return words, pairs, contexts


def bucket(n):
    return n.bit_length()


def brute(rows):
    """Scores by doc position, with exact expectation-maximisation over single tokens."""
    main = counted(t for i, t in rows if fold_of(i) == 0)
    aside = defaultdict(list)
    n_main, v_main = sum(main[0].values()), len(main[0])
    for i, t in rows:
        if fold_of(i) == 1:
            before = "<start>"
            for w in tokens_of(t):
                c = main[2][before]
                aside[bucket(c)].append((main[1][before, w] / c if c else 0, main[0][w] / max(1, n_main), 1 / (v_main + 1)))
                before = w
    weights = {}
    for b, p in aside.items():
        p, mix = np.array(p), np.array([0.0, 0.8, 0.2] if b == 0 else [0.4, 0.4, 0.2])
        for _ in range(200):
            share = p * mix
            share /= share.sum(axis=1, keepdims=True)
            new = share.mean(axis=0)
            done = abs(new - mix).max() < 1e-7
            mix = new
            if done:
                break
        mix = np.maximum(mix, [0, 0, 1e-6])
        weights[b] = mix / mix.sum()
    words, pairs, contexts = counted(t for i, t in rows if fold_of(i) != 2)
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in rows:
        base = score = 0.0
        before, seen = "<start>", tokens_of(t)
        for w in seen:
            base += math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1)))
            c = contexts[before]
            below = [b for b in weights if b <= bucket(c) and (b > 0 or bucket(c) == 0)]
            mix = weights[max(below)] if below else np.array([0.4, 0.4, 0.2] if c else [0.0, 0.8, 0.2])
            score += math.log10(mix @ [pairs[before, w] / c if c else 0, words[w] / n, 1 / (v + 1)])
            before = w
        out.append((i, len(seen), sum(words[w] > 0 for w in seen), n, base, score, fold_of(i) == 2))
    return out


def corpus(n=400):
    r = random.Random(8)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = [r.choice(common)]
        for _ in range(r.randint(0, 60)):
            words.append(common[(common.index(words[-1]) * 3 + 1) % 40] if r.random() < 0.6 and words[-1] in common else r.choice([*common, f"rare{r.randint(0, 400)}"]))
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words).upper() if i % 7 == 0 else " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "É é\x0bNew"), (3, rows[3][1]), (None, "w1 w2"), (1003, "w1 w2 " * 20_000)]


@pytest.mark.parametrize("block, span", [(lm_scoring.BLOCK_BYTES, lm_scoring.RANGE_BYTES), (700, 900)])
def test_equals_brute_force(documents, block, span):
    rows = corpus()
    got = score_documents(documents(*rows), lm_scoring.training_fold(F.col("doc_id")), block, span).collect()
    want = brute(rows)
    def order(x):
        return (str(x[0]), x[1])
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        # The weights come from rounded cells of evidence.
        assert g[5] == pytest.approx(w[5], rel=2e-3)


def test_query_and_a_better_model_than_the_base(spark, folder):
    rows = corpus()
    got = QUERIES["op2_deleted_interpolation"](spark, folder(*rows)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (fold_of(r.doc_id) == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True), st.lists(st.integers(0, 2**32 - 1)))
def test_packing_is_reversible(keys, counts):
    k, c = np.sort(np.array(keys, np.uint64)), np.array(counts, np.uint32)
    assert _unpack_keys(_pack_keys(k)).tolist() == k.tolist()
    assert _unpacked(_packed(c), np.uint32).tolist() == c.tolist()


def test_weights_follow_the_evidence():
    rows = [dict(bucket=3, n=90, pair=90 * 0.5, word=90 * 0.01), dict(bucket=3, n=10, pair=0.0, word=0.0)]
    w = mixture_weights(rows, 1000)
    assert w[3][0] > 0.85 and w[3][2] == pytest.approx(0.1, abs=0.01)
    assert w[4].tolist() == w[3].tolist() and w[0][0] == 0 and np.allclose(w.sum(axis=1), 1)


def test_empty_tables_and_no_training_rows(documents):
    assert score_documents(documents(), lm_scoring.training_fold(F.col("doc_id"))).collect() == []
    got = score_documents(documents((1, "a b"), (2, None)), F.lit(2)).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in sorted(got)] == [
        (1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0),
    ]


def test_a_blocks_keys_are_dealt_whatever_the_number_of_ranges():
    """A row for each range that has a key, few batches, and work that hardly grows with the ranges."""
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 40_000, np.uint64))
    counts = np.arange(1, len(keys) + 1)
    seconds = {}
    for bits in (0, 6, 16):
        start = time.process_time()
        batches = list(lm_scoring._by_range(keys, counts, bits))
        seconds[bits] = time.process_time() - start
        at = np.concatenate([b[0] for b in batches])
        parts = [lm_scoring._unpack_keys(p) for b in batches for p in b[1]]
        sums = [lm_scoring._unpacked(c, np.uint32) for b in batches for c in b[2]]
        assert (np.concatenate(parts) == keys).all() and (np.concatenate(sums) == counts).all()
        assert len(at) == len(set(at.tolist())) <= min(1 << bits, len(keys)) and len(batches) <= 1 + len(at) // 4096
        for i, p in zip(at, parts):
            assert not bits or (p >> np.uint64(64 - bits) == np.uint64(i)).all()
    # A thousand times the ranges; a row in each cost a batch of its own before.
    assert seconds[16] < 3.0
    assert list(lm_scoring._by_range(keys[:0], None, 4)) == []
