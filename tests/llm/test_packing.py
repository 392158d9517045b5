import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabscope.llm import packing
from tabscope.llm.packing import LocalSearch, best_fit, pack, pack_pieces
from tabscope.llm.queries import QUERIES
from tabscope.llm.tokenizing import WORD_BPE, vocabulary


def checked(sizes, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(b and sum(int(sizes[i]) for i in b) <= capacity for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_search_never_loses_and_never_uses_more_bins(sizes):
    sizes = np.array(sizes, np.int64)
    start = best_fit(sizes, 30)
    checked(sizes, start, 30)
    found = pack(sizes, 30)
    checked(sizes, found, 30)
    assert len(found) <= len(start)


def test_every_step_raises_the_squares():
    r = np.random.default_rng(1)
    sizes = r.integers(200, 420, 300)
    search = LocalSearch(sizes, best_fit(sizes, 1000), 1000)
    steps = 0
    for donor in np.argsort(search.fill)[:20].tolist():
        pairs = search.pairs()
        while search.fill[donor] > 0:
            before = int((search.fill**2).sum())
            if not search.step(donor, pairs):
                break
            steps += 1
            assert int((search.fill**2).sum()) > before and search.fill.max() <= 1000
    assert steps > 0


@pytest.mark.parametrize(
    "start, sizes",
    [
        ([[0], [1]], [3, 5]),  # a move
        ([[0, 1], [2, 3], [4]], [6, 2, 5, 4, 3]),  # needs 5 against 4 or 6 against 5
        ([[0, 1, 2], [3], [4, 5]], [3, 3, 2, 7, 5, 5]),  # 7 against 3 + 3
    ],
)
def test_moves_and_exchanges(start, sizes):
    search = LocalSearch(np.array(sizes), [list(b) for b in start], 10)
    found = search.run()
    checked(np.array(sizes), found, 10)
    assert len(found) == -(-sum(sizes) // 10) or len(found) < len(start)


def test_search_saves_bins_where_best_fit_does_not():
    r = np.random.default_rng(0)
    sizes = r.integers(900, 1500, 1500)
    assert len(pack(sizes, 4096)) < len(best_fit(sizes, 4096))


ROWS = [(i, " ".join(random.Random(i).choices(["alpha", "Beta,", "it's", "水", "é"], k=random.Random(-i).randint(1, 900)))) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, "word " * 9000), (103, "x" * 100_000), (5, ROWS[5][1]), (None, "a b c"), (104, "word " * 4095), (105, "word " * 4096)]


def test_query_is_a_whole_packing(spark, folder):
    got = QUERIES["op7_packed_sequences"](spark, folder(*ROWS)).collect()
    library = Tokenizer.from_str(vocabulary(WORD_BPE))
    want = []
    for doc, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.append((str(doc), n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        place = 0
        for offset, length in sorted(members):
            assert offset == place
            place += length
        assert place <= 4096
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 4096) + 1


def test_blocks_repeated_ids_and_columns_kept(spark):
    rows = [(7, 0, 0, 1 + i % 4096, i, "x") for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id int, piece int, start long, length long, ids_crc32 long, `odd name` string")
    got = pack_pieces(pieces, 4096, block=500)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    got = got.collect()
    assert len(got) == 3000 and sorted(r.ids_crc32 for r in got) == list(range(3000))
    fills = defaultdict(int)
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 4096
    assert len(fills) <= -(-sum(r[3] for r in rows) // 4096) + 7


def test_empty_table(documents):
    assert packing.pack_documents(documents()).collect() == []
