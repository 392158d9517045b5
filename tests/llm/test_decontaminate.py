import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm import decontaminate
from tabscope.llm.decontaminate import Finder, best_match, drop_contaminated, find_passages, passage, pieces_of
from tabscope.llm.queries import QUERIES

WORD = st.sampled_from("abc")


def brute_match(item, stretch):
    """Least edit distance of the item to any passage, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in stretch:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=9), st.lists(WORD, max_size=14))
def test_bit_vectors_equal_the_table(item, stretch):
    best, _ = best_match(item, stretch)
    assert best == brute_match(item, stretch)
    d, start, end = passage(item, stretch)
    assert d == best == distance(item, stretch[start:end])


def test_long_items_need_no_blocks():
    item = [f"w{i}" for i in range(500)]
    stretch = ["x"] * 30 + item[:100] + ["y"] + item[101:300] + item[303:] + ["z"] * 20
    d, start, end = passage(item, stretch)
    assert (d, start, end) == (4, 30, 30 + 497)


def test_pieces_cover_the_item():
    for m in range(5, 60):
        for k in range(0, m // 5 + 1):
            cuts = pieces_of(list(range(m)), k)
            assert len(cuts) == k + 1 and cuts[0][0] == 0 and cuts[-1][1] == m
            assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(cuts, cuts[1:]))


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 25)))) for i in range(20)]
    items += [(50, "too short here"), (51, None), (52, items[3][1].upper())]
    docs = []
    for i in range(150):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            own = r.choice(items[:20])[1].split()
            for _ in range(r.randint(0, len(own) // 3)):
                at = r.randrange(len(own))
                r.choice([lambda: own.insert(at, "new"), lambda: own.__setitem__(at, "new"), lambda: len(own) > 1 and own.pop(at)])()
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((i, ", ".join(text)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, ("filler text " * 60_000) + items[1][1])]
    return docs, items


def brute(docs, items):
    out = set()
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, t in items:
            item = decontaminate.words_of(t)
            if len(item) >= 5 and words and len(words) < 5000:
                best = brute_match(item, words)
                if best <= int(0.2 * len(item) + 1e-9):
                    out.add((d, i, best))
    return out


@pytest.mark.parametrize("most_items", [20_000, 4])
def test_all_passages_within_the_budget_are_found(spark, documents, most_items):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_passages(documents(*docs), bench, most_items=most_items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got if r.doc_id != 903} == brute(docs, items)
    assert sum(r.doc_id == 902 and r.item_id == 0 for r in got) == 2
    assert [(r.item_id, r.distance) for r in got if r.doc_id == 903 and r.distance == 0] == [(1, 0)]
    texts = {d: decontaminate.words_of(t) for d, t in docs}
    ask = {i: decontaminate.words_of(t) for i, t in items}
    for r in got:
        found = texts[r.doc_id][r.first_word : r.first_word + r.n_words]
        assert distance(ask[r.item_id], found) == r.distance and r.item_words == len(ask[r.item_id])


def test_query_and_clean_documents(spark, folder, documents):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = QUERIES["op9_benchmark_passages"](spark, folder(*docs, benchmark=bench)).collect()
    dirty = {r.doc_id for r in got}
    clean = drop_contaminated(documents(*docs), bench)
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in dirty)
    assert 0 < len(dirty) < len(docs)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_passages(documents((1, "a b c d e f")), none).collect() == []
    assert find_passages(documents(), some).collect() == []
    assert drop_contaminated(documents((1, "a b c d e f")), none).count() == 1
    assert list(Finder([], 0.2).matches("a b")) == []


def test_hits_across_blocks_keep_their_places():
    finder = Finder([(0, "a b c d e f g h i j")], 0.2)
    assert list(finder.matches("x x a b c d e f g h i j y")) == [(0, 0, 2, 10)]
    assert list(finder.matches("x a b c d e f g X i j a b c d e f g h i j")) == [(0, 0, 11, 10)]


def test_how_short_an_item_may_be(documents, spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "one two three four five"), (3, "")], "item_id long, text string")
    docs = documents((1, "zero one two three four"), (2, "zero one two three four five six"))
    usual = {(r.doc_id, r.item_id) for r in find_passages(docs, items).collect()}
    short = {(r.doc_id, r.item_id) for r in find_passages(docs, items, least_words=1).collect()}
    assert usual == {(1, 2), (2, 2)} and short == {(1, 1), (2, 1), (1, 2), (2, 2)}
    assert drop_contaminated(docs, items.filter("item_id = 1")).count() == 2
    assert drop_contaminated(docs, items.filter("item_id = 1"), least_words=3).count() == 0
