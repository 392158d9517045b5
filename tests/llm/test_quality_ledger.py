import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm import quality_ledger as ql
from tabscope.llm.quality_ledger import Policy, Rule, ablations, keeps, measured, repeated_words, with_bits
from tabscope.llm.queries import QUERIES, SQL


def texts():
    r = random.Random(13)
    words = ["ab", "cd", "é", "#", "x*y", "<b>", "UP", "12", "😀", "\x1c", "a b"]
    rows = []
    for i in range(150):
        lines = [" ".join(r.choices(words[: r.choice([2, 5, 11])], k=r.randint(0, 20))) for _ in range(r.randint(0, 6))]
        lines += r.choices(lines, k=r.randint(0, 3)) if lines else []
        rows.append((i, r.choice(["\n", "\r\n", "\n\n", "\n \t\n"]).join(lines)))
    rows += [(900, None), (901, ""), (902, " \x0b\x0c\r\t\n"), (903, "w " * 60_000), (904, "x" * 300_000), (905, "a b c d e f g h")]
    rows += [(906, "a b c d e f g h a b c d e f g h"), (907, "a a a a a a a a a"), (907, "a a a a a a a a a"), (None, "no id " * 30)]
    return rows


def repeats(words, window=8):
    said = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    times = Counter(said)
    return len({i + j for i, s in enumerate(said) if times[s] > 1 for j in range(window)})


def brute(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, again = len(words), repeats(words)
    return (
        doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again,
        n < 20 or 100 * again > 30 * n,
    )


def test_query_equals_brute_force_and_its_sql(spark, folder):
    rows = texts()
    path = folder(*rows)
    got = sorted(map(tuple, QUERIES["op13_quality_ledger"](spark, path).collect()), key=str)
    assert [r[:7] for r in got] == sorted((brute(*r) for r in rows), key=str)
    assert all(not (r[6] and r[7]) for r in got) and {r[7] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    asked = con.execute(SQL["op13_quality_ledger"])
    assert sorted(asked.fetchall(), key=str) == got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 12))
def test_repeated_windows_equal_brute_force(words, window):
    assert repeated_words(words, window) == repeats(words, window)


def test_long_runs_are_exact():
    words = [str(i).encode() for i in range(50_000)] + [b"x"] + [str(i).encode() for i in range(100, 120)]
    assert repeated_words(words) == 40


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op13_quality_ledger"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert docs.count() == 1000
    clean = [r for r in got if r.quality == 1 and not r.base_failed]
    junk = [r for r in got if r.quality == 0]
    assert clean and all(r.kept for r in clean)
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)


RULES = (Rule("short", "n_words < 3"), Rule("signs", "n_symbols > 0"), Rule("capitals", "n_capitals > 2"))


def test_policies_and_ablations_from_the_bits(documents):
    rows = [(1, "a b c"), (2, "a"), (3, "#"), (4, "# b c d"), (5, "ABC d e"), (6, "# ABC e"), (7, None)]
    ledger = with_bits(measured(documents(*rows)), RULES, "v1").cache()
    assert {r.doc_id: r.failed for r in ledger.collect()} == {1: 0, 2: 1, 3: 3, 4: 2, 5: 4, 6: 6, 7: 1}
    strict, mild = Policy("strict", ["short", "signs", "capitals"]), Policy("mild", ["short"], tolerated=1)
    assert [r.doc_id for r in ledger.filter(keeps(strict, RULES)).orderBy("doc_id").collect()] == [1]
    assert [r.doc_id for r in ledger.filter(keeps(mild, RULES)).orderBy("doc_id").collect()] == [1, 4, 5]
    got = {(r.policy, r.rule): tuple(r)[3:] for r in ablations(ledger, [strict, mild], RULES).collect()}
    assert got == {
        ("strict", "short"): (7, 3, 2, 1, 3), ("strict", "signs"): (7, 3, 1, 1, 2), ("strict", "capitals"): (7, 2, 1, 1, 2),
        ("mild", "short"): (7, 3, 2, 3, 6), ("mild", "signs"): (7, 3, 1, 3, 4), ("mild", "capitals"): (7, 2, 1, 3, 4),
    }


def test_empty_tables_clashing_columns_and_bad_rules(spark, documents):
    assert with_bits(measured(documents())).collect() == []
    assert ablations(with_bits(measured(documents())), [ql.POLICY]).collect() == []
    odd = spark.createDataFrame(
        [("k", "a b", 9, 9, "z")], "doc_id string, text string, n_words int, failed int, rules_version string"
    )
    row = with_bits(measured(odd)).first()
    assert (row.doc_id, row.n_words, row.failed & 1, row.rules_version) == ("k", 2, 1, ql.RULES_VERSION)
    with pytest.raises(ValueError):
        with_bits(measured(odd), [RULES[0], RULES[0]])
    with pytest.raises(KeyError):
        keeps(Policy("x", ["unknown"]), RULES)
