import random
import re
from collections import defaultdict
from itertools import permutations
from math import factorial

import duckdb
import numpy as np
import pytest

from tabscope.llm import filter_audit as fa
from tabscope.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def made():
    r = random.Random(12)
    words = ["one", "two", "three", "Four", "x#y", "a&b", "É", "plain"]
    pool = [" ".join(r.choices(words[: r.choice([4, 6, 8])], k=r.choice([0, 5, 40, 250]))) for _ in range(40)]
    pool += [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 201)] + ["AB" + "c" * 98, "ABC" + "c" * 97]
    rows = [(i, r.choice(pool), None, r.choice(["s", "s", "s", "t", None, ""]), 0) for i in range(400)]
    rows += [(i, "the hot text", None, "s", 0) for i in range(400, 700)]
    rows += [(5, "twice", None, "t", 0), (5, "twice", None, "t", 0), (6, "twice", None, "u", 0), (4, None, None, "u", 0), (3, "", None, "u", 0)]
    rows += [(None, "the hot text", None, "s", 0), (None, "alone", None, "v", 0), (800, "x" * 300_000, None, "v", 0)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 700, 2)]
    labels += [(5, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def failed(rows):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first.get(text, i),
        }
        out.append((i, source or "", {k for k, v in fails.items() if v}))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = failed(rows)
    out, shapley = {}, defaultdict(int)
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[part, letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture
def given(spark, tmp_path):
    rows, labels = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_query_equals_brute_force_and_its_sql(spark, given):
    got = [tuple(r) for r in QUERIES["op12_filter_audit"](spark, given).collect()]
    assert len(got) == 600 * 5 and set(got) == brute(*made())
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{given}/{name}.parquet/*.parquet')")
    assert set(con.execute(SQL["op12_filter_audit"]).fetchall()) == set(got)
    assert any(r[6] for r in got) and any(r[7] for r in got) and any(r[8] for r in got)


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_potential_gives_the_shapley_value(k):
    """Against the mean marginal over all orders, for games that are not even monotone."""
    v = np.random.default_rng(k).integers(-50, 50, (3, 1 << k))
    v[:, 0] = 0
    p = fa.potentials(v)
    whole = (1 << k) - 1
    for i in range(k):
        total = np.zeros(3, np.int64)
        for order in permutations(range(k)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += v[:, before | 1 << i] - v[:, before]
        assert (p[:, whole] - p[:, whole ^ (1 << i)] == total).all()
    # Efficiency: the shares add up to what all filters remove.
    shares = [p[:, whole] - p[:, whole ^ (1 << i)] for i in range(k)]
    assert (sum(shares) == factorial(k) * v[:, whole]).all()


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame(
        [("p", 0b01, 3, 1, 0), ("p", 0b11, 2, 0, 2), ("p", 0, 4, 4, 0)], "part string, failed long, n long, good long, toxic long"
    )
    rows = {(r.filter_order, r.step): tuple(r)[3:] for r in fa.audit(counts, "xy").collect()}
    assert rows == {
        ("xy", 1): (4, 5, 0, 3, 1, 2, 8), ("xy", 2): (4, 0, 2, 0, 0, 0, 2),
        ("yx", 1): (7, 2, 0, 0, 0, 2, 2), ("yx", 2): (4, 3, 2, 3, 1, 0, 8),
    }
    for filters in ("", "abcdefgh"):
        with pytest.raises(ValueError):
            fa.audit(counts, filters)


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert fa.audit_documents(docs, labels).collect() == []
    odd = spark.createDataFrame(
        [(1, "a", "s", "q", 1, 2, 3, "z"), (2, "a", "s", "q", 1, 2, 3, "z")],
        "doc_id int, text string, source string, part string, failed int, good int, n int, digest string",
    )
    rows = fa.audit_documents(odd, labels).filter("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed) for r in rows] == [("s", 1, 1), ("s", 0, 1), ("s", 0, 0), ("s", 0, 0), ("s", 0, 0)]


def test_copies_are_counted_before_the_shuffle(spark, given):
    """A text that half of the rows share reaches the window as a few rows."""
    rows = fa.failed_filters(spark.read.parquet(f"{given}/documents.parquet"))
    labelled = fa.with_labels(rows, spark.read.parquet(f"{given}/labels.parquet"))
    plan = fa.profiles(labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and plan.count("partial_sum") >= 2 and "collect_list" not in plan
