import hashlib
import random
import re
import zlib

import duckdb
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.llm import fill_in_middle as fim
from tabscope.llm.fill_in_middle import Marks, fill_in_middle, restored
from tabscope.llm.queries import QUERIES, SQL


def texts():
    r = random.Random(11)
    rows = [(i, "".join(r.choices(["é\n", "ab", "\n", "😀", "<", "P>", "\r", "word "], k=r.randint(0, 40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "one line"), (1003, "\n"), (1004, "a<S>b\nc"), (1005, "<P>"), (1006, "x\n<M>")]
    rows += [(7, "again\n"), (7, "again\n"), (None, "no id\nat all\n"), (-5, "minus\nfive"), (1007, "line\n" * 60_000), (1008, "x" * 400_000)]
    return rows


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    sha = hashlib.sha256(text.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, sha, sha
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), hashlib.sha256(out.encode()).hexdigest(), sha


def test_query_equals_brute_force_and_its_sql(spark, folder):
    rows = texts()
    path = folder(*rows)
    got = sorted(map(tuple, QUERIES["op11_fill_in_middle"](spark, path).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(SQL["op11_fill_in_middle"]).fetchall(), key=str) == got


def test_one_match_keeps_every_unit():
    pattern = regex.compile(f"({fim.LINES})*+")
    assert fim.unit_ends(pattern, "a\n\nbc\nd") == [2, 3, 6, 7]
    assert fim.unit_ends(pattern, "") == []
    with pytest.raises(ValueError):
        fim.unit_ends(regex.compile("(a)*+"), "ab")


def test_shares_and_other_units_and_marks(documents):
    docs = documents(*[(i, f"alpha beta gamma {i}") for i in range(400)])
    marks = Marks("[pre]", "[suf]", "[mid]")
    made = fill_in_middle(docs, unit=r"\S+\s*|\s+", share=60, spm_share=0, marks=marks)
    rows = made.select("*", restored(F.col("output"), F.col("form"), marks).alias("text")).collect()
    plain = sum(r.form == "plain" for r in rows)
    assert 0.3 < plain / 400 < 0.5 and {r.form for r in rows} == {"plain", "psm"}
    assert all(r.text == f"alpha beta gamma {r.doc_id}" and r.n == 4 for r in rows)
    assert fill_in_middle(docs, share=0).filter("form <> 'plain'").count() == 0


@pytest.mark.parametrize("marks", [Marks("<P>", "<P>", "<M>"), Marks("", "a", "b"), Marks("aba", "c", "d"), Marks("xy", "yz", "m"), Marks("<P>", "x<P>x", "m")])
def test_marks_that_cannot_be_told_apart_are_refused(documents, marks):
    with pytest.raises(ValueError):
        fill_in_middle(documents((1, "a")), marks=marks)


def test_units_with_groups_or_without_length_are_refused(documents):
    for unit in ("(a)|b", "a*"):
        with pytest.raises(ValueError):
            fill_in_middle(documents((1, "a")), unit=unit)


def test_empty_tables_and_clashing_columns(spark, documents, monkeypatch):
    assert fill_in_middle(documents()).collect() == []
    odd = spark.createDataFrame(
        [("a", "x\ny", 1, "q", 2.0), (None, None, 2, "r", 3.0)],
        "doc_id string, text string, n int, form string, number double",
    )
    monkeypatch.setattr(fim, "BYTES_PER_BATCH", 1)
    rows = {r.doc_id: r for r in fill_in_middle(odd).collect()}
    assert rows["a"].n == 2 and (rows[None].n, rows[None].form, rows[None].output) == (0, "plain", "")


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("<>PSM\na"), max_size=14), min_size=1, max_size=30))
def test_round_trip(spark, parts):
    docs = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    made = fill_in_middle(docs).select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert {r.doc_id: r.text for r in made.collect()} == dict(enumerate(parts))


def test_the_two_cuts_do_not_depend_on_the_order_of_rows(documents):
    rows = [(i, f"a\nb{zlib.crc32(str(i).encode())}\nc\n") for i in range(50)]
    one = {tuple(r) for r in fill_in_middle(documents(*rows)).collect()}
    assert one == {tuple(r) for r in fill_in_middle(documents(*rows[::-1]).repartition(3)).collect()}
