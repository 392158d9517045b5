import hashlib
import uuid

import duckdb
import pytest

from tabscope.llm.exact_dedup import DigestIndex, keep_one_of_each, text_digests
from tabscope.llm.queries import QUERIES, SQL

ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "other"), (4, None), (5, ""), (6, "É"), (7, "é"),
    (3, "other"), (8, "x" * 300_000), (9, "X" * 300_000), (None, "lonely"), (None, "same text"),
]


@pytest.fixture
def index(spark, tmp_path):
    name = "idx_" + uuid.uuid4().hex
    yield DigestIndex(spark, name, f"{tmp_path}/index", 3)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_query_equals_its_sql(spark, folder):
    path = folder(*dict.fromkeys(r for r in ROWS if r[0] is not None))
    got = QUERIES["op10_digest_index"](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    want = con.execute(SQL["op10_digest_index"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_ties_missing_and_repeated_rows(documents, index):
    digests = text_digests(documents(*ROWS), keep=["doc_id"])
    index.add(digests, "b")
    rows = index.verdicts(digests, "b").collect()
    assert len(rows) == len(ROWS)
    kept = sorted((r.doc_id for r in rows if r.kept), key=str)
    assert kept == sorted([2, 3, 5, 6, 7, 9, None], key=str)
    by_digest = {r.text_sha256: r.group_size for r in rows}
    assert by_digest[hashlib.sha256(b"same text").hexdigest()] == 3
    assert by_digest[hashlib.sha256(b"").hexdigest()] == 2


def test_later_batches_only_bring_new_texts(documents, index):
    one, two = documents((1, "a"), (2, "b")), documents((3, "A"), (4, "c"), (5, "c"))
    assert {r.doc_id for r in keep_one_of_each(one, index, "one").collect()} == {1, 2}
    assert {r.doc_id for r in keep_one_of_each(two, index, "two").collect()} == {5}
    assert {r.doc_id for r in keep_one_of_each(two, index, "two").collect()} == {5}
    assert index.rows().count() == 3


def test_extra_columns_and_empty_tables(spark, documents, index):
    odd = spark.createDataFrame(
        [(1, "a", "p", 1), (1, "a", "p", 1)], "doc_id bigint, text string, keep_id string, kept int"
    )
    assert [tuple(r) for r in keep_one_of_each(odd, index, "odd").collect()] == [(1, "a", "p", 1)]
    assert keep_one_of_each(documents(), index, "none").collect() == []


@pytest.mark.parametrize("name", ["text_sha256", "__digest", "__whole", "digest", "id", "c0", "stay_id", "keep_id", "group_size", "batch", "copies", "number"])
def test_any_other_column_comes_back_as_it_was(spark, index, name):
    rows = [(1, "A b", f"own {name} 1"), (2, "a B", f"own {name} 2"), (3, None, None)]
    for order in (f"doc_id bigint, text string, `{name}` string", f"`{name}` string, text string, doc_id bigint"):
        at = order.replace("`", "").replace(" bigint", "").replace(" string", "").split(", ")
        given = [tuple({"doc_id": i, "text": t, name: x}[c] for c in at) for i, t, x in rows]
        kept = keep_one_of_each(spark.createDataFrame(given, order), index, "batch")
        assert kept.columns == at
        assert sorted(map(tuple, kept.select("doc_id", "text", f"`{name}`").collect())) == rows[1:]


def test_index_side_of_the_anti_join_is_not_shuffled(documents, index):
    digests = text_digests(documents((1, "a")), keep=["doc_id"])
    index.add(digests, "b")
    groups = digests.groupBy("text_sha256").count()
    plan = groups.join(index.rows().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1
