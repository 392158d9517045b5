import time

import pytest
from pyspark.sql import functions as F

from tabscope.operators import cleaning
from tabscope.operators.cleaning import row_digest
from tabscope.plans.kinds import column_kinds, infer_kinds, normalise
from tests.conftest import by


def test_duplicates_count_null_as_equal(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, "z")], "a int, b string")
    assert cleaning.drop_duplicate_rows(df).count() == 3
    row = cleaning.duplicate_summary(df).first()
    assert (row["n_rows"], row["duplicate_count"], row["duplicate_share"]) == (5, 2, 0.4)


def test_reclassify(spark):
    df = spark.createDataFrame([(1.0, 1.5, "k"), (2.0, None, "k"), (None, 2.5, "k")],
                               "whole double, part double, s string")
    out = cleaning.reclassify_columns(df, ["whole", "part", "s", "nowhere"])
    assert [r["whole"] for r in out.collect()] == ["1", "2", None]
    assert [r["part"] for r in out.collect()] == ["1.5", None, "2.5"]
    assert infer_kinds(out).numeric == []


def test_kinds(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1.5D AS d, true AS b, 's' AS s, now() AS t, array(1) AS a, 2.5BD AS m"
    )
    kinds = infer_kinds(df, encoded=["i", "s"])
    assert kinds.numeric == ["d", "m"] and kinds.datetime == ["t"] and kinds.encoded == ["i"]
    assert kinds.categorical == ["b", "s", "a", "i"]
    row = normalise(df).first()
    assert row["b"] == "true" and row["a"] == "[1]" and row["m"] == 2.5
    assert by(column_kinds(df))["t"]["kind"] == "datetime"


def test_coerce_numeric(frame):
    out = cleaning.coerce_numeric(frame(x=["1", "2.5", "bad", None]), ["x"])
    assert [r["x"] for r in out.collect()] == [1.0, 2.5, None, None]


def _gappy(spark, complete, rows=10):
    data = [("a" if i % 2 else "b", float(i), "yes" if i < 5 else "no") for i in range(complete)]
    data += [(None, None, "yes")] * (rows - complete)
    return spark.createDataFrame(data, "c string, x double, y string")


def test_strategy_at_the_limit(spark):
    rows, text = cleaning.apply_missingness_strategy(_gappy(spark, 8), "y")
    assert rows.count() == 8 and text == "complete-case: N=8, 80.0% retained"


def test_strategy_imputes_below_the_limit(spark):
    rows, text = cleaning.apply_missingness_strategy(_gappy(spark, 7), "y")
    assert text.startswith("imputed") and rows.count() == 10
    filled = rows.filter("c = '__MISSING__'").collect()
    assert len(filled) == 3 and filled[0]["x"] == pytest.approx(3.0)


def test_strategy_drops_rows_without_target(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (1.0, "b")], "x double, y string")
    rows, _ = cleaning.apply_missingness_strategy(df, "y")
    assert sorted(r["y"] for r in rows.collect()) == ["a", "b"]


def test_fill_categorical_also_fills_text_target(spark):
    df = spark.createDataFrame([("a", None), (None, "t"), ("b", "t")], "c string, t string")
    out = cleaning.fill_categorical_missing(df, "t")
    assert out.filter("t = '__MISSING__' OR c = '__MISSING__'").count() == 2


def test_label_encode_orders_values(frame):
    df = frame(k=[1, 2, 3, 4], s=["pre_b", "pre_a", None, "pre_b"], t=["é", "z", "a", "é"])
    out = {r["k"]: (r["s"], r["t"]) for r in cleaning.label_encode(df, ["s", "t"]).collect()}
    assert out == {1: (1, 2), 2: (0, 1), 3: (None, 0), 4: (1, 2)}


def test_median_fill(frame):
    out = cleaning.median_fill(frame("x double", x=[1.0, None, 3.0, 9.0]))
    assert sorted(r["x"] for r in out.collect()) == [1.0, 3.0, 3.0, 9.0]


def test_sample_keeps_shares_and_ignores_partitioning(spark):
    df = spark.range(2000).selectExpr("id", "IF(id % 10 = 0, 'rare', 'usual') AS y")
    first = cleaning.stratified_sample(df, "y", 200, ["id"])
    second = cleaning.stratified_sample(df.repartition(9), "y", 200, ["id"])
    assert sorted(first.collect()) == sorted(second.collect())
    assert {r["y"]: r["count"] for r in first.groupBy("y").count().collect()} == {
        "rare": 20, "usual": 180,
    }


def test_sample_falls_back_to_uniform(spark):
    df = spark.range(500).selectExpr("id", "IF(id = 7, 'once', 'usual') AS y")
    assert cleaning.stratified_sample(df, "y", 100, ["id"]).count() == 100
    assert cleaning.stratified_sample(df, "y", 500, ["id"]).count() == 500


def test_sample_with_null_class(spark):
    df = spark.range(400).selectExpr("id", "IF(id % 2 = 0, NULL, 'a') AS y")
    counts = cleaning.stratified_sample(df, "y", 100, ["id"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in counts} == {None: 50, "a": 50}


def test_dataset_profile(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, None)], "i int, s string")
    row = cleaning.dataset_profile(df).first()
    assert (row["n_rows"], row["n_columns"], row["duplicate_count"]) == (3, 2, 1)
    assert row["dtypes"] == {"i": "int", "s": "string"}


def test_codes_of_values_that_begin_alike_but_one(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "CODES_PER_PART", 50)
    df = spark.range(400).selectExpr("CONCAT('u', LPAD(id, 5, '0')) AS s").unionAll(spark.sql("SELECT 'a' AS s"))
    rows = cleaning.label_codes(df, ["s"]).orderBy("value").collect()
    assert [r["code"] for r in rows] == list(range(401)) and rows[0]["value"] == "a"


def test_digests_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("a\\", "|b"), ("a\\|", "b"), ("", "x")]
    df = spark.createDataFrame(rows, "s string, t string")
    found = df.select(row_digest([F.col("s"), F.col("t")]).alias("d")).distinct().count()
    assert found == len(rows)
    plain = spark.sql("SELECT 42 AS seed, 7 AS k").select(row_digest([F.col("seed"), F.col("k")]).alias("d")).first()["d"]
    assert plain == __import__("hashlib").md5(b"42|7").hexdigest()


def _with_copies(spark, wide=False):
    more = [f"concat('column {i} of ', id % 500, ' ', repeat('x', 30)) AS w{i}" for i in range(24)] if wide else []
    return spark.range(1000).selectExpr(
        "IF(id % 4 = 0, NULL, id % 500) AS a", "IF(id % 4 = 1, NULL, id % 500) AS b", "double(id % 500) AS d",
        "named_struct('x', id % 500) AS s", *more,
    )


@pytest.mark.parametrize("hashes", ["real", "few", "one"])
@pytest.mark.parametrize("held", [10**6, 3])
def test_duplicates_are_exact_whatever_the_hashes(spark, monkeypatch, hashes, held):
    """Hashes that meet by force: a handful of values, or one for all rows."""
    monkeypatch.setattr(cleaning, "HELD_HASHES", held)
    real = cleaning._row_hashes
    if hashes != "real":
        part = (lambda data: F.lit(0)) if hashes == "one" else (lambda data: F.pmod(F.xxhash64(*data.columns), F.lit(7)))
        monkeypatch.setattr(cleaning, "_row_hashes", lambda data: [part(data).alias("h1"), F.lit(1).alias("h2")])
    df = _with_copies(spark)
    row = cleaning.duplicate_summary(df).first()
    assert (row["n_rows"], row["distinct_rows"], row["duplicate_count"]) == (1000, 500, 500)
    both = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 1), (None, None), (0, None)], "a int, b int")
    assert cleaning.duplicate_summary(both).first()["distinct_rows"] == 5
    monkeypatch.setattr(cleaning, "_row_hashes", real)
    met = both.select(*real(both)).groupBy("h1", "h2").count().filter("count > 1").count()
    assert met == 1


def test_duplicates_of_odd_tables(spark):
    one = spark.range(1).selectExpr("id AS h1", "id AS h2", "id AS n", "id AS c0")
    assert tuple(cleaning.duplicate_summary(one.unionAll(one)).first()) == (2, 1, 1, 0.5)
    assert tuple(cleaning.duplicate_summary(one.limit(0)).first()) == (0, 0, 0, 0.0)
    zeros = spark.sql("SELECT 0.0D AS x UNION ALL SELECT -0.0D UNION ALL SELECT double('NaN') UNION ALL SELECT NULL")
    assert cleaning.duplicate_summary(zeros).first()["distinct_rows"] == 2


def _shuffled(spark, action) -> int:
    """Bytes that an action wrote to the shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        time.sleep(0.5)  # the store follows the listeners
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    action()
    return total() - before


def test_a_wide_table_shuffles_its_hashes_only(spark):
    df = _with_copies(spark, wide=True).withColumn("id", F.monotonically_increasing_id())
    new = _shuffled(spark, lambda: cleaning.duplicate_summary(df).collect())
    old = _shuffled(spark, lambda: cleaning.row_counts(df).count())
    assert 0 < new < old / 4 and cleaning.duplicate_summary(df).first()["duplicate_count"] == 0
