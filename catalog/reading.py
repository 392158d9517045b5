"""Readers, stored results and run logs. What is read was written from the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from catalog.inputs import rounded, table
from catalog.registry import query
from tabscope.operators import logs
from tabscope.operators.cleaning import drop_duplicate_rows
from tabscope.plans.counts import value_counts
from tabscope.plans.scratch import scratch_folder
from tabscope.sources import artifacts, readers


@query(
    "read_csv",
    """SELECT c_custkey, c_name, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS c_nationkey,
  c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment,
  c_acctbal > 0 AS in_credit FROM customer""",
)
def read_csv(spark, sf):
    """Missing values come as several texts, with spaces after the delimiter."""
    path = scratch_folder(spark, "customers") + ".csv"
    customer = table(spark, sf, "customer")
    token = F.element_at(F.array(*[F.lit(t) for t in ("?", "N/A", "", "none")]), F.col("c_nationkey") + 1)
    customer.select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_nationkey") > 3, F.concat(F.lit(" "), F.col("c_nationkey").cast("string")))
        .otherwise(F.when(F.col("c_nationkey") <= 3, token))
        .alias("c_nationkey"),
        "c_acctbal",
        F.when(F.col("c_mktsegment") == "BUILDING", "Unknown")
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
        .alias("c_mktsegment"),
        (F.col("c_acctbal") > 0).alias("in_credit"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.read_table(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query(
    "read_csv_own_tokens",
    """SELECT n_nationkey, CASE WHEN n_name NOT IN ('FRANCE', 'PERU') THEN n_name END AS n_name,
  n_regionkey FROM nation""",
)
def read_csv_own_tokens(spark, sf):
    path = scratch_folder(spark, "nations") + ".csv"
    table(spark, sf, "nation").write.option("header", True).csv(path)
    df = readers.read_csv(spark, path, "FRANCE, PERU")
    return df.withColumns({c: F.col(c).cast("int") for c in ("n_nationkey", "n_regionkey")})


@query(
    "read_parquet",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def read_parquet(spark, sf):
    df = readers.read_table(spark, f"{sf}/orders.parquet")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("load_table", "SELECT DISTINCT n_regionkey FROM nation")
def load_table(spark, sf):
    """Reading drops copies of rows."""
    path = scratch_folder(spark, "regions") + ".parquet"
    table(spark, sf, "nation").select("n_regionkey").write.parquet(path)
    return readers.load_table(spark, path)


_SPANS = """spans AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'agent.' || event_type ELSE event_type END
           AS phase, value AS duration_ms FROM events)"""


def _spans(spark, sf):
    """Events as a span log, with a blank and a broken line after every span."""
    path = scratch_folder(spark, "spans")
    phase = F.when(
        F.col("event_type").isin("click", "view"), F.concat(F.lit("agent."), F.col("event_type"))
    ).otherwise(F.col("event_type"))
    line = F.to_json(F.struct(phase.alias("phase"), F.col("value").alias("duration_ms")))
    lines = F.concat_ws("\n", line, F.lit(""), F.lit('{"phase": "cut off'))
    table(spark, sf, "events").select(lines).write.text(path)
    return readers.read_spans(spark, path)


@query(
    "read_spans",
    f"WITH {_SPANS} SELECT phase, count(*) AS n, round(sum(duration_ms), 4) AS duration_ms "
    "FROM spans GROUP BY phase",
)
def read_spans(spark, sf):
    spans = _spans(spark, sf)
    return spans.groupBy("phase").agg(
        F.count("*").alias("n"), F.round(F.sum("duration_ms"), 4).alias("duration_ms")
    )


@query(
    "phase_timings",
    f"""WITH {_SPANS}, parts AS (
  SELECT CASE WHEN phase LIKE 'agent.%' THEN 'agent' ELSE 'phase' END AS section,
    CASE WHEN phase LIKE 'agent.%' THEN substr(phase, 7) ELSE phase END AS phase,
    count(*) AS spans, sum(duration_ms) AS duration_ms FROM spans GROUP BY ALL)
SELECT section, phase, spans, round(duration_ms, 4) AS duration_ms FROM parts
UNION ALL SELECT 'total', 'total', CAST(sum(spans) AS BIGINT), round(sum(duration_ms), 4)
FROM parts WHERE section = 'phase'""",
)
def phase_timings(spark, sf):
    return rounded(logs.phase_timings(_spans(spark, sf)), 4, "duration_ms")


@query(
    "usage_cost",
    """WITH prices(model, prompt_price, completion_price) AS (
  VALUES ('model-0', 0.00005::DOUBLE, 0.0004::DOUBLE), ('model-1', 0.00025, 0.002),
         ('model-2', 0.00125, 0.01)),
usage AS (SELECT event_type AS agent, 'model-' || user_id % 4 AS model,
  event_id % 1000 AS prompt_tokens, event_id % 300 AS completion_tokens FROM events)
SELECT agent, model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  round(sum(prompt_tokens / 1000 * coalesce(prompt_price, 0)
            + completion_tokens / 1000 * coalesce(completion_price, 0)), 6) AS cost,
  CASE WHEN grouping(agent) = 1 THEN 3 WHEN grouping(model) = 1 THEN 1 ELSE 0 END AS "level"
FROM usage LEFT JOIN prices USING (model) GROUP BY ROLLUP (agent, model)""",
)
def usage_cost(spark, sf):
    e = table(spark, sf, "events")
    usage = e.select(
        F.col("event_type").alias("agent"),
        F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model"),
        (F.col("event_id") % 1000).alias("prompt_tokens"),
        (F.col("event_id") % 300).alias("completion_tokens"),
    )
    prices = spark.createDataFrame(
        [("model-0", 0.00005, 0.0004), ("model-1", 0.00025, 0.002), ("model-2", 0.00125, 0.01)],
        "model string, prompt_price double, completion_price double",
    )
    out = rounded(logs.usage_cost(usage, prices), 6, "cost")
    return out.withColumn("level", F.col("level").cast("int"))


@query(
    "stored_result",
    """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS "count"
FROM orders GROUP BY o_orderpriority""",
)
def stored_result(spark, sf):
    """Written below a run key that depends on the content, and read back by name."""
    base = scratch_folder(spark, "runs")
    orders = table(spark, sf, "orders")
    key = artifacts.run_key(spark, artifacts.table_digest(orders), {"target": None}, "1")
    artifacts.write_profile({"value_counts": value_counts(orders, ["o_orderpriority"])}, base, key)
    return artifacts.load_artifact(spark, base, key, "value_counts")


ROWS_PER_BOOK = 5000


def _workbook(header: list[str], rows: list[tuple]) -> bytes:
    """The least that makes a workbook: one sheet with texts in place."""
    lines = []
    for i, row in enumerate([header, *rows], start=1):
        cells = []
        for j, v in enumerate(row):
            if isinstance(v, str):
                cells.append(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            elif v is not None:
                whole = isinstance(v, float) and v.is_integer()  # pandas turns numbers with gaps into floats
                cells.append(f'<c r="{chr(65 + j)}{i}"><v>{int(v) if whole else v!r}</v></c>')
        lines.append(f'<row r="{i}">{"".join(cells)}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        sheet = f"<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>"
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def _write_books(rows, folder: str) -> None:
    """The rows in workbooks of a few thousand each, dealt by a hash and written by the tasks that hold them."""
    names = rows.columns
    books = max(1, rows.count() // ROWS_PER_BOOK)

    def write(key, own):
        files, path = FileSystem.from_uri(folder)
        cells = [tuple(None if pd.isna(v) else v for v in r) for r in own[names].itertuples(index=False)]
        with files.open_output_stream(f"{path}/{key[0]}.xlsx") as out:
            out.write(_workbook(names, cells))
        return pd.DataFrame({"rows": [len(cells)]})

    files, path = FileSystem.from_uri(folder)
    files.create_dir(path)
    dealt = rows.withColumn("book", F.pmod(F.xxhash64(*names), F.lit(books)))
    dealt.groupBy("book").applyInPandas(write, "rows long").write.format("noop").mode("overwrite").save()


@query(
    "read_excel",
    "SELECT c_custkey, c_name, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS c_nationkey, "
    "c_acctbal FROM customer",
)
def read_excel(spark, sf):
    """The customers in workbooks that tasks write and read."""
    folder = scratch_folder(spark, "workbooks")
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal"
    )
    _write_books(rows, folder)
    return readers.read_excel(spark, folder).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query(
    "content_digest",
    """SELECT count(*) AS n, true AS same_bytes_same_digest, false AS other_bytes_same_digest FROM orders""",
)
def content_digest(spark, sf):
    """Copies of a file under another path have its digest; a changed file has another."""
    one, two, three = (scratch_folder(spark, "files") for _ in range(3))
    orders = table(spark, sf, "orders")
    for folder in (one, two):
        orders.write.json(folder)
    orders.withColumn("o_custkey", F.col("o_custkey") + 1).write.json(three)
    first, second, third = (artifacts.content_digest(spark, f"{p}/*.json") for p in (one, two, three))
    return orders.agg(F.count("*").alias("n")).select(
        "n",
        F.lit(first == second).alias("same_bytes_same_digest"),
        F.lit(first == third).alias("other_bytes_same_digest"),
    )


@query(
    "run_key",
    """SELECT 64 AS key_length, true AS same_content_same_key, count(*) = 0 AS other_content_same_key,
  true AS found_after_store, false AS found_when_expired FROM orders""",
)
def run_key(spark, sf):
    """Keys follow content and parameters, not row order; old runs are not found."""
    base = scratch_folder(spark, "runs")
    orders = table(spark, sf, "orders")

    def key_of(df):
        return artifacts.run_key(spark, artifacts.table_digest(df), {"b": 1, "a": 2}, "1")

    key, again = key_of(orders), key_of(orders.repartition(7, "o_custkey"))
    other = key_of(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    artifacts.store_run(spark, base, key, {"b": 1, "a": 2}, "1")
    return spark.createDataFrame(
        [
            (
                len(key),
                key == again,
                key == other,
                artifacts.lookup_run(spark, base, key),
                artifacts.lookup_run(spark, base, key, ttl_days=0),
            )
        ],
        "key_length int, same_content_same_key boolean, other_content_same_key boolean, "
        "found_after_store boolean, found_when_expired boolean",
    )


@query(
    "load_distinct_rows",
    "SELECT DISTINCT event_type, user_id FROM events",
)
def load_distinct_rows(spark, sf):
    return drop_duplicate_rows(table(spark, sf, "events").select("event_type", "user_id"))
