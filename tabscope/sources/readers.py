"""Readers for CSV, Parquet, spreadsheets and span logs."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import col
from tabscope.plans.kinds import normalise
from tabscope.plans.local import local_table
from tabscope.plans.scratch import materialise
from tabscope.sources import workbooks

# Cell texts that stand for a missing value.
NA_TOKENS = [
    "?", "??", "NA", "N/A", "n/a", "na", "N\\A", "NULL", "null", "None", "none", "NaN", "nan",
    "<NA>", "<missing>", "missing", "MISSING", "Missing", "Unknown", "unknown", "UNK", "unk",
    "Refused", "refused", "No answer", "Not applicable", "Not available",
]
# Texts that pandas takes as missing by default.
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SPANS = "ts string, session_id string, phase string, duration_ms double, extra string"
_INTEGER = r"^[+-]?[0-9]+$"


def parse_na_tokens(tokens: str | list[str] | None) -> list[str]:
    """A comma list or a list of tokens; nothing given means the defaults."""
    if not tokens:
        return NA_TOKENS
    if isinstance(tokens, str):
        return [t.strip() for t in tokens.split(",")]
    return list(tokens)


def _as_missing(name: str, tokens: list[str]) -> Column:
    c = col(name)
    return F.when(~c.isin(tokens), c).alias(name)


def infer_text_types(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Type text columns: missing tokens first, then long, double, boolean or text.

    One aggregation counts what each column's values could be; the types follow from it.
    """
    all_tokens = sorted({*parse_na_tokens(tokens), *PANDAS_NA})
    data = df.select(*[_as_missing(c, all_tokens) for c in df.columns])
    checks = []
    for i, c in enumerate(df.columns):
        text = F.trim(col(c))
        quoted = "`" + c.replace("`", "``") + "`"
        whole = text.rlike(_INTEGER) & F.expr(f"try_cast(trim({quoted}) AS bigint) IS NOT NULL")
        number = F.expr(f"try_cast(trim({quoted}) AS double) IS NOT NULL") & ~text.rlike("[dDfF]$")
        checks += [
            F.count(col(c)).alias(f"n{i}"),
            F.count_if(whole).alias(f"long{i}"),
            F.count_if(number).alias(f"double{i}"),
            F.count_if(F.lower(text).isin("true", "false")).alias(f"bool{i}"),
        ]
    seen = data.agg(*checks).first() if checks else None
    out = []
    for i, c in enumerate(df.columns):
        n = seen[f"n{i}"]
        kind = "string"
        if n == 0 or seen[f"double{i}"] == n:
            kind = "long" if n and seen[f"long{i}"] == n else "double"
        elif seen[f"bool{i}"] == n:
            kind = "boolean"
        out.append((F.trim(col(c)).cast(kind) if kind != "string" else col(c)).alias(c))
    return data.select(*out)


def read_csv(
    spark: SparkSession,
    path: str,
    na_tokens: str | list[str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header; spaces after the delimiter are dropped.

    ``multiline`` allows line breaks inside quotes; a file is then read in one task.
    """
    text = spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        ignoreLeadingWhiteSpace=True,
        escape='"',
        multiLine=multiline,
    )
    return infer_text_types(text, na_tokens)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _books_through_spark(files: DataFrame, sheet: str | None) -> DataFrame:
    """Books that only Spark can open: each comes as bytes, and its sheet is read from them as a stream."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, zipfile.ZipFile]]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                yield path.as_py(), zipfile.ZipFile(BytesIO(content.as_py()))

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, book in opened(batches):
            head = workbooks.read_head(path, book, sheet)
            if head is not None:
                yield pa.RecordBatch.from_pylist([{"path": path, "names": head.names}])

    content = files.select("path", "content")
    # One row for each different header.
    heads = content.mapInArrow(heads_of, "path string, names array<string>").groupBy("names")
    known = heads.agg(F.min("path").alias("path")).orderBy("path").collect()
    columns = list(dict.fromkeys(name for r in known for name in r["names"]))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, book in opened(batches):
            head = workbooks.read_head(path, book, sheet)
            if head is not None:
                yield from workbooks.batches_of(book, head, columns, 1, None)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return content.mapInArrow(rows_of, schema) if columns else _nothing(files.sparkSession)


def _nothing(spark: SparkSession) -> DataFrame:
    return local_table(spark, [], "empty string").drop("empty")


def read_excel(
    spark: SparkSession, path: str, na_tokens: str | list[str] | None = None, sheet: str | None = None
) -> DataFrame:
    """A workbook or a folder of workbooks: the first sheet of each, or that of the name.

    Sheets of files that tasks can open themselves are split by rows. Of other file systems Spark brings
    each book to one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    paths = files.select("path")
    first = paths.first()
    if first is None:
        return _nothing(spark)
    if workbooks.local_path(first["path"]) is None:
        return infer_text_types(_books_through_spark(files, sheet), na_tokens)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [workbooks.head_of_file(p, sheet) for p in batch.column(0).to_pylist()]
            texts = [json.dumps(h) for h in heads if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["head"])

    # A row for each book: where its names are and how far it goes.
    heads = sorted((json.loads(r["head"]) for r in paths.mapInArrow(look, "head string").toLocalIterator()))
    spark.dataSource.register(workbooks.WorkbookSource)
    rows = spark.read.format("workbook").option("heads", json.dumps(heads)).load()
    return infer_text_types(rows, na_tokens) if rows.columns else _nothing(spark)


Reader = Callable[[SparkSession, str], DataFrame]
_readers: dict[str, Reader] = {
    ".csv": read_csv,
    ".parquet": read_parquet,
    ".xlsx": read_excel,
}


def register_reader(extension: str, reader: Reader) -> None:
    """Add or replace the reader for a file extension."""
    _readers[extension.lower()] = reader


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read by extension. Unknown extension: ValueError; nothing there: FileNotFoundError."""
    extension = PurePosixPath(path).suffix.lower()
    if extension not in _readers:
        raise ValueError(f"Unsupported file format: {extension}")
    try:
        return _readers[extension](spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Data file not found: {path}") from error
        raise


def load_table(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """``read_table`` with missing values normalised and copies of rows dropped.

    Profiling reads a table many times, so the result is written to the session's checkpoint
    folder and read back, unless ``keep`` is off.
    """
    rows = normalise(read_table(spark, path)).dropDuplicates()
    return materialise(rows, "table") if keep else rows


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """A span log in JSON lines; blank and malformed lines are skipped, no file means no rows."""
    try:
        return (
            spark.read.schema(SPANS).option("mode", "DROPMALFORMED").json(path).dropna(how="all")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return local_table(spark, [], SPANS)
        raise
