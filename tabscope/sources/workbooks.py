"""Workbooks as a Python data source: partitions are row ranges of sheets, read as streams.

A sheet is never in memory as a whole. A task unpacks its sheet as a stream, skips to its first row by the
row tags alone, and parses from there row by row until its range ends; shared strings are parsed as a stream,
too. The sheet that is read is the first in the order of the workbook (not of the file names inside it), or
one given by name. The first row that has a cell holds the column names; books may order them differently, and
the columns of all books are there, missing where a book lacks one. A book without rows gives only its names,
one without a sheet or names gives nothing. Unnamed and repeated names get numbers, as ``Unnamed: 2`` and
``name.1``. All values come as texts.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load("/folder/of/books")

Options: ``sheet`` (a name), ``rows_per_partition``, and ``heads``, what ``read_head`` tells of the books
in JSON, so that a job may look into many books at once instead of the planning of the read.
"""

from __future__ import annotations

import glob
import json
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO, NamedTuple
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ROWS_PER_PARTITION = 50_000
ROWS_PER_BATCH = 4096
CHUNK = 1 << 20
_ROW = re.compile(rb'<(?:\w+:)?row\b[^>]*>')
_NUMBER = re.compile(rb'\sr="(\d+)"')
_DATA = re.compile(rb"<(?:\w+:)?sheetData\b[^>]*>")
_DIMENSION = re.compile(rb'<(?:\w+:)?dimension\b[^>]*\sref="[A-Z]*\d*:?[A-Z]+(\d+)"')


def local_path(path: str) -> str | None:
    """The path of a file that Python can open itself, else None."""
    if "://" not in path and not path.startswith("file:"):
        return path
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else None


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheet_members(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path inside the book) of the sheets in the workbook's order."""
    inside = set(book.namelist())
    if "xl/workbook.xml" not in inside or "xl/_rels/workbook.xml.rels" not in inside:
        paths = [n for n in inside if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        paths.sort(key=lambda n: (len(n), n))  # sheet2 before sheet10
        return [(os.path.basename(n)[:-4], n) for n in paths]
    targets = {}
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        target = relation.get("Target", "")
        targets[relation.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    found = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _plain(sheet.tag) == "sheet":
            ids = [v for k, v in sheet.attrib.items() if _plain(k) == "id"]
            path = targets.get(ids[0]) if ids else None
            if path in inside:  # a chart sheet has no rows
                found.append((sheet.get("name", ""), path))
    return found


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found: list[str] = []
    with book.open("xl/sharedStrings.xml") as stream:
        root = None
        for event, item in ElementTree.iterparse(stream, ("start", "end")):
            root = item if root is None else root
            if event == "end" and _plain(item.tag) == "si":
                found.append(_text(item))
                root.clear()
    return found


def _text(item: ElementTree.Element) -> str:
    """The text of an item in one piece or in runs, without its reading aids."""
    parts = []
    for child in item:
        if _plain(child.tag) == "t":
            parts.append(child.text or "")
        elif _plain(child.tag) == "r":
            parts += [t.text or "" for t in child if _plain(t.tag) == "t"]
    return "".join(parts)


def _place(reference: str) -> int | None:
    letters = re.match(r"[A-Z]+", reference)
    if letters is None:
        return None
    place = 0
    for letter in letters.group():
        place = place * 26 + ord(letter) - 64
    return place - 1


def _cells(row: ElementTree.Element, shared: list[str]) -> dict[int, str]:
    found: dict[int, str] = {}
    place = -1
    for cell in row:
        at = _place(cell.get("r", ""))
        place = place + 1 if at is None else at
        kind = cell.get("t")
        for child in cell:
            tag = _plain(child.tag)
            if tag == "is":
                found[place] = _text(child)
            elif tag == "v" and child.text is not None:
                value = child.text
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                found[place] = value
    return found


def _from_row(stream: IO[bytes], first: int) -> Iterator[bytes]:
    """The sheet in pieces, without its rows before ``first``; rows are found by their tags alone."""
    kept = b""
    while not (start := _DATA.search(kept)):
        piece = stream.read(CHUNK)
        if not piece:
            yield kept
            return
        kept += piece
    yield kept[: start.end()]
    kept = kept[start.end() :]
    number = 0
    while first > 1:
        done = 0
        for tag in _ROW.finditer(kept):
            own = _NUMBER.search(tag.group())
            number = int(own.group(1)) if own else number + 1
            if number >= first:
                # Without a number of its own the parser would begin at 1.
                yield kept[tag.start() :] if own else kept[tag.start() :].replace(b"row", b'row r="%d"' % number, 1)
                first = 0
                break
            done = tag.end()
        if first:
            # A tag may be cut by the end of the piece.
            kept = kept[max(done, kept.rfind(b"<")) :]
            piece = stream.read(CHUNK)
            if not piece:
                return  # no such row
            kept += piece
        else:
            kept = b""
    yield kept
    while piece := stream.read(CHUNK):
        yield piece


def sheet_rows(
    book: zipfile.ZipFile, member: str, shared: list[str], first: int = 1, last: int | None = None
) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, cells by place) of the rows between two numbers that have a cell."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    data, number = None, 0
    with book.open(member) as stream:
        for piece in _from_row(stream, first):
            parser.feed(piece)
            for event, item in parser.read_events():
                tag = _plain(item.tag)
                if event == "start" and tag == "sheetData":
                    data = item
                elif event == "end" and tag == "row" and data is not None:
                    number = int(item.get("r", number + 1))
                    if last is not None and number > last:
                        return
                    cells = _cells(item, shared)
                    data.clear()
                    if cells:
                        yield number, cells


class Head(NamedTuple):
    """The sheet of a book that is read: its names, the row that holds them, and the last row if it is known."""

    path: str
    member: str
    names: list[str]
    row: int
    last: int | None


def column_names(cells: dict[int, str]) -> list[str]:
    names: list[str] = []
    for place in range(max(cells) + 1):
        base = (cells.get(place) or "").strip() or f"Unnamed: {place}"
        name, again = base, 0
        while name in names:
            again += 1
            name = f"{base}.{again}"
        names.append(name)
    return names


def read_head(path: str, book: zipfile.ZipFile, sheet: str | None) -> Head | None:
    sheets = [m for name, m in sheet_members(book) if sheet is None or name == sheet]
    if not sheets:
        return None
    found = next(sheet_rows(book, sheets[0], shared_strings(book)), None)
    if found is None:
        return None
    with book.open(sheets[0]) as stream:
        size = _DIMENSION.search(stream.read(4096))
    return Head(path, sheets[0], column_names(found[1]), found[0], int(size.group(1)) if size else None)


def head_of_file(path: str, sheet: str | None) -> Head | None:
    with zipfile.ZipFile(local_path(path)) as book:
        return read_head(path, book, sheet)


def all_names(heads: Iterable[Head]) -> list[str]:
    """The columns of all books, those of the first book first."""
    return list(dict.fromkeys(name for head in heads for name in head.names))


def batches_of(
    book: zipfile.ZipFile, head: Head, columns: list[str], first: int, last: int | None
) -> Iterator[pa.RecordBatch]:
    """The rows of a range as texts, a column for each of the names."""
    places = {name: i for i, name in enumerate(head.names)}
    at = [places.get(c) for c in columns]
    rows: list[list] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays(arrays, columns)

    for _, cells in sheet_rows(book, head.member, shared_strings(book), max(first, head.row + 1), last):
        rows.append([None if i is None else cells.get(i) for i in at])
        if len(rows) == ROWS_PER_BATCH:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


class RowRange(InputPartition):
    def __init__(self, head: Head | None, first: int = 1, last: int | None = None):
        self.head, self.first, self.last = head, first, last


class WorkbookSource(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _heads(self) -> list[Head]:
        given = self.options.get("heads")
        if given is not None:
            return [Head(*h) for h in json.loads(given)]
        path = local_path(self.options.get("path", ""))
        paths = sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not paths:
            raise FileNotFoundError(f"no workbook at {path}")
        return [head for p in paths if (head := head_of_file(p, self.options.get("sheet"))) is not None]

    def schema(self) -> StructType:
        return StructType([StructField(name, StringType()) for name in all_names(self._heads())])

    def reader(self, schema: StructType) -> DataSourceReader:
        rows = int(self.options.get("rows_per_partition", ROWS_PER_PARTITION))
        return WorkbookReader(self._heads(), schema.fieldNames(), rows)


class WorkbookReader(DataSourceReader):
    def __init__(self, heads: list[Head], columns: list[str], rows: int):
        self.heads, self.columns, self.rows = heads, columns, rows

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for head in self.heads:
            first = head.row + 1
            while head.last is not None and first + self.rows <= head.last:
                found.append(RowRange(head, first, first + self.rows - 1))
                first += self.rows
            # The last range has no end: the size that a sheet states may be too small.
            found.append(RowRange(head, first))
        return found or [RowRange(None)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.head is not None:
            with zipfile.ZipFile(local_path(partition.head.path)) as book:
                yield from batches_of(book, partition.head, self.columns, partition.first, partition.last)
