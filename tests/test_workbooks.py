"""Workbooks as a data source: order of sheets, headers, row ranges, streams."""

import io
import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from tabscope.sources import readers, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet_xml(rows, numbers=True, prefix="", dimension=True):
    p = f"{prefix}:" if prefix else ""
    space = f'xmlns{":" + prefix if prefix else ""}="{MAIN}"'
    lines = []
    for i, row in enumerate(rows, start=1):
        cells = []
        for j, v in enumerate(row):
            at = f' r="{chr(65 + j)}{i}"' if numbers else ""
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<{p}c{at} t="b"><{p}v>{int(v)}</{p}v></{p}c>')
            elif isinstance(v, str):
                cells.append(f'<{p}c{at} t="inlineStr"><{p}is><{p}t>{escape(v)}</{p}t></{p}is></{p}c>')
            else:
                cells.append(f"<{p}c{at}><{p}v>{v}</{p}v></{p}c>")
        number = f' r="{i}"' if numbers else ""
        lines.append(f'<{p}row{number} spans="1:3">{"".join(cells)}</{p}row>')
    size = f'<{p}dimension ref="A1:C{len(rows)}"/>' if dimension else ""
    return f"<{p}worksheet {space}>{size}<{p}sheetData>{''.join(lines)}</{p}sheetData></{p}worksheet>"


def book(path, sheets, **kind):
    """Sheets by name; in the archive they are numbered backwards."""
    out = io.BytesIO() if path is None else path
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed, relations = [], []
        for i, (name, rows) in enumerate(sheets.items()):
            file = f"worksheets/sheet{len(sheets) - i}.xml"
            z.writestr(f"xl/{file}", sheet_xml(rows, **kind))
            listed.append(f'<sheet name="{name}" sheetId="{i + 1}" r:id="rId{i}"/>')
            relations.append(f'<Relationship Id="rId{i}" Target="{file}"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{"".join(listed)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{''.join(relations)}</Relationships>")
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_first_sheet_is_the_workbooks_first(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"Second half": [["x"], [1]], "First half": [["y"], [2]]})
    df = readers.read_table(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["x"] and rows_of(df) == [(1,)]
    other = readers.read_excel(spark, str(tmp_path / "a.xlsx"), sheet="First half")
    assert other.columns == ["y"] and rows_of(other) == [(2,)]
    assert readers.read_excel(spark, str(tmp_path / "a.xlsx"), sheet="none").columns == []


def test_a_book_of_a_header_alone_keeps_it(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"s": [["x", "y"]]})
    df = readers.read_table(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["x", "y"] and df.count() == 0


def test_columns_of_all_books_and_books_without_any(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"s": [["x", "y"], [1, "p"]]})
    book(tmp_path / "b.xlsx", {"s": [[], ["z", "x"], ["q", 2], [], [None, 3]]})
    book(tmp_path / "c.xlsx", {"s": []})
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("docProps/app.xml", "<x/>")
    df = readers.read_excel(spark, str(tmp_path))
    assert df.columns == ["x", "y", "z"]
    assert rows_of(df) == [(1, "p", None), (2, None, "q"), (3, None, None)]


def test_unnamed_and_repeated_names(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"s": [["a", None, "a", " "], [1, 2, 3, 4]]})
    df = readers.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["a", "Unnamed: 1", "a.1", "Unnamed: 3"] and rows_of(df) == [(1, 2, 3, 4)]


@pytest.mark.parametrize("kind", [{}, {"numbers": False}, {"prefix": "x"}, {"dimension": False}])
@pytest.mark.parametrize("per_part", [7, 10_000])
def test_row_ranges_give_every_row_once(spark, tmp_path, monkeypatch, kind, per_part):
    r = random.Random(5)
    rows = [["id", "text", "flag"]]
    rows += [[i, r.choice([None, "a<row b", "é & ü", "x" * 50]), r.random() < 0.5] for i in range(60)]
    if kind.get("numbers") is False:
        rows = [[v if v is not None else "-" for v in row] for row in rows]  # places come from what is there
    book(tmp_path / "a.xlsx", {"s": rows}, **kind)
    monkeypatch.setattr(workbooks, "CHUNK", 64)
    spark.dataSource.register(workbooks.WorkbookSource)
    df = spark.read.format("workbook").option("rows_per_partition", per_part).load(str(tmp_path / "a.xlsx"))
    got = sorted(df.collect(), key=lambda x: int(x.id))
    assert [tuple(x) for x in got] == [(str(i), t, str(f).lower()) for i, t, f in rows[1:]]
    if per_part == 7 and kind.get("dimension", True):
        assert df.rdd.getNumPartitions() == 9


@pytest.mark.parametrize("first", [1, 2, 5, 40, 41])
@pytest.mark.parametrize("chunk", [1, 17, 4096])
def test_a_stream_begins_at_any_row(monkeypatch, first, chunk):
    monkeypatch.setattr(workbooks, "CHUNK", chunk)
    for kind in ({}, {"numbers": False}, {"prefix": "n"}):
        data = book(None, {"s": [[f"r{i}"] for i in range(1, 41)]}, **kind)
        with zipfile.ZipFile(data) as z:
            member = workbooks.sheet_members(z)[0][1]
            got = list(workbooks.sheet_rows(z, member, [], first, 40 if first > 1 else 3))
        last = 40 if first > 1 else 3
        assert got == [(i, {0: f"r{i}"}) for i in range(first, last + 1)]


def test_shared_strings_in_runs_without_reading_aids(spark, tmp_path):
    items = "<si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>aid</t></rPh></si><si/>"
    cells = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("AB"))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        z.writestr("xl/worksheets/sheet10.xml", sheet_xml([["wrong"]]))
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>')
    assert readers.read_excel(spark, str(tmp_path / "a.xlsx")).columns == ["plain", "two runs"]


def test_books_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    book(tmp_path / "a.xlsx", {"s": [["x", "y"], [1, "p"], [2, None]]})
    book(tmp_path / "b.xlsx", {"s": [["y", "z"], ["q", True]]})
    book(tmp_path / "c.xlsx", {"s": [["x", "y"]]})
    near = readers.read_excel(spark, str(tmp_path))
    monkeypatch.setattr(workbooks, "local_path", lambda path: None)
    far = readers.read_excel(spark, str(tmp_path))
    assert near.dtypes == far.dtypes and rows_of(near) == rows_of(far) and far.count() == 3


def test_files_that_are_no_books(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text("no archive")
    with pytest.raises(Exception, match="zip"):
        readers.read_excel(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.xlsx"))
