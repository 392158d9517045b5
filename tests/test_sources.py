import zipfile

import pytest

from tabscope.sources import artifacts, readers


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = _write(
        tmp_path / "t.csv",
        "id, name,score,flag,code,gone\n1, ?,1.5,True,007,\n2,Unknown, 2,false,8,NA\n3,b d,N/A,,x,?\n",
    )
    df = readers.read_table(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "score": "double", "flag": "boolean", "code": "string",
        "gone": "double",
    }
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, 1.5, True, "007", None), (2, None, 2.0, False, "8", None),
        (3, "b d", None, None, "x", None),
    ]


def test_own_tokens(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "a,b\n-9,x\n4,?\n")
    df = readers.read_csv(spark, path, "-9, nil")
    assert [tuple(r) for r in df.collect()] == [(None, "x"), (4, "?")]
    assert readers.parse_na_tokens("") == readers.NA_TOKENS


def test_unknown_and_missing_files(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.pickle"))
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.csv"))


def test_own_reader(spark, tmp_path):
    path = _write(tmp_path / "t.lines", "a\nb\n")
    readers.register_reader(".LINES", lambda s, p: s.read.text(p))
    try:
        assert readers.read_table(spark, path).count() == 2
    finally:
        readers._readers.pop(".lines")


def test_load_drops_copies(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "a,b\n1,x\n1,x\n2,y\n")
    assert readers.load_table(spark, path).count() == 2
    assert readers.load_table(spark, path, keep=False).count() == 2


def _workbook(path, rows, inline=False):
    shared, body = [], []
    for i, row in enumerate(rows, start=1):
        cells = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, str) and inline:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
        if shared:
            items = "".join(f"<si><t>{s}</t></si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{items}</sst>")


def test_excel_file_and_folder(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    _workbook(folder / "one.xlsx", [["id", "name", "x"], [1, "ann", 1.5], [2, "missing", None]])
    _workbook(folder / "two.xlsx", [["x", "id", "name"], [2.5, 3, "bob"]], inline=True)
    one = readers.read_table(spark, str(folder / "one.xlsx"))
    assert dict(one.dtypes) == {"id": "bigint", "name": "string", "x": "double"}
    both = readers.read_excel(spark, str(folder))
    got = {r["id"]: (r["name"], r["x"]) for r in both.collect()}
    assert got == {1: ("ann", 1.5), 2: (None, None), 3: ("bob", 2.5)}


def test_spans(spark, tmp_path):
    path = _write(tmp_path / "s.jsonl", '{"phase": "a", "duration_ms": 1.5}\n\nnot json\n{"phase": "b"}\n')
    assert sorted(r["phase"] for r in readers.read_spans(spark, path).collect()) == ["a", "b"]
    assert readers.read_spans(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_artifacts(spark, tmp_path):
    base = str(tmp_path / "runs")
    artifacts.write_profile({"flags": spark.range(3)}, base, "k1")
    assert artifacts.load_artifact(spark, base, "k1", "flags").count() == 3
    assert artifacts.load_artifact(spark, base, "k1", "other") is None


def test_run_keys(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "x\n1\n2\n")
    b = _write(tmp_path / "b.csv", "x\n1\n2\n")
    c = _write(tmp_path / "c.csv", "x\n1\n3\n")
    digests = [artifacts.content_digest(spark, p) for p in (a, b, c)]
    assert digests[0] == digests[1] != digests[2]
    key = artifacts.run_key(spark, digests[0], {"t": "y", "m": 1}, "1")
    assert len(key) == 64 and key == artifacts.run_key(spark, digests[0], {"m": 1, "t": "y"}, "1")
    assert key != artifacts.run_key(spark, digests[0], {"t": "z", "m": 1}, "1")
    assert key != artifacts.run_key(spark, digests[0], {"t": "y", "m": 1}, "2")


def test_large_files_are_hashed_by_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "WHOLE_FILE_BYTES", 2)
    a, b = _write(tmp_path / "a.csv", "x\n1\n2\n"), _write(tmp_path / "b.csv", "x\n1\n9\n")
    assert artifacts.content_digest(spark, a) != artifacts.content_digest(spark, b)


def test_the_order_of_lines_counts_at_any_size(spark, tmp_path, monkeypatch):
    small = ["k\n", "a\n", "b\n"]
    lines = [f"{i}\n" for i in range(30_000)]
    swapped = [*lines[:7], lines[20_007], *lines[8:20_007], lines[7], *lines[20_008:]]
    folders = {
        "given": (small, lines),
        "copy": (small, lines),
        "small swapped": ([small[0], small[2], small[1]], lines),
        "header moved": (small, [*lines[1:], lines[0]]),
        "large swapped": (small, swapped),
        "rows of two files": ([small[0], lines[5], small[2]], [*lines[:5], small[1], *lines[6:]]),
        "no last end": (small, [*lines[:-1], lines[-1].strip()]),
        "other end": (small, [*lines[:9], "9\r\n", *lines[10:]]),
    }
    for name, files in folders.items():
        (tmp_path / name).mkdir()
        for i, content in enumerate(files):
            with open(tmp_path / name / f"{i if name != 'copy' else 9 - i}.csv", "w", newline="") as f:
                f.write("".join(content))
    # All files below the limit, on both sides of it, and all beyond it.
    for limit in (10**6, 1000, 1):
        monkeypatch.setattr(artifacts, "WHOLE_FILE_BYTES", limit)
        digests = {name: artifacts.content_digest(spark, str(tmp_path / name)) for name in folders}
        assert digests.pop("copy") == digests["given"]
        assert len(set(digests.values())) == len(digests)
    monkeypatch.setattr(artifacts, "WHOLE_FILE_BYTES", 1000)
    digest = artifacts.content_digest(spark, str(tmp_path / "given"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    assert artifacts.content_digest(spark, str(tmp_path / "given")) == digest
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest_and_expiry(spark, tmp_path):
    base = str(tmp_path / "runs")
    assert not artifacts.lookup_run(spark, base, "k")
    artifacts.store_run(spark, base, "k", {"a": 1}, "1")
    artifacts.store_run(spark, base, "k", {"a": 1}, "1")
    assert artifacts.lookup_run(spark, base, "k") and not artifacts.lookup_run(spark, base, "j")
    assert artifacts.manifest(spark, base).count() == 1
    assert artifacts.expired_runs(spark, base).count() == 0
    assert artifacts.expired_runs(spark, base, ttl_days=0).count() == 1
