"""Workbooks as a data source: read by sheet, written by tasks."""

from __future__ import annotations

import io
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from driftline import files
from driftline.operators.ingest import cell_events, messages, outcome
from driftline.sources import xlsx
from driftline.sources.xlsx import Workbook, write_workbook, xlsx_cells, xlsx_heads, xlsx_scan

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = ["title", "from", "to"]


def _xlsx(settings: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{settings}<sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="171" formatCode="[$-412]yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        strings = "<si><t>title</t></si><si><r><t>M</t></r><r><t>2</t></r></si><si><t>東京</t><rPh sb=\"0\" eb=\"2\"><t>トウキョウ</t></rPh><phoneticPr fontId=\"1\"/></si>"
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>from</t></is></c><c r="C1" t="str"><v>to</v></c><c r="D1" t="str"><v>where</v></c></row>'
        sheet += '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>46266</v></c><c r="C3"><v>20260901</v></c><c r="D3" t="s"><v>2</v></c><c r="AA3" t="b"><v>1</v></c></row>'
        sheet += '<row r="4"/><row r="5"><c r="A5" s="1"/><c r="B5" t="str"><v> </v></c></row>'
        sheet += '<row><c t="d"><v>2026-09-01T10:00:00</v></c><c s="2"><v>1.5</v></c><c s="3"><v>46266</v></c><c s="1"><v>0.75</v></c><c t="e"><v>#N/A</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def _book(sheets: dict) -> bytes:
    out = io.BytesIO()
    write_workbook(out, ((name, cells, ["d" if isinstance(c, int) else "s" for c in cells]) for name, rows in sheets.items() for cells in rows))
    return out.getvalue()


def test_cells(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(_xlsx())
    cells = xlsx_cells(spark, str(tmp_path / "book.xlsx"))
    rows = {r.row_no: r.cells for r in cells.collect()}
    assert rows == {
        1: ["title", "from", "to", "where"],
        3: ["M2", "2026-09-01 00:00:00", "20260901", "東京", *[None] * 22, "True"],
        6: ["2026-09-01 10:00:00", "1.5", "2026-09-01 00:00:00", "18:00:00", "#N/A"],
    }
    events, rejects = cell_events(cells.where("row_no < 5"), xlsx_heads(spark, str(tmp_path)))
    (e,) = events.collect()
    assert (e.title, str(e.start_date), str(e.end_date), e.location, e.row_no) == ("M2", "2026-09-01", "2026-09-01", "東京", 3)
    assert rejects.count() == 0


@pytest.mark.parametrize(("settings", "day"), [("", "2026-09-01"), ('<workbookPr date1904="1"/>', "2030-09-02"), ('<workbookPr date1904="false"/>', "2026-09-01")])
def test_date_systems(settings, day):
    book = Workbook(io.BytesIO(_xlsx(settings)))
    assert dict(book.rows(book.sheets[0][2]))[3][1] == f"{day} 00:00:00"


def test_early_dates():
    book = Workbook(io.BytesIO(_book({"S": [[1, 59, 61]]})))
    assert next(book.rows(book.sheets[0][2]))[1] == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00"]


def test_workbooks_of_a_folder(spark, tmp_path):
    """Two workbooks with sheets of one name, a damaged one, one without a number
    where there should be one, and one whose second sheet is damaged."""
    for name, title in (("a", "A"), ("b", "B")):
        (tmp_path / f"{name}.xlsx").write_bytes(_book({"S": [HEAD, [title, 46266, "2026-09-02"]], "T": [HEAD, [f"{title}2", 46267, "2026-09-03"]], "Notes": [["to do"]]}))
    (tmp_path / "c.xlsx").write_bytes(b"PK damaged")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    bad = io.BytesIO(_book({"S": [HEAD]}))
    with pytest.warns(UserWarning, match="Duplicate"), zipfile.ZipFile(bad, "a") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1"><v>x</v></c></row></sheetData></worksheet>')
    (tmp_path / "d.xlsx").write_bytes(bad.getvalue())
    cells, rejects = xlsx_scan(spark, str(tmp_path))
    events, others = cell_events(cells, xlsx_heads(spark, str(tmp_path)))
    assert sorted((r.title, str(r.start_date)) for r in events.collect()) == [("A", "2026-09-01"), ("A2", "2026-09-02"), ("B", "2026-09-01"), ("B2", "2026-09-02")]
    all_ = rejects.unionByName(others)
    assert sorted(r.sheet_name[-6:] for r in all_.collect()) == ["c.xlsx", "d.xlsx"]
    assert all("unreadable workbook" in r.error for r in messages(all_).collect())
    assert tuple(outcome(events, all_).first()) == (False, 4, 2) and tuple(outcome(events, others).first()) == (True, 4, 0)
    assert {r.sheet_name for r in xlsx_cells(spark, str(tmp_path), "T").collect()} == {"T"}
    with pytest.raises(FileNotFoundError):
        xlsx_scan(spark, str(tmp_path / "none*"))


def test_sheets_are_chosen_before_they_are_read(spark, tmp_path):
    """A sheet is a partition; a filter leaves the others out of the plan."""
    sheets = {f"S{i}": [HEAD, ["x", "2026-09-01", "2026-09-01"]] for i in range(6)}
    for name in "ab":
        (tmp_path / f"{name}.xlsx").write_bytes(_book(sheets))
    assert xlsx_cells(spark, str(tmp_path)).rdd.getNumPartitions() == 12
    assert xlsx_cells(spark, str(tmp_path), "S3").rdd.getNumPartitions() == 2
    for condition, n, rows in ((F.col("sheet_name") == "S4", 2, 4), (F.col("sheet_no").isin(1, 2), 4, 8), ((F.col("sheet_name") == "S1") & (F.col("row_no") > 1), 2, 2), (F.col("sheet_name") == "none", 1, 0)):
        df = xlsx_cells(spark, str(tmp_path)).where(condition)
        assert (df.rdd.getNumPartitions(), df.count()) == (n, rows)
    reader = xlsx._Reader({"paths": "[]"})
    assert list(reader.pushFilters([xlsx.EqualTo(("sheet_name",), "S1"), xlsx.EqualTo(("row_no",), 1)])) == [xlsx.EqualTo(("row_no",), 1)]
    assert reader.names == frozenset(["S1"])


def test_more_workbooks_than_are_listed(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.xlsx").write_bytes(_book({"S": [HEAD], "T": [HEAD]}))
    reader = xlsx._Reader({"paths": "[" + ",".join(f'"{tmp_path}/{i}.xlsx"' for i in range(5)) + "]", "sheet": "T"})
    monkeypatch.setattr(xlsx, "LISTED", 3)
    assert [p.numbers for p in reader.partitions()] == [None] * 5
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1] * 5


def test_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xlsx").write_bytes(_book({"S": [HEAD, ["x", 46266, "2026-09-02"]], "T": [HEAD]}))
    want = sorted(map(str, xlsx_cells(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(files, "OPENED", ())
    assert sorted(map(str, xlsx_cells(spark, str(tmp_path)).collect())) == want
    assert xlsx_cells(spark, str(tmp_path), "T").count() == 1


def test_written_by_tasks(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).cast("string").alias("sheet_name"), F.array(F.lit("a <&> b"), F.col("id").cast("string"), F.lit(None)).alias("cells"), F.array(*map(F.lit, "snn")).alias("kinds"))
    xlsx.save_workbooks(rows.repartition(2).sortWithinPartitions("sheet_name"), f"{tmp_path}/out")
    found = files.list_files(spark, f"{tmp_path}/out")
    assert len(found) == 2 and all(f.rsplit("/", 1)[1].startswith("part-") for f in found)
    got = xlsx_cells(spark, f"{tmp_path}/out")
    assert sorted(int(r.cells[1]) for r in got.collect()) == list(range(300))
    assert {(r.sheet_name, int(r.cells[1]) % 3, r.cells[0]) for r in got.collect()} == {(str(i), i, "a <&> b") for i in range(3)}
    with pytest.raises(Exception, match="not together"):
        xlsx.save_workbooks(rows.coalesce(1), f"{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("part-*"))


def test_a_long_sheet_in_bounded_memory(tmp_path):
    """A million rows, read a row at a time: by a process of its own, whose
    memory is measured."""
    import subprocess
    import sys

    path = tmp_path / "long.xlsx"
    with open(path, "wb") as f:
        write_workbook(f, (("S", [f"event {i}", 46266, "2026-09-02"], ["s", "d", "s"]) for i in range(1_000_000)))
    code = "import resource, sys; from driftline.sources.xlsx import _book_rows; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = sum(1 for _ in _book_rows('p', open(sys.argv[1], 'rb'), None, None, False)); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    n, grown = map(int, subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, check=True).stdout.split())
    assert n == 1_000_000 and grown < 60_000 and resource.RUSAGE_SELF == 0  # kB


@pytest.mark.parametrize("name", ["xlsx_ingest", "xlsx_one_sheet"])
def test_workbooks_grow_in_number_with_the_table(spark, monkeypatch, name):
    import duckdb

    from driftline import catalogue

    monkeypatch.setattr(catalogue, "WORKBOOK_ROWS", 100)
    folder, made = "/root/testdata/sf0.001", []
    make = catalogue._workbooks
    monkeypatch.setattr(catalogue, "_workbooks", lambda *x: made.append(make(*x)) or made[-1])
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS FROM '{folder}/events.parquet'")
    events = duckdb.sql("SELECT count(*) FROM events").fetchall()[0][0]
    got = sorted(map(str, (tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect())))
    assert got == sorted(map(str, duckdb.sql(catalogue.ORACLE_SQL[name]).fetchall()))
    books = [Workbook(open(f, "rb")) for f in (x.removeprefix("file:") for x in xlsx.files.list_files(spark, made[0])) if "damaged" not in f]
    assert len(books) == 4 * -(-events // 400) > 4
    assert all(sum(1 for _, _, part in b.sheets for _ in b.rows(part)) < 200 for b in books)


def test_parts_of_a_cell_that_are_no_value():
    """Formulas, phonetic readings, runs, second values and elements outside the rows."""
    M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = """<c r="B1" t="inlineStr"><f>1</f><v>no</v><is><r><rPr/><t>a &lt;</t></r><rPh sb="0" eb="1"><t>no</t></rPh><r><t>b</t></r></is></c>
      <c t="n"><f>2+2</f><v>4.0</v><v>5</v></c><c r="AA1" t="str"><v>x</v><is><t>no</t></is></c><c t="inlineStr"/><c t="n"><v/></c>"""
    sheet = f'<worksheet {M}><row r="9"><c><v>8</v></c></row><sheetData><row r="1">{cells}</row><row><c t="b"><v>1</v></c></row><row r="5"><c t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>'
    got = xlsx._Sheet(lambda kind, style, text: f"{kind}:{text}")
    got.feed(sheet.encode()), got.feed(b"")
    assert got.found == [(1, [None, "a <b", "n:4.0", *[None] * 23, "str:x", None, None]), (2, ["b:1"])]
