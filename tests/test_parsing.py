from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.functions import headers, parsing
from driftline.operators import ingest

SEP1 = dt.date(2026, 9, 1)
DATES = {
    **dict.fromkeys(["2026-09-01", "2026/9/1", "09/01/2026", "2026.09.01", "09.01.2026", "20260901", "9/1/26"], SEP1),
    "03/04/2026": dt.date(2026, 3, 4),
    "13/04/2026": dt.date(2026, 4, 13),
    "13-04-2026": dt.date(2026, 4, 13),
    "25.12.2026": dt.date(2026, 12, 25),
    "2026-09-01 00:00:00": SEP1,
    "2026-09-01T23:30:00+09:00": SEP1,
    "3000-01-01": dt.date(3000, 1, 1),
    "20260901.0": SEP1,
    " 2026-09-01　": SEP1,
    **dict.fromkeys(["2026-09-01 09:00", "2026-09-01 09:00:00.000", "2026/09/01 09:00:00", "9/1/2026 10:00", "01-Sep-2026", "1 Sep 2026", "September 1, 2026"], SEP1),
    **dict.fromkeys(["Sep 1 2026", "sept. 1, 2026", "1st September 2026", "Sep 1st, 2026", "Tuesday, September 1, 2026", "Tue 1 Sep 2026 9:30 PM", "1/Sep/26", "2026 Sep 1"], SEP1),
    **dict.fromkeys(["2026-9-1T9:05Z", "2026-09-01T00:00:00.123456+0900", "2026.09.01 23:59:59 UTC", "20260901T101500", "2026-09-01, 09:00", "9-1-26"], SEP1),
    **dict.fromkeys(["2026-09", "2026/9", "Sep 2026", "September, 2026", "9/1/2026 12:30 AM"], SEP1),
    "31 Dec 1999": dt.date(1999, 12, 31),
    "12/31/99": dt.date(1999, 12, 31),
    **dict.fromkeys(["2026-02-30", "45000", "2026년 9월 1일", "today", "10:30", "2026", "", None, "02026-09-01", "1 Foo 2026", "2026-09-01 24:00", "2026-09-01 10:60"]),
    **dict.fromkeys(["2026-09-01 13:00 PM", "2026-09-01 0:30 AM", "2026-09-01x", "1 Sep", "Sep 1", "2026--09-01", "31 Feb 2026", "0000-01-01", "2026-09-01T"]),
}
TIMES = {
    "09:00:00": "09:00:00",
    "09:00": "09:00:00",
    "9:5": "09:05:00",
    **dict.fromkeys(["9:30 PM", "9:30pm", "09:30 pm", "9:30  PM"], "21:30:00"),
    **dict.fromkeys(["24:00", "13:00 PM", "0:30 AM", "9 PM", "오전 9:00", "2026-09-01 09:00:00", "", None]),
}
PEOPLE = {
    "a@x.com, b@y ;\nnope; c@z": ["a@x.com", "b@y", "c@z"],
    "nope": None,
    "": None,
    None: None,
    "a@x;a@x": ["a@x", "a@x"],
}


@pytest.mark.parametrize(("function", "cases"), [(parsing.date, DATES), (parsing.time, TIMES), (parsing.people, PEOPLE)])
def test_cells(spark, function, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: r.out for r in df.select("i", function(F.col("c")).alias("out")).collect()}
    assert {c: got[i] for i, c in enumerate(cases)} == cases


def test_ids(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("a+b",), ("a.b@x",)], "c string")
    rows = df.select(parsing.valid_user_id(F.col("c")), parsing.valid_email(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(False, False), (False, False), (False, False), (False, True), (True, True)]


def test_literals(spark):
    df = spark.createDataFrame([("a\0b\\c'd\r\ne", ["x", "y"]), ("", None)], "c string, a array<string>")
    rows = df.select(parsing.sql_escape(F.col("c")), parsing.array_literal(F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [("ab\\\\c''d  e", '{"x","y"}'), ("", "{}")]


HEADS = [
    ["제목", "시작일", "종료일"],
    [" Start-Date ", "END DATE", "Title"],
    ["title", "date"],
    ["subject", "title", "from", "to"],
    ["title", "from", "to", "colour"],
    ["title", "name", "date", "to"],
    ["title", "from", "to", "memo", "details", "Memo"],
    ["Start\nDate", " START - date\u3000", "end\u00a0 time", None, "3"],
    [],
]


def test_headers():
    found = [headers.map_headers(h) for h in HEADS]
    assert found[0] == ({"title": 0, "start_date": 1, "end_date": 2}, [], [])
    assert found[1] == ({"start_date": 0, "end_date": 1, "title": 2}, [], [])
    assert found[2][1] == ["missing required columns: end_date"]
    assert found[3] == ({"title": 0, "start_date": 2, "end_date": 3}, [], ["further column for title: title"])
    assert found[4][1:] == ([], [])
    assert found[5] == ({"title": 0, "start_date": 2, "end_date": 3}, [], ["further column for title: name"])
    assert found[6][2] == ["further column for description: details", "further column for description: Memo"]
    assert [headers.normalise(h) for h in ("Start\nDate", " START - date\u3000", "end\u00a0 time", None, 3)] == ["start_date", "start_date", "end_time", "none", "3"]


def test_headers_as_data(spark):
    """The expressions say what the driver's mapping says."""
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HEADS)], "i int, h array<string>")
    at = headers.positions(F.col("h"))
    rows = df.select("i", at.alias("at")).select("i", "at", headers.missing(F.col("at")).alias("missing"))
    rows = rows.join(df, "i").select("i", "at", "missing", headers.further(F.col("h"), F.col("at")).alias("further"))
    for r in rows.collect():
        found, reasons, further = headers.map_headers([h for h in HEADS[r.i] if h is not None] if r.i != 7 else HEADS[7])
        assert {k: v for k, v in r["at"].asDict().items() if v is not None} == found
        assert ([r.missing] if r.missing else []) == reasons
        assert r.further == further


def _grid(spark):
    rows = [(1, " A ", "2026-09-01", "9/2/2026", "a@x", "red"), (2, "", "2026-09-01", "2026-09-01", None, None), (3, "B", "soon", "2026-09-01", None, None), (4, "C", "2026-09-01", None, None, None)]
    return spark.createDataFrame(rows, "_row_no int, title string, `from` string, to string, guests string, colour string")


def test_ingest(spark):
    events, rejects = ingest.sheet_events(_grid(spark), "s", 1)
    (row,) = events.collect()
    assert (row.title, row.start_date, row.end_date, row.attendees, tuple(row.ordinal)) == ("A", SEP1, dt.date(2026, 9, 2), ["a@x"], (None, 1, 1))
    assert {(r.row_no, r.reason) for r in rejects.collect()} == {(2, "title is required"), (3, "bad start_date"), (4, "bad end_date")}
    assert ingest.sheet_events(_grid(spark), "s", strict_sheet=True)[0].count() == 0
    with pytest.raises(ValueError, match="Row 2"):
        ingest.accepted(events, rejects)
    sheets = [("good", _grid(spark).where("_row_no = 1")), ("bad", spark.createDataFrame([("x",)], "title string"))]
    events, rejects = ingest.workbook_events([sheets[0]])
    assert ingest.accepted(events, rejects).count() == 1
    assert [r.row_no for r in ingest.sheet_events(sheets[1][1], "bad", row_no=F.lit(1))[1].collect()] == [None]


def test_two_columns_and_empty_sheets(spark):
    grid = spark.createDataFrame([(3_000_000_000, "A", "B", "2026-09-01", "9/2/2026", "m", "d")], "_row_no long, title string, name string, date string, to string, memo string, details string")
    rows, warnings = ingest.sheet_rows(grid, "s")
    (r,) = rows.collect()
    assert (r.title, r.description, r.row_no, r.ordinal.row, r.reason) == ("A", "m", 3_000_000_000, 3_000_000_000, None)
    assert {w.warning for w in warnings.collect()} == {"further column for title: name", "further column for description: details"}
    notes = spark.createDataFrame([(1, "x")], "_row_no int, `to do` string")
    assert ingest.sheet_events(notes.limit(0), "Notes")[1].count() == 0
    assert [r.reason for r in ingest.sheet_events(notes, "Notes")[1].collect()] == ["missing required columns: title, start_date, end_date"]


def _cells(spark, n, rows=2):
    """n sheets of one workbook, with columns in an order of their own."""
    names, values = ["Title", "From", "To", "Where", "x"], ["T", "2026-09-01", "9/2/2026", "R", "-"]
    out = []
    for i in range(n):
        turn = i % 5
        at = lambda x: x[turn:] + x[:turn]  # noqa: B023, E731
        out += [("b", i, f"s{i}", 1, at(names))] + [("b", i, f"s{i}", 2 + r, at(values)) for r in range(rows)]
    return spark.createDataFrame(out, "path string, sheet_no int, sheet_name string, row_no long, cells array<string>")


def test_a_thousand_sheets_in_one_plan(spark):
    def plan(df):
        return df._jdf.queryExecution().analyzed().toString().count("\n")

    many, few = ingest.cell_rows(_cells(spark, 1000))[0], ingest.cell_rows(_cells(spark, 3))[0]
    assert plan(many) == plan(few)
    assert {(r.title, str(r.start_date), str(r.end_date), r.location, r.reason) for r in many.collect()} == {("T", "2026-09-01", "2026-09-02", "R", None)}
    assert many.count() == 2000


def test_cells_of_odd_sheets(spark):
    cells = [("b", 0, "empty", 1, ["title", "from", "to"]), ("b", 1, "notes", 1, ["memo"]), ("b", 1, "notes", 5, ["x"]), ("b", 2, "short", 4, ["a", "title", "from", "to"]), ("b", 2, "short", 7, ["a"]), ("c", 0, "none", 1, None)]
    df = spark.createDataFrame(cells, "path string, sheet_no int, sheet_name string, row_no long, cells array<string>")
    events, rejects = ingest.cell_events(df)
    assert events.count() == 0
    assert {tuple(r) for r in rejects.collect()} == {("notes", None, "missing required columns: title, start_date, end_date"), ("short", 7, "title is required")}
    assert ingest.cell_events(df.limit(0))[1].count() == 0
    strict = ingest.cell_events(_cells(spark, 2).withColumn("path", F.lit("z")).unionByName(df), strict_sheet=True)[0]
    assert {r.sheet_name for r in strict.collect()} == {"s0", "s1"}


def test_staged_once(spark, tmp_path):
    """The grid is read once, and shows under its name all or not at all."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    grid = _grid(spark)
    counted_grid = grid.mapInArrow(counted, grid.schema)
    staged = ingest.stage(ingest.sheet_rows(counted_grid, "s")[0], str(tmp_path))
    assert (staged.accepted, staged.events, staged.rejects, seen.value) == (False, 1, 3, 4)
    with pytest.raises(ValueError, match="Sheet 's' Row 2: title is required; .*Row 4: bad end_date"):
        ingest.publish(staged, f"{tmp_path}/events")
    more = spark.createDataFrame([("book.xlsx", None, "unreadable workbook")], "sheet_name string, row_no long, reason string")
    assert ingest.stage(ingest.sheet_rows(grid, "s")[0], more_rejects=more).rejects == 4
    good = ingest.stage(ingest.sheet_rows(grid.where("_row_no = 1"), "s")[0], str(tmp_path))
    assert [r.title for r in ingest.publish(good, f"{tmp_path}/events").collect()] == ["A"]
    with pytest.raises(FileExistsError):
        ingest.publish(ingest.stage(ingest.sheet_rows(grid.where("_row_no = 1"), "s")[0], str(tmp_path)), f"{tmp_path}/events")
    with pytest.raises(ValueError, match="no events"):
        ingest.publish(ingest.stage(ingest.sheet_rows(grid.where("_row_no < 0"), "s")[0]), f"{tmp_path}/none")


def test_plain_dates_need_no_tokens(spark):
    """The short way gives what the table of shapes gives, and is taken."""
    from itertools import product

    from driftline.functions import dates

    days = [f"{y}{s}{m}{s}{d}" for y, m, d, s in product(("2026", "0000", "0001", "2024", "26"), ("02", "2", "13", "00", "12"), ("29", "30", "1", "00", "07"), "-/")]
    days += [f"{a}/{b}/{y}" for a, b, y in product(("02", "2", "13", "31", "0"), ("29", "30", "1", "12"), ("2026", "2024", "0000", "26"))]
    texts = [d + t for d in days for t in ("", " 00:00:00", " 23:59:59", " 24:00:00", " 12:60:00", "T10:00", " 1:02:03", "\n", " x")] + ["", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.recognise(F.col("t")).alias("a"), dates.by_shape(F.col("t")).alias("b"))
    got = df.collect()
    assert [r for r in got if r.a != r.b and not (r.t or "").endswith("\n")] == [] and sum(r.a is not None for r in got) > 100
