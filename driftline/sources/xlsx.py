"""Excel workbooks as a data source, read and written by the standard library.

``spark.read.format("driftline_xlsx")`` gives a row of cells for every row of
every sheet. A sheet of a workbook is an input partition, so one large workbook
is read by many tasks; its XML is read as a stream, a row at a time. Sheets are
chosen before anything of them is read, by the option ``sheet`` or by a filter
on ``sheet_name`` or ``sheet_no`` where Spark pushes filters to Python sources.

Rows without any value are left out. Dates follow the workbook's date system,
1900 or 1904. Of rich text the text counts, not its phonetic reading. A workbook
or sheet that can't be read gives one row with an error.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from array import array
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from driftline import files

FORMAT = "driftline_xlsx"
SCHEMA = "path string, sheet_no int, sheet_name string, row_no bigint, cells array<string>, error string"
#: Workbooks whose sheets are listed by the planner; beyond, a task reads whole workbooks.
LISTED = 1000
_BATCH = 2000
_CHUNK = 1 << 16  # bytes of a sheet's XML parsed at a time
_KNOWN = 1 << 14  # numbers kept with their texts

# XML namespaces, and number formats that show dates or times.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_M = f"{{{_MAIN}}}"
_DATA, _ROW, _C, _V, _IS, _T, _RPH = (f"{_MAIN}}}{x}" for x in ("sheetData", "row", "c", "v", "is", "t", "rPh"))
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_ARROW = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet_name", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


class _Texts:
    """Shared strings, as bytes side by side: a hundred bytes less for each."""

    def __init__(self) -> None:
        self.data, self.end = bytearray(), array("q", [0])

    def add(self, text: str) -> None:
        self.data += text.encode()
        self.end.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.end) - 1:
            raise IndexError(f"no shared string {i}")
        return self.data[self.end[i] : self.end[i + 1]].decode()


def _said(item: ElementTree.Element) -> str:
    """Text of a string item: its own and that of its runs."""
    own = [t for e in item for t in ([e] if e.tag == _M + "t" else e.iterfind(f"{_M}t") if e.tag == _M + "r" else [])]
    return "".join(t.text or "" for t in own)


def _stream(source, parent: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a kind, each let go after it was used."""
    holder = None
    for event, element in ElementTree.iterparse(source, events=("start", "end")):
        if event == "start":
            if element.tag == _M + parent:
                holder = element
        elif element.tag == _M + tag and holder is not None:
            yield element
            holder.clear()


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


class Workbook:
    """An open workbook; sheets are (number, name, part of the archive)."""

    def __init__(self, source) -> None:
        self.book = zipfile.ZipFile(source)
        root = ElementTree.fromstring(self.book.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.book.read("xl/_rels/workbook.xml.rels"))}
        settings = root.find(f"{_M}workbookPr")
        self.from_1904 = settings is not None and settings.get("date1904", "0") in ("1", "true")
        self.sheets = []
        for number, sheet in enumerate(root.iterfind(f"{_M}sheets/{_M}sheet")):
            target = targets[sheet.get(f"{{{_LINKS}}}id")]
            self.sheets.append((number, sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        self.names = set(self.book.namelist())
        self.shared: _Texts | None = None
        self.dates: set[int] | None = None
        self.numbers: dict[tuple[str, bool], str] = {}

    def _prepare(self) -> None:
        if self.shared is not None:
            return
        self.shared, self.dates = _Texts(), set()
        if "xl/sharedStrings.xml" in self.names:
            with self.book.open("xl/sharedStrings.xml") as f:
                for item in _stream(f, "sst", "si"):
                    self.shared.add(_said(item))
        if "xl/styles.xml" in self.names:
            root = ElementTree.fromstring(self.book.read("xl/styles.xml"))
            bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
            own = {int(f.get("numFmtId")) for f in root.iterfind(f"{_M}numFmts/{_M}numFmt") if re.search(r"[dyhs]", bare(f.get("formatCode", "")), re.I)}
            self.dates = {i for i, x in enumerate(root.iterfind(f"{_M}cellXfs/{_M}xf")) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}

    def _number(self, value: str, is_date: bool) -> str:
        number = float(value)
        if not is_date:
            return str(int(number)) if number == int(number) else value
        half = timedelta(days=number, microseconds=500_000)
        if number < 1:
            return (datetime(1900, 1, 1) + half).strftime("%H:%M:%S")
        # The 1900 system counts a 29 February 1900 that wasn't.
        zero = datetime(1904, 1, 1) if self.from_1904 else datetime(1899, 12, 30) if number >= 60 else datetime(1899, 12, 31)
        return (zero + half).strftime("%Y-%m-%d %H:%M:%S")

    def _value(self, kind: str, style: int, text: str) -> str:
        if kind == "s":
            return self.shared[int(text)]
        if kind == "n":
            known = (text, style in self.dates)
            if known not in self.numbers:  # dates and numbers recur
                if len(self.numbers) == _KNOWN:
                    self.numbers.clear()
                self.numbers[known] = self._number(*known)
            return self.numbers[known]
        if kind == "b":
            return "True" if text.strip() == "1" else "False"
        return text.replace("T", " ") if kind == "d" else text

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        """(row number, cells) of the rows that have any value."""
        self._prepare()
        sheet = _Sheet(self._value)
        with self.book.open(part) as f:
            while not sheet.ended:
                try:
                    sheet.feed(f.read(_CHUNK))
                finally:  # what came before a damage counts
                    found, sheet.found = sheet.found, []
                    yield from found


class _Sheet:
    """A parser's calls for a sheet's XML: few, as a row has dozens of them."""

    def __init__(self, value: Callable[[str, int, str], str]) -> None:
        self.value = value
        self.found: list[tuple[int, list[str | None]]] = []
        self.ended = self.open = False  # the XML; its rows
        self.number, self.cells = 0, None  # of the open row
        self.kind = self.style = self.at = self.text = None  # of the open cell
        self.inline = self.phonetic = self.taken = False
        self.columns: dict[str, int] = {}
        self.parser = expat.ParserCreate(None, "}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end

    def feed(self, data: bytes) -> None:
        self.ended = not data
        self.parser.Parse(data, self.ended)

    def _said(self, text: str) -> None:
        self.text = text if self.text is None else self.text + text

    def _start(self, tag: str, given: dict[str, str]) -> None:
        if tag == _C:
            if self.cells is None:
                return
            self.kind, self.style = given.get("t", "n"), int(given.get("s", 0))
            self.text, self.taken = None, False
            if reference := given.get("r"):
                letters = reference.rstrip("0123456789")
                self.at = self.columns.get(letters)
                if self.at is None:
                    self.at = self.columns[letters] = _column(letters)
            else:
                self.at = len(self.cells)
        elif tag == _V or tag == _T:
            if self.kind is not None and not self.phonetic and not self.taken and (tag == _T) == self.inline == (self.kind == "inlineStr"):
                self.parser.CharacterDataHandler = self._said
        elif tag == _ROW:
            if self.open:
                self.number = int(given.get("r", self.number + 1))
                self.cells = []
        elif tag == _IS:
            self.inline = True
            if self.kind == "inlineStr" and self.text is None:
                self.text = ""
        elif tag == _RPH:
            self.phonetic = True
        elif tag == _DATA:
            self.open = True

    def _end(self, tag: str) -> None:
        if tag == _V or tag == _T:
            self.parser.CharacterDataHandler = None
            self.taken = self.taken or (tag == _V and not self.inline and self.kind != "inlineStr")
        elif tag == _C:
            if self.kind is None:
                return
            text = self.text
            if text is not None and self.kind != "inlineStr":
                text = self.value(self.kind, self.style, text)
            cells = self.cells
            if self.at == len(cells):
                cells.append(text)
            else:
                cells += [None] * (self.at + 1 - len(cells))
                cells[self.at] = text
            self.kind = None
        elif tag == _ROW:
            if self.cells is not None and any(x is not None and x.strip() for x in self.cells):
                self.found.append((self.number, self.cells))
            self.cells = None
        elif tag == _IS:
            self.inline = False
        elif tag == _RPH:
            self.phonetic = False


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _book_rows(path: str, source, wanted: Sequence[int] | None, names: frozenset[str] | None, first: bool) -> Iterator[tuple]:
    """Rows of the wanted sheets; of each the first two only, if so asked."""
    try:
        book = Workbook(source)
        for number, name, part in book.sheets:
            if (wanted is None or number in wanted) and (names is None or name in names):
                for n, (row, cells) in enumerate(book.rows(part)):
                    if first and n == 2:
                        break
                    yield path, number, name, row, cells, None
    except Exception as e:  # any damage: one workbook fails, not the load
        yield path, None, None, None, None, f"unreadable workbook: {type(e).__name__}: {e}"


@dataclass
class _Sheets(InputPartition):
    path: str
    numbers: tuple[int, ...] | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.first = options.get("rows", "all") == "first"
        self.names = frozenset([options["sheet"]]) if "sheet" in options else None
        self.numbers: frozenset[int] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("sheet_name",):
                self.names = frozenset(values) if self.names is None else self.names & values
            elif values is not None and f.attribute == ("sheet_no",):
                self.numbers = frozenset(values) if self.numbers is None else self.numbers & values
            else:
                yield f

    def _sheets(self, path: str) -> list[_Sheets]:
        try:
            with files.open_read(path) as f:
                sheets = Workbook(f).sheets
        except Exception:  # its task says what is wrong
            return [_Sheets(path, None)]
        return [_Sheets(path, (n,)) for n, name, _ in sheets if (self.names is None or name in self.names) and (self.numbers is None or n in self.numbers)]

    def partitions(self) -> Sequence[InputPartition]:
        if len(self.paths) > LISTED:
            return [_Sheets(p, None) for p in self.paths]
        with ThreadPoolExecutor(8) as pool:
            return [s for of_book in pool.map(self._sheets, self.paths) for s in of_book] or [_Sheets("", ())]

    def read(self, partition: _Sheets) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        wanted = partition.numbers if partition.numbers is not None else self.numbers
        try:
            source = files.open_read(partition.path)
        except Exception as e:
            yield _batch([(partition.path, None, None, None, None, f"unreadable workbook: {type(e).__name__}: {e}")])
            return
        with source:
            yield from _batches(_book_rows(partition.path, source, wanted, self.names, self.first))


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """A workbook for each task, from rows (sheet_name, cells and maybe kinds:
    n a number, d a date's number, else text) that are sorted by sheet. Files
    get their names when all tasks are done."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.from_1904 = options.get("date1904", "false") == "true"

    def write(self, iterator: Iterator) -> _Written:
        context = TaskContext.get()
        rows = iter(iterator)
        first = next(rows, None)
        if first is None:
            return _Written(None)
        path = f"{self.folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.xlsx"
        with files.open_write(path) as f:
            write_workbook(f, _chain(first, rows), self.from_1904)
        return _Written(path)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path is not None:
                files.move(m.path, m.path.replace("/.part-", "/part-"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path is not None:
                files.delete(m.path)


def _chain(first, rest: Iterator) -> Iterator[tuple]:
    for r in (first, *()):
        yield r["sheet_name"], r["cells"], r["kinds"] if "kinds" in r else None
    for r in rest:
        yield r["sheet_name"], r["cells"], r["kinds"] if "kinds" in r else None


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


# -- writing -----------------------------------------------------------------------


def write_workbook(target, rows: Iterator[tuple[str, list, list | None]], from_1904: bool = False) -> None:
    """A workbook of (sheet, cells, kinds) rows, streamed, sheet after sheet."""
    kinds = f'xmlns="{_MAIN}" xmlns:r="{_LINKS}"'
    names: list[str] = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book, ExitStack() as open_part:
        part, number = None, 0
        for sheet, cells, kind in rows:
            if not names or names[-1] != sheet:
                if sheet in names:
                    raise ValueError(f"rows of sheet {sheet} are not together")
                if part is not None:
                    part.write(b"</sheetData></worksheet>")
                    open_part.close()
                names.append(sheet)
                part, number = open_part.enter_context(book.open(f"xl/worksheets/sheet{len(names)}.xml", "w")), 0
                part.write(f"<worksheet {kinds}><sheetData>".encode())
            number += 1
            body = "".join(_cell(number, j, c, kind[j] if kind else "s") for j, c in enumerate(cells) if c is not None)
            part.write(f'<row r="{number}">{body}</row>'.encode())
        if part is not None:
            part.write(b"</sheetData></worksheet>")
            open_part.close()
        listed = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook {kinds}><workbookPr date1904="{int(from_1904)}"/><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {kinds}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def _cell(row: int, column: int, value: object, kind: str) -> str:
    at, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        at = chr(65 + rest) + at
    if kind in ("n", "d"):
        return f'<c r="{at}{row}" s="{int(kind == "d")}"><v>{value}</v></c>'
    return f'<c r="{at}{row}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def save_workbooks(rows: DataFrame, folder: str, from_1904: bool = False) -> None:
    """Rows (sheet_name, cells, kinds) as workbooks, one for each partition."""
    register(rows.sparkSession)
    options = {"path": files.qualified(rows.sparkSession, folder), "date1904": str(from_1904).lower()}
    rows.write.format(FORMAT).options(**options).mode("append").save()


# -- reading -----------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    files.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxSource)


def _through_spark(first: bool, sheet: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None if sheet is None else frozenset([sheet])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _batches(_book_rows(path, pa.BufferReader(content), None, names, first))

    return run


def _load(spark: SparkSession, path: str, sheet_name: str | None, first: bool) -> DataFrame:
    sheet = None if sheet_name in (None, "all") else sheet_name
    found = files.list_files(spark, path)
    if found and files.scheme(found[0]) not in files.OPENED:  # a store that only Spark reads
        files.ship(spark)
        content = spark.read.format("binaryFile").load(path).select("path", "content")
        return content.mapInArrow(_through_spark(first, sheet), SCHEMA)
    register(spark)
    options = {"paths": json.dumps(found), "rows": "first" if first else "all"} | ({"sheet": sheet} if sheet is not None else {})
    return spark.read.format(FORMAT).options(**options).load()


def xlsx_scan(spark: SparkSession, path: str, sheet_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): (path, sheet_no, sheet_name, row_no, cells) of all
    sheets, or of one (None and "all": all), and a reject for every workbook
    that can't be read, with its path as the sheet."""
    rows = _load(spark, path, sheet_name, False)
    rejects = rows.where("error is not null").select(F.col("path").alias("sheet_name"), F.lit(None).cast("bigint").alias("row_no"), F.col("error").alias("reason"))
    return rows.where("error is null").drop("error"), rejects


def xlsx_cells(spark: SparkSession, path: str, sheet_name: str | None = None) -> DataFrame:
    return xlsx_scan(spark, path, sheet_name)[0]


def xlsx_heads(spark: SparkSession, path: str, sheet_name: str | None = None) -> DataFrame:
    """The first two rows of each sheet: all that its header needs."""
    return _load(spark, path, sheet_name, True).where("error is null").drop("error")
