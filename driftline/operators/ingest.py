"""Grids of text to events, rejects and warnings."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from driftline import files
from driftline.functions import headers, parsing
from driftline.schemas import EVENT, FIELDS, LINEAGE, WARNING

_SHEET = ("path", "sheet_no")


def row_reason(title: Column, start: Column, end: Column) -> Column:
    """Why a row is rejected; null where it's good."""
    return (
        F.when(F.coalesce(title, F.lit("")) == "", F.lit("title is required"))
        .when(start.isNull(), F.lit("bad start_date"))
        .when(end.isNull(), F.lit("bad end_date"))
    )


def _fields(cell) -> list[Column]:
    return [
        parsing.text(cell("title")).alias("title"),
        parsing.date(cell("start_date")).alias("start_date"),
        parsing.date(cell("end_date")).alias("end_date"),
        parsing.optional(cell("description")).alias("description"),
        parsing.optional(cell("location")).alias("location"),
        parsing.people(cell("attendees")).alias("attendees"),
        parsing.time(cell("start_time")).alias("start_time"),
        parsing.time(cell("end_time")).alias("end_time"),
    ]


def _ordinal(path: Column, sheet_no: Column, row_no: Column) -> Column:
    """Orders rows by workbook, sheet and row; no arithmetic, so no overflow."""
    return F.struct(path.cast("string").alias("book"), sheet_no.cast("int").alias("sheet"), row_no.cast("bigint").alias("row")).alias("ordinal")


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", row_reason(F.col("title"), F.col("start_date"), F.col("end_date")))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of judged rows. Each reads them again; ``publish`` and
    ``outcome`` of a staged table evaluate them once."""
    rejects = rows.where("reason is not null").select("sheet_name", "row_no", "reason")
    return rows.where("reason is null").select(*FIELDS, *LINEAGE), rejects


def sheet_rows(grid: DataFrame, sheet_name: str, sheet_no: int = 0, row_no: str | Column = "_row_no") -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of one sheet whose header is the frame's column names:
    events with a reason, null where they're good.

    ``row_no`` is the column that numbers rows; it orders events, as sheets'
    numbers do. Of two columns for a field the first counts. A sheet without the
    required columns is one row with the reason, or none if it has no rows.
    """
    spark = grid.sparkSession
    number = F.col(row_no) if isinstance(row_no, str) else row_no
    columns = [c for c in grid.columns if not (isinstance(row_no, str) and c == row_no)]
    found, reasons, further = headers.map_headers(columns)
    warnings = spark.createDataFrame([(sheet_name, w) for w in further], WARNING)
    if reasons:
        none = spark.createDataFrame([], EVENT).withColumn("reason", F.lit(None).cast("string"))
        whole = grid.limit(1).select(F.lit(sheet_name).alias("sheet_name"), F.lit("; ".join(reasons)).alias("reason"))
        return none.unionByName(whole, allowMissingColumns=True), warnings
    position = {c: i for i, c in enumerate(grid.columns)}
    renamed = grid.toDF(*[f"c{i}" for i in range(len(grid.columns))])
    if isinstance(row_no, str):
        number = F.col(f"c{position[row_no]}")
    at = {name: F.col(f"c{position[columns[i]]}") for name, i in found.items()}
    fields = _fields(lambda name: at.get(name, F.lit(None).cast("string")))
    place = [F.lit(sheet_name).alias("sheet_name"), number.cast("bigint").alias("row_no"), _ordinal(F.lit(None), F.lit(sheet_no), number)]
    return _judged(renamed.select(*fields, *place)), warnings


def sheet_events(grid: DataFrame, sheet_name: str, sheet_no: int = 0, row_no: str | Column = "_row_no", strict_sheet: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of one sheet; both lazy. A bad row is rejected alone,
    or with ``strict_sheet`` with its sheet."""
    events, rejects = split(sheet_rows(grid, sheet_name, sheet_no, row_no)[0])
    return (_strict(events, rejects) if strict_sheet else events), rejects


def _strict(events: DataFrame, rejects: DataFrame) -> DataFrame:
    return events.join(rejects.select("sheet_name").distinct(), "sheet_name", "left_anti").select(*FIELDS, *LINEAGE)


def sheet_heads(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet_name, header, head_row, filled): the first row of
    each sheet, and whether it has others."""
    heads = cells.groupBy(*_SHEET).agg(F.min_by(F.struct("sheet_name", "cells"), "row_no").alias("h"), F.min("row_no").alias("head_row"), F.max("row_no").alias("last"))
    return heads.select(*_SHEET, "h.sheet_name", F.col("h.cells").alias("header"), "head_row", (F.col("last") > F.col("head_row")).alias("filled"))


def field_positions(heads: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet_name, field, position): the header mapping as rows."""
    at = headers.positions(F.col("header"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), at[f].alias("position")) for f in FIELDS])
    return heads.select(*_SHEET, "sheet_name", F.inline(pairs)).where("position is not null")


def cell_rows(cells: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of any number of sheets (path, sheet_no, sheet_name,
    row_no, cells array<string>) in one plan of fixed size.

    Headers are data: their mapping is joined to the cells, and a field's cell is
    taken at its sheet's position. Sheets without rows below the header are left
    out; sheets without the required columns are one row with the reason.
    ``heads`` are the cells of the first two rows of each sheet, where they can
    be had for less than all.
    """
    known = sheet_heads(cells if heads is None else heads).where("filled")
    known = known.withColumn("at", headers.positions(F.col("header")))
    known = known.withColumn("bad", headers.missing(F.col("at")))
    good = known.where("bad is null").select(*_SHEET, "at", "head_row")
    joined = cells.select(*_SHEET, "sheet_name", "row_no", "cells").join(good, list(_SHEET)).where("row_no > head_row")
    fields = _fields(lambda name: F.get("cells", F.col(f"at.{name}")))
    rows = _judged(joined.select(*fields, "sheet_name", F.col("row_no").cast("bigint").alias("row_no"), _ordinal(F.col("path"), F.col("sheet_no"), F.col("row_no"))))
    whole = known.where("bad is not null").select("sheet_name", F.col("bad").alias("reason"))
    warnings = known.where("bad is null").select("sheet_name", F.explode(headers.further(F.col("header"), F.col("at"))).alias("warning"))
    return rows.unionByName(whole, allowMissingColumns=True), warnings


def cell_events(cells: DataFrame, heads: DataFrame | None = None, strict_sheet: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of any number of sheets."""
    events, rejects = split(cell_rows(cells, heads)[0])
    return (_strict(events, rejects) if strict_sheet else events), rejects


def workbook_events(sheets: Sequence[tuple[str, DataFrame]], **options) -> tuple[DataFrame, DataFrame]:
    """Events and rejects of a few grids in order; ``cell_events`` for many."""
    parts = [sheet_events(grid, name, i, **options) for i, (name, grid) in enumerate(sheets)]
    if not parts:
        raise ValueError("no sheets")
    return reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])


# -- all or nothing ------------------------------------------------------------------


@dataclass(frozen=True)
class Staged:
    """Judged rows, written once, and what they hold."""

    rows: DataFrame
    path: str
    events: int
    rejects: int

    @property
    def accepted(self) -> bool:
        return self.events > 0 and self.rejects == 0


def stage(rows: DataFrame, folder: str | None = None, more_rejects: DataFrame | None = None) -> Staged:
    """Write judged rows, counting them on the way: the grid is read once.
    ``more_rejects``, as of workbooks that can't be read, are staged with them."""
    spark = rows.sparkSession
    if more_rejects is not None:
        rows = rows.unionByName(more_rejects.select("sheet_name", "row_no", "reason"), allowMissingColumns=True)
    path = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}" if folder else files.shared_folder(spark, "staged")
    seen = Observation()
    counted = rows.observe(seen, F.count_if(F.col("reason").isNull()).alias("events"), F.count_if(F.col("reason").isNotNull()).alias("rejects"))
    counted.write.parquet(path)
    got = seen.get
    return Staged(spark.read.schema(rows.schema).parquet(path), path, got["events"], got["rejects"])


def publish(staged: Staged, target: str) -> DataFrame:
    """The staged events under their name, all or none: raises where a row was
    rejected, none is left, or the name is taken. One rename is all that shows."""
    if not staged.accepted:
        raise ValueError(refusal(staged))
    spark = staged.rows.sparkSession
    files.rename(spark, staged.path, target)
    return spark.read.schema(staged.rows.schema).parquet(target).select(*FIELDS, *LINEAGE)


def refusal(staged: Staged) -> str:
    """Why staged rows aren't published: their number, and the first of them in
    order. ``messages`` has all."""
    if not staged.rejects:
        return "no events"
    first = messages(staged.rows.where("reason is not null").orderBy("sheet_name", "row_no", "reason").limit(20)).collect()
    more = staged.rejects - len(first)
    return "; ".join(r.error for r in first) + (f"; and {more} more" if more else "")


def accepted(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """All or nothing: raises where a row was rejected or none is left."""
    bad = rejects.limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"Sheet '{r.sheet_name}'" + (f" Row {r.row_no}" if r.row_no is not None else "") + f": {r.reason}" for r in bad))
    if events.isEmpty():
        raise ValueError("no events")
    return events


def messages(rejects: DataFrame) -> DataFrame:
    """All rejects as text, as a result page lists them."""
    row = F.when(F.col("row_no").isNotNull(), F.concat(F.lit(" Row "), F.col("row_no").cast("string"))).otherwise("")
    return rejects.select(F.concat(F.lit("Sheet '"), "sheet_name", F.lit("'"), row, F.lit(": "), "reason").alias("error"))


def outcome(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: success (events and no reject), events_processed, errors."""
    both = events.select(F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(rejects.select(F.lit(0).alias("e"), F.lit(1).alias("r")))
    n = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("events_processed"), F.coalesce(F.sum("r"), F.lit(0)).alias("errors"))
    return n.select(((F.col("errors") == 0) & (F.col("events_processed") > 0)).alias("success"), "events_processed", "errors")


def judged_outcome(rows: DataFrame) -> DataFrame:
    """``outcome`` of judged rows, which are read once."""
    n = rows.agg(F.count_if(F.col("reason").isNull()).alias("events_processed"), F.count_if(F.col("reason").isNotNull()).alias("errors"))
    return n.select(((F.col("errors") == 0) & (F.col("events_processed") > 0)).alias("success"), "events_processed", "errors")
