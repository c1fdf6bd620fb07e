"""Cell parsing as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.dates import once, recognise

# Times of 24 hours, with seconds or not, or of 12 with AM or PM.
_TIME_24 = r"^([01]?\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d))?$"
_TIME_12 = r"^(0?[1-9]|1[0-2]):([0-5]?\d)(?::([0-5]?\d))? ([AP]M)$"


def strip(c: Column) -> Column:
    """Without white space, Unicode's and separators included, at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def text(c: Column) -> Column:
    """A cell as stripped text; a missing cell or NaN is null."""
    return strip(F.nullif(c.cast("string"), F.lit("NaN")))


def optional(c: Column) -> Column:
    return F.nullif(text(c), F.lit(""))


def date(c: Column) -> Column:
    """The date of a cell, see ``dates.recognise``; a trailing .0 of an
    all-digit value is dropped; null if nothing fits."""
    return recognise(F.regexp_replace(text(c), r"^(\d+)\.0$", "$1"))


def time(c: Column) -> Column:
    """HH:mm:ss, or null where no format fits."""
    s = F.upper(F.regexp_replace(text(c), r"\s+", " "))
    s = F.regexp_replace(s, r"(\d)([AP]M)$", "$1 $2")

    def shown(s: Column, pattern: str) -> Column:
        two = lambda i: F.lpad(F.regexp_extract(s, pattern, i), 2, "0")
        hour = two(1)
        if pattern == _TIME_12:
            h = F.regexp_extract(s, pattern, 1).try_cast("int") % 12
            hour = F.lpad((h + F.when(s.endswith("PM"), 12).otherwise(0)).cast("string"), 2, "0")
        return F.concat_ws(":", hour, two(2), two(3))  # no seconds: 00

    return once(s, lambda t: F.when(t.rlike(_TIME_24), shown(t, _TIME_24)).when(t.rlike(_TIME_12), shown(t, _TIME_12)))


def people(c: Column) -> Column:
    """Addresses of a list cell: stripped, with an @; none: null."""
    parts = F.filter(F.transform(F.split(text(c), r"[,\n;]+"), strip), lambda x: x.contains("@"))
    return once(parts, lambda p: F.when(F.size(p) > 0, p))


def spreadsheet_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1), F.lit(""))


def valid_user_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9@._-]+\z"), F.lit(False))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9@._+-]+\z"), F.lit(False))


def boolean_text(c: Column) -> Column:
    """TRUE or FALSE, as SQL text has it; a missing flag is FALSE."""
    return F.when(F.coalesce(c, F.lit(False)), "TRUE").otherwise("FALSE")


def sql_escape(c: Column) -> Column:
    """Text for a quoted literal: no NUL, doubled backslash and quote, line
    breaks as spaces. Parameters of ``spark.sql`` are the better way."""
    out = F.replace(c, F.lit("\0"), F.lit(""))
    out = F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def array_literal(c: Column) -> Column:
    """{"a","b"}"""
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit('"'), x, F.lit('"')))), F.lit("}"))
