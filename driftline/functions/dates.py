"""A date recogniser: tokens, a letter for the class of each, and one table of
the sequences of letters that are dates.

``2026-09-01 09:00`` has the tokens ``2026 - 09 - 01 _ 09 : 00`` and the classes
``y-n-n n:n``: a date shape, then the tail of a time. The table says which token
of the shape is year, month or day.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# English names of months and weekdays, and their short forms.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

_MONTH = {n: i for i, m in enumerate(MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
_LETTERS = (
    dict.fromkeys(_MONTH, "m")
    | {n: "w" for d in WEEKDAYS for n in (d, d[:3])}
    | {"tues": "w", "thur": "w", "thurs": "w", "am": "p", "pm": "p", "t": "t", "z": "z", "utc": "z", "gmt": "z"}
    | dict.fromkeys(("st", "nd", "rd", "th"), "o")
)
#: Digits by their number: n for one or two, y for four, s for six, c for eight, d for others.
_DIGITS = ["n", "n", "d", "y", "d", "s", "d", "c"]


def _shapes() -> dict[str, str]:
    """Shape -> roles: Y year, M month, D day, A and B month and day, or where
    that is no date day and month; other letters are skipped."""
    out = {"c": "C"}
    for s in "-/.":
        out |= {f"y{s}n{s}n": f"Y{s}M{s}D", f"n{s}n{s}y": f"A{s}B{s}Y", f"n{s}n{s}n": f"A{s}B{s}Y"}
    for s in "-/. ":
        for year in "yn":
            out[f"n{s}m{s}{year}"] = f"D{s}M{s}Y"
        out[f"y{s}m{s}n"] = f"Y{s}M{s}D"
    for first, sep, year in product(("m n", "m. n", "m n o", "m no"), (", ", " ", ","), "yn"):
        if sep.strip() or year == "y":
            out[first + sep + year] = first.replace("m", "M").replace("n", "D") + sep + "Y"
    for first, sep in product(("no m", "n m", "n m."), (" ", ", ", ",")):
        out[first + sep + "y"] = first.replace("m", "M").replace("n", "D") + sep + "Y"
    return out | {"y-n": "Y-M", "y/n": "Y/M", "m y": "M Y", "m, y": "M, Y"}


SHAPES = _shapes()
_TIME = r"n:n(?::n(?:\.[nyscd])?)?(?: ?p)?|n ?p|s"
_ZONE = r" ?z| ?z?[-+](?:n:n|n|y)"
_WHOLE = "^(" + "|".join(re.escape(s) for s in sorted(SHAPES, key=len, reverse=True)) + rf")(?:(?:t|,? )(?:{_TIME})(?:{_ZONE})?)?$"
_LEAD = r"^w(?:, ?| )"  # a weekday, which says nothing more
_TOKENS = r"\d+|[A-Za-z]+|\s+|."
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?: (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?\z"
_SLASHES = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"
_CLOCK = r"(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}))?(?:\.\d+)?\s*([AaPp][Mm])?"


def once(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f mentions it."""
    return F.transform(F.array(c), f)[0]


def _table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def _class(token: Column) -> Column:
    letters, digits = _table(_LETTERS), F.array(*map(F.lit, _DIGITS))
    return (
        F.when(token.rlike(r"^\d"), F.coalesce(F.get(digits, F.length(token) - 1), F.lit("d")))
        .when(token.rlike("^[A-Za-z]"), F.coalesce(F.try_element_at(letters, F.lower(token)), F.lit("x")))
        .when(token.rlike(r"^[-/.:,+]$"), token)
        .when(token.rlike(r"^\s"), F.lit(" "))
        .otherwise("x")
    )


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none such; a cast, so nothing is thrown."""
    return F.when(year != "0000", F.concat_ws("-", year, month, day).try_cast("date"))


def _clock_fits(tail: Column) -> Column:
    """The time in the tail is one of a day."""
    tail = F.regexp_replace(tail, r"^(.)(\d\d)(\d\d)(\d\d)", "$1$2:$3:$4")
    part = lambda i: F.coalesce(F.regexp_extract(tail, _CLOCK, i).try_cast("int"), F.lit(0))
    half = F.regexp_extract(tail, _CLOCK, 4) != ""
    return (tail == "") | ((part(1) <= F.when(half, 12).otherwise(23)) & ~(half & (part(1) == 0)) & (part(2) <= 59) & (part(3) <= 59))


def recognise(text: Column) -> Column:
    """The date of a stripped text, null where no shape fits. Month first where
    both readings exist; a time must be one of a day, and neither it nor its
    zone moves the date; a short year is of 1969 to 2068.

    What workbooks and CSV files mostly have, two of the shapes in full digits,
    is read without tokens, with the same result."""

    def read(t: Column) -> Column:
        a, b, year = (F.regexp_extract(t, _SLASHES, i) for i in (1, 2, 3))
        either = F.coalesce(_day(year, a, b), _day(year, b, a))
        plain = _day(F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2))
        return F.when(t.rlike(_PLAIN), plain).when(t.rlike(_SLASHES), either).otherwise(by_shape(t))

    return once(text, read)


def by_shape(text: Column) -> Column:
    """``recognise`` by tokens and the table, whatever the shape."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(f"({_TOKENS})"), F.lit(1)), lambda x: F.struct(x.alias("text"), _class(x).alias("kind")))

    def led(t: Column) -> Column:
        kinds = F.array_join(F.transform(t, lambda x: x["kind"]), "")
        lead = F.length(F.regexp_extract(kinds, _LEAD, 0))
        return once(F.struct(F.slice(t, lead + 1, F.size(t)).alias("t"), F.regexp_extract(F.substr(kinds, lead + 1), _WHOLE, 1).alias("shape")), read)

    def read(s: Column) -> Column:
        t, shape = s["t"], s["shape"]
        # Every class is one letter, so a place in the shape is a token's place.
        tail = F.array_join(F.transform(F.slice(t, F.length(shape) + 1, F.size(t)), lambda x: x["text"]), "")
        return once(F.struct(F.try_element_at(_table(SHAPES), shape).alias("roles"), t.alias("t"), _clock_fits(tail).alias("fits")), build)

    def build(s: Column) -> Column:
        def token(role: str) -> Column:
            return F.get(s["t"], F.instr(s["roles"], role) - 1)["text"]

        year = token("Y")
        year = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year.try_cast("int") <= 68, "20").otherwise("19"), F.lpad(year, 2, "0")))
        named = F.coalesce(F.try_element_at(_table(_MONTH), F.lower(token("M"))).cast("string"), token("M"))
        day = F.coalesce(token("D"), F.lit("1"))
        compact = token("C")
        either = F.coalesce(_day(year, token("A"), token("B")), _day(year, token("B"), token("A")))
        whole = _day(F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2))
        date = F.when(s["roles"].contains("C"), whole).when(s["roles"].contains("A"), either).otherwise(_day(year, named, day))
        return F.when(s["fits"], date)

    return once(tokens, led)
