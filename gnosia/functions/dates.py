"""Date text to date terms, and date terms to time intervals.

A date term names a unit of time: (DayFn 'd (MonthFn February (YearFn 'y))), with HourFn, MinuteFn and SecondFn inside
days; its interval runs from the unit's start to a millisecond before the next unit.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English names (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: Accepted orders of fields: y year, m month number, M month name, d day, E weekday (fixed values).
ORDERS = ("y", "y m", "y m d", "m", "M", "m y", "M y", "M d y", "E M d y", "d m y", "m d y", "d M y", "E d m y", "E d M y", "d M", "M d", "d m")
THIS_YEAR = "TheYear-Indexical"


def _named(word: str, names: Iterable[str]) -> int | None:
    """Number of a name, written in full or by its first three letters."""
    word = word.lower()
    return next((i for i, n in enumerate(names, 1) if word in (n.lower(), n[:3].lower())), None)


def _day_number(y: int, m: int, d: int) -> int:
    """Julian day number; dates before 15 October 1582 are in the Julian calendar."""
    a = (14 - m) // 12
    y2, m2 = y + 4800 - a, m + 12 * a - 3
    common = d + (153 * m2 + 2) // 5 + 365 * y2 + y2 // 4
    return common - y2 // 100 + y2 // 400 - 32045 if (y, m, d) >= (1582, 10, 15) else common - 32083


def _valid(y: int, m: int, d: int) -> bool:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0 or y <= 1582)
    return y >= 1 and 1 <= m <= 12 and 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _read(order: str, words: list[str]) -> str | None:
    kinds = order.split(" ")
    if len(kinds) != len(words):
        return None
    got: dict[str, int] = {}
    for kind, word in zip(kinds, words, strict=True):
        value = _named(word, MONTHS) if kind == "M" else _named(word, WEEKDAYS) if kind == "E" else int(word) if re.fullmatch(r"[0-9]{1,9}", word) else None
        if value is None:
            return None
        got[kind.lower()] = value
    y, m, d = got.get("y", 1970), got.get("m", 1), got.get("d", 1)
    if not _valid(y, m, d) or ("e" in got and _day_number(y, m, d) % 7 != got["e"] - 1):
        return None
    term = f"(YearFn '{y})" if "y" in got else THIS_YEAR
    if "m" in got:
        term = f"(MonthFn {MONTHS[m - 1]} {term})"
    return f"(DayFn '{d} {term})" if "d" in got else term


def parse_date(text: str | None) -> list[str]:
    """Every date term that a text can mean, in the order of the accepted forms; an ambiguous text has several."""
    words = re.sub(r"[ /\-,]+", " ", text or "").split(" ") if text else []
    return list(dict.fromkeys(t for order in ORDERS if (t := _read(order, words)) is not None))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def date_terms(text: str | None) -> list[str]:
    """parse_date() for a column of short strings."""
    return parse_date(text)


_UNITS = ("SecondFn", "MinuteFn", "HourFn", "DayFn", "MonthFn", "YearFn")
_TERM = r"^(?:\(SecondFn '\d{1,2} (?=\(MinuteFn))?(?:\(MinuteFn '\d{1,2} (?=\(HourFn))?(?:\(HourFn '\d{1,2} (?=\(DayFn))?(?:\(DayFn '\d{1,2} (?=\(MonthFn))?(?:\(MonthFn [A-Za-z]+ )?\(YearFn '\d{1,4}\)+$"


def interval(term: Column, now: str | None = None) -> Column:
    """struct<start, end> of a date term, null if it is none. now: ISO time for indexical terms (the query's time by default)."""

    def part(unit: str) -> Column:
        return F.nullif(F.regexp_extract(term, rf"\({unit} '(\d+)", 1), F.lit("")).cast("int")

    ok = term.rlike(_TERM)
    month = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.lower(F.substr(F.regexp_extract(term, r"\(MonthFn ([A-Za-z]+)", 1), F.lit(1), F.lit(3)))).cast("int")
    month = F.when(term.contains("(MonthFn "), F.nullif(month, F.lit(0))).otherwise(1)
    one, zero = F.lit(1), F.lit(0)
    start = F.when(ok, F.try_make_timestamp(part("YearFn"), month, F.coalesce(part("DayFn"), one), F.coalesce(part("HourFn"), zero), F.coalesce(part("MinuteFn"), zero), F.coalesce(part("SecondFn"), zero)))
    end = (
        F.when(term.startswith("(Year"), start + F.expr("interval 1 year")).when(term.startswith("(Month"), start + F.expr("interval 1 month"))
        .when(term.startswith("(Day"), start + F.expr("interval 1 day")).when(term.startswith("(Hour"), start + F.expr("interval 1 hour"))
        .when(term.startswith("(Minute"), start + F.expr("interval 1 minute")).otherwise(start + F.expr("interval 1 second"))
    ) - F.expr("interval 1 millisecond")
    at = F.lit(dt.datetime.fromisoformat(now)) if now else F.current_timestamp()
    day, year = F.date_trunc("day", at), F.date_trunc("year", at)
    one_day = F.expr("interval 1 day")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"))

    return (
        F.when(term.isin("Now", "Now-Generally"), span(at, at + F.expr("interval 1 millisecond")))
        .when(term == "Today-Indexical", span(day, day + one_day)).when(term == "Tomorrow-Indexical", span(day + one_day, day + one_day + one_day))
        .when(term == "Yesterday-Indexical", span(day - one_day, day)).when(term == THIS_YEAR, span(year, year + F.expr("interval 1 year")))
        .when(start.isNotNull(), span(start, end))
    )


def later(a: Column, b: Column, now: str | None = None) -> Column:
    """Whether date term a lies wholly after b; false if either is no date."""
    return F.coalesce(interval(a, now)["start"] >= interval(b, now)["end"], F.lit(False))
