"""CF times: numbers since a reference date, as Column arithmetic, in the calendars of the CF conventions.

Dates of a calendar are (year, month, day, microseconds of the day); its days are counted by whole
numbers, by formulas that take Columns as well as Python's. Years begin in March there, so that a
leap day is the last of its year.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"microseconds": 1, "milliseconds": 1_000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}


def parse_reference(units: str) -> tuple[int, tuple[int, int, int], int]:
    """Microseconds of the unit, and date and microseconds of the day of 'days since 2000-01-01 00:00'."""
    m = re.fullmatch(r"\s*(\w+) since (\S+)(?:[ T](\S+))?\s*(?:UTC|Z)?", units)
    if not m:
        raise ValueError(f"no CF time units: {units!r}")
    name = m[1].lower()
    name = {"s": "seconds", "sec": "seconds", "min": "minutes", "h": "hours", "hr": "hours", "d": "days"}.get(name, name if name.endswith("s") else name + "s")
    y, mo, d = (int(x) for x in m[2].split("-"))
    clock = [float(x) for x in (m[3] or "0").split(":")] + [0, 0]
    return MICROS[name], (y, mo, d), round(sum(x * f for x, f in zip(clock, (3_600_000_000, 60_000_000, 1_000_000), strict=False)))


def parse_units(units: str) -> tuple[int, dt.datetime]:
    """Microseconds of the unit and the reference time, in the calendar of Python's dates."""
    step, (y, mo, d), micros = parse_reference(units)
    return step, dt.datetime(y, mo, d) + dt.timedelta(microseconds=micros)


#: Days of a year; julian and the Gregorian ones have leap days on top.
CALENDARS = {"noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366, "360_day": 360, "julian": 365, "proleptic_gregorian": 365, "standard": 365, "gregorian": 365}


def _div(a, b: int):
    """Toward minus infinity."""
    return F.floor(a / F.lit(b)).cast("bigint") if isinstance(a, Column) else a // b


def _pick(cond, yes, no):
    return F.when(cond, yes).otherwise(no) if isinstance(cond, Column) else yes if cond else no


def _let(x, body):
    """body(x), with a Column worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0)) if isinstance(x, Column) else body(x)


def _date(y, m, d):
    """A tuple of numbers, or a struct of Columns."""
    return F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day")) if isinstance(y, Column) else (y, m, d)


def _leap_days(y, calendar: str):
    """Leap days up to the end of year y, which begins in March."""
    if calendar == "julian":
        return _div(y, 4)
    if calendar == "proleptic_gregorian":
        return _div(y, 4) - _div(y, 100) + _div(y, 400)
    return y * 0


#: Where the standard calendar goes from Julian to Gregorian dates, and the days between their counts.
SWITCH = (1582, 10, 15)


def day_number(y, m, d, calendar: str = "standard"):
    """Days of a date since the calendar's year 0; numbers or Columns."""
    if calendar not in CALENDARS:
        raise ValueError(f"no calendar {calendar!r}; there are {sorted(CALENDARS)}")
    if calendar == "360_day":
        return y * 360 + (m - 1) * 30 + d - 1
    if calendar in ("standard", "gregorian"):
        new, old = day_number(y, m, d, "proleptic_gregorian"), day_number(y, m, d, "julian") - _OFF
        return _pick((y * 10_000 + m * 100 + d) >= SWITCH[0] * 10_000 + SWITCH[1] * 100 + SWITCH[2], new, old)
    return _let(_pick(m <= 2, y - 1, y), lambda year: year * CALENDARS[calendar] + _leap_days(year, calendar) + _div(_pick(m <= 2, m + 9, m - 3) * 153 + 2, 5) + d - 1)


def date_of(n, calendar: str = "standard"):
    """(year, month, day) of a day number, a struct of a Column."""
    return _let(n, lambda n: _date_of(n, calendar))


def _date_of(n, calendar: str):
    if calendar == "360_day":
        return _let(_div(n, 360), lambda y: _let(_div(n - y * 360, 30), lambda m: _date(y, m + 1, n - y * 360 - m * 30 + 1)))
    if calendar in ("standard", "gregorian"):
        return _pick(n >= _FIRST, date_of(n, "proleptic_gregorian"), date_of(n + _OFF, "julian"))
    if calendar == "julian":
        year = _div(n * 4 + 3, 1461)
    elif calendar == "proleptic_gregorian":
        era = _div(n, 146_097)
        year = _let(n - era * 146_097, lambda i: _div(i - _div(i, 1460) + _div(i, 36_524) - _div(i, 146_096), 365)) + era * 400
    else:
        year = _div(n, CALENDARS[calendar])

    def inside(year, i):
        return _let(_div(i * 5 + 2, 153), lambda m: _date(_pick(m < 10, year, year + 1), _pick(m < 10, m + 3, m - 9), i - _div(m * 153 + 2, 5) + 1))

    return _let(year, lambda year: _let(n - year * CALENDARS[calendar] - _leap_days(year, calendar), lambda i: inside(year, i)))


_FIRST = day_number(*SWITCH, "proleptic_gregorian")
_OFF = day_number(1582, 10, 5, "julian") - _FIRST
_DAY = MICROS["days"]


def exists(y: Column, m: Column, d: Column, calendar: str = "standard") -> Column:
    """Whether a calendar has a date."""
    same = lambda back: (back.year == y) & (back.month == m) & (back.day == d)
    return _let(date_of(day_number(y, m, d, calendar), calendar), same) & m.between(1, 12)


def decode_calendar(number: Column, units: str, calendar: str = "standard") -> Column:
    """The date in a calendar, as a struct of year, month, day and micros (of the day)."""
    step, ref, micros = parse_reference(units)
    start = F.lit(day_number(*ref, calendar))
    total = F.round(number * F.lit(step)).cast("bigint") + F.lit(micros)
    return _let(total, lambda t: _let(date_of(_div(t, _DAY) + start, calendar), lambda x: F.struct(x.year.alias("year"), x.month.alias("month"), x.day.alias("day"), (t - _div(t, _DAY) * _DAY).alias("micros"))))


def encode_calendar(year: Column, month: Column, day: Column, micros: Column, units: str, calendar: str = "standard") -> Column:
    """The number of a date in a calendar; missing where the calendar has no such date."""
    step, ref, start = parse_reference(units)
    y, m, d = (x.cast("bigint") for x in (year, month, day))
    days = day_number(y, m, d, calendar) - F.lit(day_number(*ref, calendar))
    return F.when(exists(y, m, d, calendar), (days * _DAY + micros - F.lit(start)) / F.lit(step))


def decoded_times(numbers: Iterable[float], units: str, calendar: str = "standard") -> list | None:
    """Labels of a coordinate: times; texts in calendars with dates that Python's has not; None for an unknown calendar."""
    calendar = str(calendar).lower()
    if calendar not in CALENDARS:
        return None
    step, ref, micros = parse_reference(units)
    start, out = day_number(*ref, calendar), []
    for x in numbers:
        days, rest = divmod(round(float(x) * step) + micros, _DAY)
        out.append((*date_of(start + days, calendar), rest))
    try:
        return [dt.datetime(y, m, d) + dt.timedelta(microseconds=rest) for y, m, d, rest in out]
    except ValueError:
        return [f"{y:04d}-{m:02d}-{d:02d} {rest // 3_600_000_000:02d}:{rest // 60_000_000 % 60:02d}:{rest % 60_000_000 / 1e6:09.6f}".removesuffix(".000000") for y, m, d, rest in out]


def _since(ref: dt.datetime) -> int:
    d = ref - dt.datetime(1970, 1, 1)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def decode_datetime(number: Column, units: str) -> Column:
    step, ref = parse_units(units)
    return F.timestamp_micros((F.round(number * F.lit(step)).cast("bigint") + F.lit(_since(ref))).cast("bigint"))


def encode_datetime(time: Column, units: str) -> Column:
    step, ref = parse_units(units)
    return (F.unix_micros(time) - F.lit(_since(ref))) / F.lit(step)


def encode_timedelta(delta: Column, unit: str) -> Column:
    """A day-time interval in a unit."""
    zero = F.timestamp_micros(F.lit(0).cast("bigint"))
    return F.unix_micros(zero + delta) / F.lit(MICROS[unit])


def infer_unit(times: Sequence[dt.datetime]) -> str:
    """The largest of days, hours, minutes and seconds that divides all differences."""
    deltas = [int((b - a).total_seconds() * 1_000_000) for a, b in zip(times, times[1:], strict=False)]
    return next(u for u in ("days", "hours", "minutes", "seconds", "milliseconds", "microseconds") if all(d % MICROS[u] == 0 for d in deltas))


def infer_datetime_units(times: Sequence[dt.datetime]) -> str:
    return f"{infer_unit(times)} since {times[0]:%Y-%m-%d %H:%M:%S}"
