"""Dates, times and date-times of partial precision as columns: the first and last instant that a text may mean.

DA is YYYY[MM[DD]], TM is HH[MM[SS[.F]]], DT is YYYY[MM[DD[HH[MM[SS[.F]]]]]], also with the older dotted dates; a DT may
end in an offset from UTC, +HHMM or -HHMM, and then means the instant in UTC. A text that is none of these, or no day of
the calendar, gives null. Windows end a microsecond before the next instant. Instants have no time zone (timestamp_ntz), so
they don't depend on the session's.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Digits of a date-time and the precision they give (fixed values).
GRAINS = {4: "year", 6: "month", 8: "day", 10: "hour", 12: "minute", 14: "second"}
DOTTED = r"^(\d{4})\.(\d{2})\.(\d{2})$"
OFFSET = r"([+-])(0\d|1[0-4])([0-5]\d)$"


def key_window(vr: str, text: str) -> tuple | None:
    """(first, last) of a DA, DT or TM value given in Python, as `window` and `time_window` give them of columns; None if it is malformed."""
    if vr == "TM":
        t = text.replace(":", "")
        if not re.fullmatch(r"([01]\d|2[0-3])([0-5]\d([0-5]\d(\.\d{1,6})?)?)?", t):
            return None
        whole, _, part = t.partition(".")
        first = sum(int(whole[k : k + 2]) * f for k, f in zip(range(0, len(whole), 2), (3600, 60, 1), strict=False)) * 1_000_000 + int(part.ljust(6, "0"))
        return first, first + (1 if part else 3600 * 10**6 // 60 ** (len(whole) // 2 - 1)) - 1
    offset = re.search(OFFSET, text) if vr == "DT" else None
    whole, _, part = re.sub(DOTTED, r"\1\2\3", text[: offset.start()] if offset else text).partition(".")
    grain = GRAINS.get(len(whole)) if whole.isascii() and whole.isdecimal() else None
    if grain is None or vr == "DA" and len(whole) > 8 or part and (grain != "second" or not re.fullmatch(r"\d{1,6}", part)) or text.endswith("."):
        return None
    try:
        first = datetime.strptime(whole + "00000101000000"[len(whole) :], "%Y%m%d%H%M%S")
    except ValueError:
        return None
    micro = timedelta(microseconds=1)
    if grain in ("year", "month"):
        months = first.year * 12 + first.month - 1 + (12 if grain == "year" else 1)
        last = datetime(months // 12, months % 12 + 1, 1) - micro if months < 120_000 else datetime.max
    else:
        last = first + (timedelta(**{f"{grain}s": 1}) - micro)
    first = first.replace(microsecond=int(part.ljust(6, "0")))
    last = first if part else last
    shift = timedelta(hours=int(offset[2]), minutes=int(offset[3])) * (1 if offset[1] == "-" else -1) if offset else timedelta()
    return moved(first, shift), moved(last, shift)


def moved(at: datetime, by: timedelta) -> datetime:
    """at, moved, but no further than Python's first and last instant."""
    try:
        return at + by
    except OverflowError:
        return datetime.max if by > timedelta() else datetime.min


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), OFFSET, ""), DOTTED, "$1$2$3")


def precision(text: Column) -> Column:
    """year, month, day, hour, minute, second or fraction; null for no such text."""
    digits = _digits(text)
    names = F.array(*map(F.lit, GRAINS.values()))
    n = F.length(digits)
    whole = F.when(digits.rlike(r"^(\d{4}|\d{6}|\d{8}|\d{10}|\d{12}|\d{14})$"), F.element_at(names, ((n - 2) / 2).cast("int")))
    return F.when(digits.rlike(r"^\d{14}\.\d{1,6}$"), F.lit("fraction")).otherwise(whole)


def window(text: Column) -> Column:
    """struct<lo, hi: timestamp_ntz, precision> of a DA or DT text; null if it is malformed."""
    digits = _digits(text)
    grain = precision(text)
    whole = F.split_part(digits, F.lit("."), F.lit(1))
    padded = F.concat(whole, F.substr(F.lit("00000101000000"), F.length(whole) + 1))
    start = F.call_function("try_to_timestamp", F.concat(padded, F.lit("Z")), F.lit("yyyyMMddHHmmssX"))
    offset = F.regexp_extract(F.trim(text), OFFSET, 0)
    seconds = F.when(offset == "", 0).otherwise((F.substring(offset, 2, 2).try_cast("long") * 3600 + F.substring(offset, 4, 2).try_cast("long") * 60) * F.when(offset.startswith("-"), 1).otherwise(-1))
    micros = F.rpad(F.split_part(digits, F.lit("."), F.lit(2)), 6, "0").cast("int")
    at = F.unix_micros(start)
    lo = F.when(grain == "fraction", at + micros).otherwise(at)
    day, steps = 86_400_000_000, {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
    first = F.try_to_date(F.substring(padded, 1, 8), "yyyyMMdd")
    months = F.when(grain == "year", 12).when(grain == "month", 1)
    last = F.unix_date(F.add_months(first, months)).cast("long") * day
    span = F.when(grain == "day", day)
    for name, step in steps.items():
        span = span.when(grain == name, step)
    hi = F.when(grain == "fraction", lo).otherwise(F.coalesce(last, lo + span) - 1)
    ntz = lambda us: F.timestamp_add("MICROSECOND", us + seconds * 1_000_000, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.when(grain.isNotNull() & lo.isNotNull(), F.struct(ntz(lo).alias("lo"), ntz(hi).alias("hi"), grain.alias("precision")))


def time_window(text: Column) -> Column:
    """struct<lo, hi: long> of a TM text, in microseconds of the day."""
    t = F.regexp_replace(F.trim(text), ":", "")
    ok = t.rlike(r"^([01]\d|2[0-3])([0-5]\d([0-5]\d(\.\d{1,6})?)?)?$")
    whole, part = F.split_part(t, F.lit("."), F.lit(1)), F.rpad(F.split_part(t, F.lit("."), F.lit(2)), 6, "0")
    at = lambda k: F.coalesce(F.when(F.length(whole) >= k + 1, F.substring(whole, k, 2).try_cast("long")), F.lit(0).cast("long"))
    lo = (at(1) * 3600 + at(3) * 60 + at(5)) * 1_000_000 + F.when(t.contains("."), part.try_cast("long")).otherwise(0)
    span = F.when(t.contains("."), 1).when(F.length(whole) == 2, 3_600_000_000).when(F.length(whole) == 4, 60_000_000).otherwise(1_000_000)
    return F.when(ok, F.struct(lo.alias("lo"), (lo + span - 1).alias("hi")))


def date_text(text: Column) -> Column:
    """A DA value as YYYY[MM[DD]], by its own precision; null if it is malformed."""
    w = window(text)
    form = lambda f: F.date_format(w["lo"], f)
    return F.when(w["precision"] == "year", form("yyyy")).when(w["precision"] == "month", form("yyyyMM")).when(w["precision"] == "day", form("yyyyMMdd"))


def date_display(text: Column) -> Column:
    """A DA value with dashes, by its own precision; another text as it is, cleaned of zero bytes and outer spaces."""
    clean = F.trim(F.translate(text, "\0", ""))
    return F.coalesce(F.rtrim(F.regexp_replace(date_text(clean), r"^(\d{4})(\d{2})?(\d{2})?$", "$1-$2-$3"), F.lit("-")), clean)


def time_display(text: Column) -> Column:
    """A TM value with colons, by its own precision; another text as it is, cleaned of zero bytes and outer spaces."""
    clean = F.trim(F.translate(text, "\0", ""))
    digits = F.regexp_replace(clean, ":", "")
    shown = F.regexp_replace(digits, r"^(\d{2})(\d{2})?(\d{2})?", "$1:$2:$3")
    return F.when(time_window(clean).isNotNull(), F.rtrim(shown, F.lit(":"))).otherwise(clean)


def shifted_text(text: Column, days: Column) -> Column:
    """A DA or DT text moved by whole days and written at its own precision; null if it is malformed or its precision can't show the move."""
    w = window(text)
    at = F.timestamp_add("DAY", days, w["lo"])
    rest = F.regexp_extract(F.trim(text), r"^\d{14}(\.\d{1,6})?", 1)
    forms = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss"}
    shown = F.when(w["precision"] == "fraction", F.concat(F.date_format(at, "yyyyMMddHHmmss"), rest))
    for grain, form in forms.items():
        shown = shown.when(w["precision"] == grain, F.date_format(at, form))
    return F.when((shown != F.trim(text)) | (days == 0), shown)


#: A time of a key, to the hour at least.
TIME = r"\d{2}(\d{2}(\d{2}(\.\d{1,6})?)?)?"


def combined_between(date: Column, time: Column, dates: str, times: str) -> Column:
    """Is a date (YYYYMMDD) with its time (HH, HHMM, HHMMSS, fraction) from the first date and time of two keys to the last?

    The keys are one value or a range, open at an end if that is empty. An end of dates without one of times is that day's
    start or end; what a time leaves out is zero. Null where the date or the time is missing.
    """
    if not (re.fullmatch(r"(\d{8})?(-(\d{8})?)?", dates) and re.fullmatch(rf"({TIME})?(-({TIME})?)?", times)):
        raise ValueError(f"not a range of dates and one of times: {dates!r}, {times!r}")
    ends = lambda text: text.split("-", 1) if "-" in text else (text, text)
    full = lambda text: text.replace(".", "").ljust(12, "0")
    (d0, d1), (t0, t1) = ends(dates.strip()), ends(times.strip())
    at = F.concat(F.trim(date), F.rpad(F.replace(F.trim(time), F.lit(".")), 12, "0"))
    inside = F.lit(True)
    if d0:
        inside &= at >= d0 + full(t0)
    if d1:
        inside &= at <= d1 + (full(t1) if t1 else "235959999999")
    return F.when(at.isNotNull(), inside)
