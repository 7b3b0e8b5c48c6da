"""Query by identifier: keys of an identifier compiled into one predicate, with level de-duplication, projection and paging.

All keys must match. An empty key matches everything. Several values match if any does. Names compare without regard to
case, other text exactly; * and ? are wildcards in text. Dates and times are windows by their precision and overlap, or
ranges a-b, a-, -b. A sequence key is matched by one item that satisfies all keys of the query's item. Keys of columns
that the table lacks are ignored and reported; control keys constrain nothing. A null candidate matches only an empty key.

Keys are checked before any row is read: wildcards, malformed values and reversed ranges in dates and times are errors.
Predicates compare the column itself with literals wherever its type allows, so they reach the scan of a Parquet table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import combined_between, key_window, moved, time_window, window

#: Value representations in which * and ? are wildcards (fixed values).
WILDCARD = ("AE", "CS", "LO", "LT", "PN", "SH", "ST", "UC", "UR", "UT")
TEMPORAL = ("DA", "TM", "DT")
#: Keys that say how to answer, not what to find (fixed values).
CONTROL = ("QueryRetrieveLevel", "RetrieveAETitle", "SpecificCharacterSet", "00080052", "00080054", "00080005")
WHOLE = ("tinyint", "smallint", "int", "bigint")


class InvalidQuery(ValueError):
    """The identifier can't be a query."""


class TooManyMatches(RuntimeError):
    """More rows match than the caller allows."""


@dataclass(frozen=True)
class Key:
    """A key: column, value representation and values; a sequence key has items (each a tuple of keys on its fields) instead.

    `several` says that a text of the column may hold several values, parted by backslashes; a column of arrays always may.
    """

    column: str
    vr: str
    values: tuple[str, ...] = ()
    items: tuple[tuple[Key, ...], ...] = ()
    several: bool = False


@dataclass(frozen=True)
class Profile:
    """How a service compares: which representations ignore case, and whether a query without any constraint finds nothing."""

    ignore_case: tuple[str, ...] = ("PN",)
    needs_key: bool = False


IDENTIFIER = Profile()
WORKFLOW = Profile(ignore_case=("CS",), needs_key=True)
WORKLIST = Profile(ignore_case=("PN",), needs_key=True)


def glob(pattern: str, ignore_case: bool = False) -> str:
    """A regular expression that matches all of a text as the wildcard pattern does."""
    parts = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and not c.isspace() and c.isascii() else c for c in pattern)
    return f"^(?s{'iu' if ignore_case else ''}){parts}\\z"  # u: letters beyond ASCII have cases too


def _trimmed(vr: str, value: str) -> str:
    if vr == "UI":
        return value.rstrip("\0 ")
    value = value.strip(" ")
    return value.rstrip("^") if vr == "PN" else value


def _range(vr: str, value: str) -> tuple:
    """(first, last) instant that a key allows; either may be None. DA and DT give datetimes, TM microseconds of the day."""
    if "*" in value or "?" in value:
        raise InvalidQuery(f"no wildcards in dates and times: {value}")
    ends = [v.strip() for v in value.split("-")]
    if len(ends) > 2 or len(ends) == 2 and not any(ends):
        raise InvalidQuery(f"not a range: {value}")
    windows = [key_window(vr, v) if v else None for v in ends]
    if any(v and w is None for v, w in zip(ends, windows, strict=True)):
        raise InvalidQuery(f"not a {vr} value: {value}")
    first, last = windows[0] and windows[0][0], windows[-1] and windows[-1][1]
    if first is not None and last is not None and first > last:
        raise InvalidQuery(f"a range that ends before it starts: {value}")
    return first, last


def _temporal(candidate: Column, vr: str, value: str, kind: str) -> Column:
    first, last = _range(vr, value)
    if kind == "string":
        own = time_window(candidate) if vr == "TM" else window(candidate)
        low, high, literal = own["lo"], own["hi"], (lambda v: F.lit(v)) if vr == "TM" else (lambda v: F.lit(v).cast("timestamp_ntz"))
        inside = [*([high >= literal(first)] if first is not None else []), *([low <= literal(last)] if last is not None else [])]
    elif vr == "TM":
        at = F.hour(candidate).cast("long") * 3_600_000_000 + F.minute(candidate).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), candidate) * 1_000_000).cast("long")
        inside = [*([at >= F.lit(first)] if first is not None else []), *([at <= F.lit(last)] if last is not None else [])]
    else:
        # the next instant after the last one, so that the column stands alone
        of = lambda v: F.lit(v.date()) if kind == "date" else F.lit(v).cast(kind)
        day = lambda v: v.replace(hour=0, minute=0, second=0, microsecond=0)
        start = first and (day(first) if vr == "DA" else first)
        end = last and (moved(day(last), timedelta(days=1)) if vr == "DA" or kind == "date" else moved(last, timedelta(microseconds=1)))
        if end == datetime.max:  # the last day or instant there is bounds nothing
            end = None
        inside = [*([candidate >= of(start)] if first is not None else []), *([candidate < of(end)] if end is not None else [])]
        if not inside:
            return candidate.isNotNull()
    return reduce(lambda a, b: a & b, inside)


def _value(candidate: Column, vr: str, value: str, profile: Profile, kind: str) -> Column:
    if vr in TEMPORAL:
        return _temporal(candidate, vr, value, kind)
    if kind in WHOLE and not any(c in value for c in "*?"):
        return candidate == F.lit(int(value)) if value.lstrip("-").isdecimal() else F.lit(False)
    fold = vr in profile.ignore_case
    if vr in WILDCARD and ("*" in value or "?" in value):
        start = value.rstrip("*")
        if not fold and "*" not in start and "?" not in start:
            return candidate.startswith(start)
        return candidate.rlike(glob(value, fold))
    own = F.rtrim(candidate.cast("string"))
    if fold:
        return F.upper(own) == value.upper()
    return own == value


def _key(key: Key, candidate: Column, profile: Profile, kind: str) -> Column:
    if key.items:
        def item(i: tuple[Key, ...]) -> Column:
            return F.exists(candidate, lambda c: reduce(lambda a, b: a & b, (_key(k, c[k.column], profile, "string") for k in i), F.lit(True)))

        return reduce(lambda a, b: a & b, map(item, key.items))
    values = [v for v in (_trimmed(key.vr, v) for v in key.values) if v]
    if not values:
        return F.lit(True)
    if kind.startswith("array") or key.several and kind == "string":
        each = candidate if kind.startswith("array") else F.transform(F.split(candidate, r"\\"), lambda v: F.trim(v))
        inner = kind[6:-1] if kind.startswith("array") else "string"
        return F.exists(each, lambda v: _key(Key(key.column, key.vr, key.values), v, profile, inner))
    if key.vr == "UI":
        if kind in WHOLE:
            return candidate.isin([int(v) for v in values if v.isdecimal()])
        return F.rtrim(F.translate(candidate.cast("string"), "\0", " ")).isin(values)
    found = reduce(lambda a, b: a | b, (_value(candidate, key.vr, v, profile, kind) for v in values))
    starts = [re.split(r"[*?]", v)[0] if key.vr in WILDCARD else v for v in values]
    if kind == "string" and key.vr not in (*TEMPORAL, *profile.ignore_case) and all(starts):
        # how the text must start, which a scan understands, beside the exact predicate
        found = reduce(lambda a, b: a | b, map(candidate.startswith, starts)) & found
    return found


def matches(df: DataFrame, keys: list[Key], profile: Profile = IDENTIFIER) -> tuple[DataFrame, list[str]]:
    """(rows that match, columns of the keys that were ignored)."""
    keys = [k for k in keys if k.column not in CONTROL]
    ignored = [k.column for k in keys if k.column not in df.columns]
    known = [k for k in keys if k.column in df.columns]
    constrains = any(k.items or any(_trimmed(k.vr, v) for v in k.values) for k in known)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    conditions = [_key(k, F.col(k.column), profile, kinds[k.column]) for k in known]
    if profile.needs_key and not constrains:
        return df.limit(0), ignored
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True))), ignored


def with_item(parents: DataFrame, children: DataFrame, on: list[str], keys: list[Key], profile: Profile = IDENTIFIER) -> DataFrame:
    """Parents one of whose children matches all keys, for items kept in a table of their own: the keys filter the children first."""
    return parents.join(matches(children, keys, profile)[0].select(*on), on, "left_semi")


def with_scheduled_step(parents: DataFrame, steps: DataFrame, on: list[str], keys: list[Key], date: str, time: str, dates: str = "", times: str = "") -> DataFrame:
    """Parents with a scheduled step that matches all keys (by the worklist's profile) and starts within the dates and times.

    date and time are texts (YYYYMMDD, HHMM and finer). Where both keys are ranges they are one, from the first date and
    time to the last; otherwise each constrains by itself. An empty key matches everything, as no keys at all do. Keys of the
    step are met by one and the same step, and filter the steps before any is joined.
    """
    alone = [Key(c, vr, (v,)) for c, vr, v in ((date, "DA", dates), (time, "TM", times)) if v.strip() and not ("-" in dates and "-" in times)]
    both = [*keys, *alone]
    constrains = any(k.items or any(_trimmed(k.vr, v) for v in k.values) for k in both)
    found = matches(steps, both, WORKLIST)[0] if constrains else steps
    if "-" in dates and "-" in times:
        # malformed keys are errors before any row is read; the last time may be earlier in its day than the first
        _range("DA", dates)
        for end in filter(None, map(str.strip, times.split("-"))):
            _range("TM", end)
        found = found.where(combined_between(F.col(date), F.col(time), dates.strip(), times.strip()))
    return parents.join(found.select(*on), on, "left_semi")


def one_per_level(df: DataFrame, level: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of each entity of a level."""
    at = Window.partitionBy(*level).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for; those that the table lacks are empty texts."""
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns))


@dataclass(frozen=True)
class Search:
    """A search with paging. `most` is a bound on the rows that match: exceeding it is an error, never a cut."""

    keys: list[Key]
    columns: list[str]
    level: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    most: int | None = None
    profile: Profile = IDENTIFIER

    def run(self, df: DataFrame) -> DataFrame:
        found, _ = matches(df, self.keys, self.profile)
        if self.level:
            found = one_per_level(found, self.level, self.order)
        if self.most is not None and found.limit(self.most + 1).count() > self.most:
            raise TooManyMatches(f"more than {self.most} rows match")
        if self.limit is not None or self.offset:
            found = found.orderBy(*self.order)
            found = found.offset(self.offset) if self.offset else found
            found = found.limit(self.limit) if self.limit is not None else found
        return projected(found, self.columns)
