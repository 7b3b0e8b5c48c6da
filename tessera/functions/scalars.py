"""Scalar functions over columns: person names, identifiers, pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_GROUPS = ("alphabetic", "ideographic", "phonetic")
NAME_PARTS = ("family", "given", "middle", "prefix", "suffix")


def person_name(text: Column) -> Column:
    """struct of up to 3 groups (split at =) of up to 5 components (split at ^); null for more groups or components. Absent parts are empty."""
    groups = F.split(text, "=", -1)

    def group(k: int) -> Column:
        parts = F.split(F.coalesce(F.get(groups, F.lit(k)), F.lit("")), r"\^", -1)
        return F.struct(*(F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(name) for i, name in enumerate(NAME_PARTS)))

    fits = (F.size(groups) <= len(NAME_GROUPS)) & F.forall(groups, lambda g: F.size(F.split(g, r"\^", -1)) <= len(NAME_PARTS))
    return F.when(fits, F.struct(*(group(k).alias(name) for k, name in enumerate(NAME_GROUPS))))


def is_uid(text: Column) -> Column:
    """A unique identifier: 3 to 64 bytes of numeric arcs without leading zeros, the first 0 to 2, the second at most 39 below 0 and 1."""
    return F.octet_length(text).between(3, 64) & text.rlike(r"^([01]\.([0-9]|[1-3][0-9])|2\.(0|[1-9][0-9]*))(\.(0|[1-9][0-9]*))*$")


def remapped_uid(text: Column, secret: str) -> Column:
    """A UID below 2.25, of 120 bits, that depends on the text and a secret alone, so tasks agree on it. An empty or null UID stays."""
    digest = F.sha2(F.concat(F.lit(secret), F.lit(":"), text), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(19,0)")
    number = (part(1) * F.lit(1 << 60).cast("decimal(19,0)") + part(16)).cast("decimal(38,0)").cast("string")
    return F.when(text.isNull() | (text == ""), text).otherwise(F.concat(F.lit("2.25."), number))


def normal_uid(text: Column) -> Column:
    """Without spaces and zero bytes at the end."""
    return F.regexp_replace(text, r"[ \x00]+$", "")


#: Representations whose text is one value, backslashes included (fixed values).
WHOLE_TEXT = ("ST", "LT", "UT", "UR")


def values_of(text: Column, vr: str) -> Column:
    """The values of a text: parted by backslashes, unless the representation is a text as a whole."""
    return F.array(text) if vr in WHOLE_TEXT else F.split(text, r"\\", -1)


def trimmed_text(text: Column, vr: str) -> Column:
    """Without the padding that the representation allows: trailing spaces, and leading ones where they mean nothing."""
    return normal_uid(text) if vr == "UI" else F.rtrim(text) if vr in WHOLE_TEXT else F.trim(text)


def name_display(text: Column) -> Column:
    """The first group with a name: its components in order, parted by single spaces. A text of too many parts is shown with all of them."""
    clean = F.trim(F.translate(text, "\0", ""))
    name = person_name(clean)
    shown = lambda parts: F.trim(F.regexp_replace(parts, r"\s+", " "))
    groups = [shown(F.concat_ws(" ", *(name[g][c] for c in NAME_PARTS))) for g in NAME_GROUPS]
    return F.when(name.isNull(), shown(F.translate(clean, "=^", "  "))).otherwise(F.coalesce(*(F.nullif(g, F.lit("")) for g in groups), F.lit("")))


def name_text(name: Column) -> Column:
    """The text of a name of `person_name`, without empty parts at its end."""
    group = lambda g: F.regexp_replace(F.concat_ws("^", *(name[g][c] for c in NAME_PARTS)), r"\^+$", "")
    return F.regexp_replace(F.concat_ws("=", *map(group, NAME_GROUPS)), "=+$", "")


def rescaled(raw: Column, slope: float, intercept: float) -> Column:
    return raw * F.lit(float(slope)) + F.lit(float(intercept))


def looked_up(raw: Column, first: int, table: list[float]) -> Column:
    """The value of a table for a raw one; what is beyond its ends takes the value there."""
    at = F.greatest(F.lit(0), F.least(F.lit(len(table) - 1), F.floor(raw + F.lit(0.5)).cast("int") - F.lit(first)))
    return F.get(F.array(*(F.lit(float(v)) for v in table)), at.cast("int"))


def exact_window_unit(value: Column, center: float, width: float) -> Column:
    """A line from 0 to 1 over the whole width; a step where there is none."""
    if width <= 0:
        return F.when(value > center, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(center - width / 2)) / F.lit(float(width))))


def sigmoid_window_unit(value: Column, center: float, width: float) -> Column:
    """A sigmoid from 0 to 1; a step where there is no width."""
    if width == 0:
        return F.when(value > center, 1.0).otherwise(0.0)
    return 1 / (1 + F.exp(-4 * (value - F.lit(float(center))) / F.lit(float(width))))


def display_byte(unit: Column) -> Column:
    """0 to 255 for a value of 0 to 1, halves up."""
    return F.floor(unit * 255 + F.lit(0.5)).cast("int")


def windowed(value: Column, center: float, width: float, low: float = 0.0, high: float = 255.0) -> Column:
    """Linear window of display values: low below it, high above, a line between. The width is at least 1."""
    if width < 1:
        raise ValueError("a linear window is at least 1 wide")
    left, right, span = center - 0.5 - (width - 1) / 2, center - 0.5 + (width - 1) / 2, max(width - 1, 1e-300)
    between = ((value - F.lit(center - 0.5)) / F.lit(span) + F.lit(0.5)) * F.lit(high - low) + F.lit(low)
    return F.when(value <= left, F.lit(low)).when(value > right, F.lit(high)).otherwise(between)


def padded(text: Column, pad: str = " ") -> Column:
    """text with one more character if its length in bytes is odd."""
    return F.when(F.octet_length(text) % 2 == 1, F.concat(text, F.lit(pad))).otherwise(text)


def window_coordinate(value: Column, center: Column, width: Column) -> Column:
    """Where a value lies in a window, from 0 to 1; a window without a positive finite width is that from 0 to 1."""
    valid = (width > 0) & ~F.isnan(width) & ~F.isnan(center) & (F.abs(width) < float("inf")) & (F.abs(center) < float("inf"))
    low, span = F.when(valid, center - width / 2).otherwise(0.0), F.when(valid, width).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span))
