"""Tags of elements: texts such as 00100020, (0010,0020) or 0010,0020, and numbers that sort by group and element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})$"
PAIR = r"^(?:\(\s*([0-9A-Fa-f]{1,4})\s*,\s*([0-9A-Fa-f]{1,4})\s*\)|([0-9A-Fa-f]{1,4})\s*,\s*([0-9A-Fa-f]{1,4}))$"


def tag_number(text: Column) -> Column:
    """group * 65536 + element, or null if the text is no tag."""
    t = F.trim(text)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    hex_ = lambda c: F.conv(c, 16, 10).cast("long")
    either = lambda k: F.when(part(PAIR, k) != "", part(PAIR, k)).otherwise(part(PAIR, k + 2))
    return F.when(t.rlike(PLAIN), hex_(t)).when(t.rlike(PAIR), hex_(either(1)) * 65536 + hex_(either(2)))


def tag_text(number: Column) -> Column:
    """The eight digits of a tag, in capitals."""
    return F.lpad(F.hex(number), 8, "0")


def is_private(number: Column) -> Column:
    """Tags of odd groups are private."""
    return F.shiftright(number, 16) % 2 == 1
