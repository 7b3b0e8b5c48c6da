"""Texts in bytes of declared character sets, with code extensions, to text; what is wrong comes beside it.

A declaration is a text of codes parted by backslashes. One code is a character set of its own; several are code
extensions (ISO 2022): the first, which may be empty for ASCII, is how each value begins, and escape sequences
designate the others for bytes below 128 (G0) or above (G1). A value must go back to its beginning before a delimiter, a
line's control character and its end.

`decoded` gives struct<text, finding, offset>: of a text that can't be decoded the text is null, and the finding says why:

    declaration   the declaration isn't one
    escape        an escape sequence is unknown, not declared, cut off, or stands in the first group of a name
    unreturned    the first character set isn't restored at a delimiter or at the end
    bytes         bytes that are no characters, or control characters that no text may have

ASCII, Latin 1 and UTF-8 are decoded by Spark itself; only other texts go through Python, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of single character sets and of those that extensions designate in G1, with Python's name of each (fixed values).
SINGLE = {"IR 100": "latin_1", "IR 101": "iso8859_2", "IR 109": "iso8859_3", "IR 110": "iso8859_4", "IR 126": "iso8859_7", "IR 127": "iso8859_6", "IR 138": "iso8859_8", "IR 144": "iso8859_5", "IR 148": "iso8859_9", "IR 166": "iso8859_11"}
ALONE = {"": "ascii", "ISO_IR 6": "ascii", "ISO_IR 192": "utf_8", "GB18030": "gb18030", "GBK": "gbk", "ISO_IR 13": "jis_x0201", **{f"ISO_{k}": v for k, v in SINGLE.items()}}
#: Escape sequences by the code that allows them: where they designate, and what (fixed values).
ESCAPES = {
    "IR 6": ((b"\x1b(B", 0, "ascii"),), "IR 13": ((b"\x1b(J", 0, "roman"), (b"\x1b)I", 1, "kana")), "IR 87": ((b"\x1b$B", 0, "jis_x0208"),), "IR 159": ((b"\x1b$(D", 0, "jis_x0212"),), "IR 149": ((b"\x1b$)C", 1, "euc_kr"),), "IR 58": ((b"\x1b$)A", 1, "gb2312"),),
    **{code: ((b"\x1b-" + final, 1, SINGLE[code]),) for code, final in (("IR 100", b"A"), ("IR 101", b"B"), ("IR 109", b"C"), ("IR 110", b"D"), ("IR 126", b"F"), ("IR 127", b"G"), ("IR 138", b"H"), ("IR 144", b"L"), ("IR 148", b"M"), ("IR 166", b"T"))},
}
DOUBLE = ("jis_x0208", "jis_x0212", "euc_kr", "gb2312")
#: Representations in which a backslash is text (fixed values).
WHOLE_TEXT = ("ST", "LT", "UT", "UR")
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("finding", T.StringType()), T.StructField("offset", T.IntegerType())])


class _Bad(ValueError):
    def __init__(self, finding: str, offset: int = 0):
        self.finding, self.offset = finding, offset


def codes_of(declaration: str | None) -> list[str]:
    """The codes of a declaration; ValueError if it isn't one."""
    codes = [" ".join(c.replace("\0", " ").upper().split()) for c in (declaration or "").split("\\")]
    if len(codes) == 1:
        code = codes[0].replace("ISO IR", "ISO_IR")
        if code not in ALONE:
            raise _Bad("declaration")
        return [code]
    codes[0] = codes[0] or "ISO 2022 IR 6"
    names = [c.removeprefix("ISO 2022 ") for c in codes]
    if any(c == n or n not in ESCAPES for c, n in zip(codes, names, strict=True)) or names[0] not in ("IR 6", "IR 13", *SINGLE):
        raise _Bad("declaration")
    return names


def _roman(data: bytes) -> str:
    return data.decode("ascii").replace("\\", "¥").replace("~", "‾")


def _character(data: bytes, of: str) -> str:
    """One character of a designated set; ValueError if it is none."""
    if of == "ascii":
        return data.decode("ascii")
    if of == "roman":
        return _roman(data)
    if of == "kana":
        if not 0xA1 <= data[0] <= 0xDF:
            raise ValueError
        return data.decode("shift_jis")
    if of in ("jis_x0208", "jis_x0212"):
        high = bytes(b | 0x80 for b in data)
        return (high if of == "jis_x0208" else b"\x8f" + high).decode("euc_jp")
    return data.decode(of)


def _extended(data: bytes, codes: list[str], name: bool, several: bool) -> str:
    known = {e: (area, of) for code in dict.fromkeys([*codes, "IR 6"]) for e, area, of in ESCAPES[code]}
    start = {area: of for _, area, of in ESCAPES[codes[0]]}
    first = [start.get(0, "ascii"), start.get(1)]
    now, out, at, group = list(first), [], 0, 0
    resets = {*b"\t\n\f\r", *(b"\\" if several else b""), *(b"^=" if name else b"")}

    def returned() -> None:
        if now[0] != first[0] or first[1] and now[1] != first[1]:
            raise _Bad("unreturned", at)

    while at < len(data):
        b = data[at]
        double = now[b >= 0x80] in DOUBLE and b not in (0x1B, 0x20) and (b >= 0x80 or b > 0x20)
        if b == 0x1B:
            escape = next((e for e in known if data.startswith(e, at)), None)
            if escape is None or name and group == 0:
                raise _Bad("escape", at)
            area, of = known[escape]
            now[area] = of
            at += len(escape)
        elif b in resets:
            returned()
            out.append(chr(b))
            now = list(first)
            group += name and b == 0x3D
            at += 1
        elif b < 0x20 or b == 0x7F or 0x80 <= b < 0xA0 or b >= 0x80 and now[1] is None:
            raise _Bad("bytes", at)
        elif b == 0x20:
            out.append(" ")
            at += 1
        else:
            size = 2 if double else 1
            try:
                if at + size > len(data):
                    raise ValueError
                out.append(_character(data[at : at + size], now[b >= 0x80]))
            except ValueError:
                raise _Bad("bytes", at) from None
            at += size
    returned()
    return "".join(out)


def decode_text(data: bytes, declaration: str | None, vr: str) -> tuple[str | None, str | None, int | None]:
    """(text, finding, offset) of one value in bytes."""
    try:
        codes = codes_of(declaration)
        if len(codes) > 1:
            return _extended(data, codes, vr == "PN", vr not in WHOLE_TEXT), None, None
        of = ALONE[codes[0]]
        try:
            if of != "jis_x0201":
                return data.decode(of), None, None
            kana = "".join(_character(bytes([b]), "kana" if b >= 0x80 else "roman") for b in data)
            return (kana if vr in WHOLE_TEXT else kana.replace("¥", "\\")), None, None
        except UnicodeDecodeError as e:
            raise _Bad("bytes", e.start) from None
        except ValueError:
            raise _Bad("bytes", next(k for k, b in enumerate(data) if b >= 0x80 and not 0xA1 <= b <= 0xDF)) from None
    except _Bad as e:
        return None, e.finding, e.offset


@F.pandas_udf(DECODED)
def _decoded(data: pd.Series, declaration: pd.Series, vr: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if d is None else decode_text(d, c, v) for d, c, v in zip(data, declaration, vr, strict=True)]
    return pd.DataFrame(rows, columns=["text", "finding", "offset"]).astype({"text": object, "finding": object, "offset": "Int32"})


def decoded(data: Column, declaration: Column, vr: Column) -> Column:
    """struct<text, finding, offset> of values in bytes; null for null. A null declaration is ASCII, a null representation one that takes several values."""
    code = F.regexp_replace(F.upper(F.trim(F.coalesce(declaration, F.lit("")))), r"[ _]+", " ")
    plain = lambda text: F.struct(text.alias("text"), F.lit(None).cast("string").alias("finding"), F.lit(None).cast("int").alias("offset"))
    ascii_ = code.isin("", "ISO IR 6") & ~F.hex(data).rlike("^(..)*[89A-F]")
    utf8 = (code == "ISO IR 192") & F.is_valid_utf8(data.cast("string"))
    latin = code == "ISO IR 100"
    other = F.when(~(ascii_ | utf8 | latin), data)
    return (
        F.when(data.isNull(), F.lit(None)).when(ascii_ | utf8, plain(data.cast("string"))).when(latin, plain(F.decode(F.when(latin, data), "ISO-8859-1")))
        .otherwise(_decoded(other, declaration, F.coalesce(vr, F.lit("LO"))))
    )
