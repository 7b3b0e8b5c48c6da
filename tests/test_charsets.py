"""Texts of declared character sets against Python's codecs, and bytes that are none."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.charsets import codes_of, decode_text, decoded

GOOD = [
    (b"plain", None, "LO", "plain"), ("Äé".encode("latin_1"), "ISO_IR 100", "LO", "Äé"), ("Łódź".encode("iso8859_2"), "ISO_IR 101", "LO", "Łódź"), ("Дмитрий".encode("iso8859_5"), "ISO_IR 144", "PN", "Дмитрий"), ("山田".encode(), " iso_ir 192 ", "LO", "山田"),
    ("王^小东".encode("gb18030"), "GB18030", "PN", "王^小东"), ("ﾔﾏﾀﾞ".encode("shift_jis") + b"\\~", "ISO_IR 13", "LO", "ﾔﾏﾀﾞ\\‾"),
    (b"Yamada^Tarou=" + "山田".encode("iso2022_jp") + b"^" + "太郎".encode("iso2022_jp") + b"=" + "やまだ".encode("iso2022_jp"), "\\ISO 2022 IR 87", "PN", "Yamada^Tarou=山田^太郎=やまだ"),
    (b"Hong^Gildong=\x1b$)C" + "洪".encode("euc_kr") + b"^\x1b$)C" + "吉洞".encode("euc_kr"), "\\ISO 2022 IR 149", "PN", "Hong^Gildong=洪^吉洞"),
    (b"\x1b$(D" + bytes(b & 0x7F for b in "丂".encode("euc_jp")[1:]) + b"\x1b(B\\b", "ISO 2022 IR 6\\ISO 2022 IR 159", "LO", "丂\\b"),
    ("Ä".encode("latin_1") + b"\x1b-F" + "λ".encode("iso8859_7") + b"\x1b-A", "ISO 2022 IR 100\\ISO 2022 IR 126", "LO", "Äλ"), (b"\x1b$)A" + "王".encode("gb2312"), "\\ISO 2022 IR 58", "LO", "王"), (b"a\\b", "\\ISO 2022 IR 87", "ST", "a\\b"),
]
BAD = [
    (b"\xff", None, "LO", "bytes", 0), (b"ab\xff", "ISO_IR 192", "LO", "bytes", 2), (b"a\x1b$Bx", "\\ISO 2022 IR 6", "LO", "escape", 1), (b"a\x1b$", "\\ISO 2022 IR 87", "LO", "escape", 1), (b"\x1b$B%$\x1b(B", "\\ISO 2022 IR 87", "PN", "escape", 0),
    (b"\x1b$B%$", "\\ISO 2022 IR 87", "LO", "unreturned", 5), (b"\x1b$B%$\\a", "\\ISO 2022 IR 87", "LO", "unreturned", 5), (b"\x1b$B%$\na", "\\ISO 2022 IR 87", "LO", "unreturned", 5), (b"a\xe4", "\\ISO 2022 IR 87", "LO", "bytes", 1), (b"\x1b$B%", "\\ISO 2022 IR 87", "LO", "bytes", 3), (b"a\x07", "\\ISO 2022 IR 87", "LO", "bytes", 1),
    (b"a", "ISO 2022 IR 87", "LO", "declaration", 0), (b"a", "ISO_IR 100\\ISO 2022 IR 87", "LO", "declaration", 0), (b"a", "ISO 2022 IR 87\\ISO 2022 IR 6", "LO", "declaration", 0), (b"a", "\\ISO 2022 IR 87\\", "LO", "declaration", 0), (b"\x80", "ISO_IR 13", "LO", "bytes", 0),
]


@pytest.mark.parametrize("data,code,vr,text", GOOD)
def test_good(data, code, vr, text):
    assert decode_text(data, code, vr) == (text, None, None)


@pytest.mark.parametrize("data,code,vr,finding,offset", BAD)
def test_bad(data, code, vr, finding, offset):
    assert decode_text(data, code, vr) == (None, finding, offset)


def test_columns(spark):
    rows = [(k, *g[:3]) for k, g in enumerate(GOOD)] + [(100 + k, *b[:3]) for k, b in enumerate(BAD)] + [(200, None, "ISO_IR 87", "LO"), (201, b"", None, None)]
    df = spark.createDataFrame(rows, "k int, data binary, code string, vr string").withColumn("d", decoded(F.col("data"), F.col("code"), F.col("vr")))
    found = {r.k: r.d for r in df.collect()}
    assert all(tuple(found[k]) == decode_text(d, c, v or "LO") for k, d, c, v in rows if d is not None)
    assert found[200] is None and found[201].text == ""
    assert codes_of("ISO IR 100") == ["ISO_IR 100"]
