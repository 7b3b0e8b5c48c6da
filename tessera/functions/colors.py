"""Colours of segments: 8-bit sRGB to the 16-bit words of CIELab under D50, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ under D65 and back, the Bradford adaptation of XYZ to D50 and back, the white of D50 (fixed values).
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
TO_D50 = ((1.0479298, 0.0229468, -0.0501922), (0.0296278, 0.9904345, -0.0170738), (-0.0092430, 0.0150552, 0.7518743))
TO_D65 = ((0.9554734, -0.0230985, 0.0632593), (-0.0283697, 1.0099955, 0.0210414), (0.0123140, -0.0205077, 1.3303659))
WHITE = (0.96422, 1.0, 0.82521)
#: Ends of L, a and b, which the words 0 and 65535 stand for (fixed values).
ENDS = ((0.0, 100.0), (-128.0, 127.0), (-128.0, 127.0))
BEND = 6 / 29


def _times(matrix: tuple, v: list[Column]) -> list[Column]:
    return [sum((x * m for x, m in zip(v[1:], row[1:], strict=True)), v[0] * row[0]) for row in matrix]


def _clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lab_words(r: Column, g: Column, b: Column) -> Column:
    """A struct (l, a, b) of words 0 to 65535; channels beyond 0 to 255 are brought to the nearer end. Null if one is null."""
    unit = [F.when(c.isNotNull(), _clamped(c.cast("double"), 0.0, 255.0)) / 255 for c in (r, g, b)]
    linear = [F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4))) for u in unit]
    xyz = [v / w for v, w in zip(_times(TO_D50, _times(TO_XYZ, linear)), WHITE, strict=True)]
    fx, fy, fz = (F.when(v > BEND**3, F.cbrt(v)).otherwise(v / (3 * BEND**2) + F.lit(4 / 29)) for v in xyz)
    words = [F.round((_clamped(v, low, high) - low) * 65535 / (high - low)).cast("int") for v, (low, high) in zip((fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200), ENDS, strict=True)]
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.struct(*(w.alias(n) for w, n in zip(words, "lab", strict=True))))


def rgb_of_words(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """A struct (r, g, b) of 8-bit sRGB of the three words."""
    lab = [c.cast("double") * (high - low) / 65535 + low for c, (low, high) in zip((l, a, b), ENDS, strict=True)]
    fy = (lab[0] + 16) / 116
    xyz = [F.when(f > BEND, f * f * f).otherwise((f - F.lit(4 / 29)) * (3 * BEND**2)) * w for f, w in zip((fy + lab[1] / 500, fy, fy - lab[2] / 200), WHITE, strict=True)]
    linear = [_clamped(v, 0.0, 1.0) for v in _times(FROM_XYZ, _times(TO_D65, xyz))]
    shown = [F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055) for v in linear]
    return F.struct(*(F.round(v * 255).cast("int").alias(n) for v, n in zip(shown, "rgb", strict=True)))
