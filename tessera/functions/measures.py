"""Measures over points as columns: lengths, angles, areas and coordinates.

A point is a pair of columns, or of a struct with x and y (and z). Spacing is (x, y) in mm a pixel. A measure that isn't
defined (no length, too few points, spacing not positive) is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def _hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def _scaled(p: Point, spacing: tuple[float, float]) -> Point:
    return p[0] * F.lit(float(spacing[0])), p[1] * F.lit(float(spacing[1]))


def _valid(spacing: tuple[float, float]) -> bool:
    return all(0 < s < float("inf") for s in spacing)


def _measured(spacing: tuple[float, float], value: Column) -> Column:
    return value if _valid(spacing) else F.lit(None).cast("double")


def length_mm(a: Point, b: Point, spacing: tuple[float, float] = (1, 1)) -> Column:
    return _measured(spacing, _hypot((a[0] - b[0]) * F.lit(float(spacing[0])), (a[1] - b[1]) * F.lit(float(spacing[1]))))


def angle_deg(a: Point, vertex: Point, b: Point) -> Column:
    """Angle at the vertex; 0 where an arm has no length."""
    ux, uy, vx, vy = a[0] - vertex[0], a[1] - vertex[1], b[0] - vertex[0], b[1] - vertex[1]
    lengths = _hypot(ux, uy) * _hypot(vx, vy)
    return F.when(lengths == 0, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ux * vx + uy * vy, lengths))))))


def cobb_deg(a1: Point, a2: Point, b1: Point, b2: Point) -> Column:
    """Angle of two lines, at most 90."""
    turn = F.degrees(F.abs(F.atan2(a2[1] - a1[1], a2[0] - a1[0]) - F.atan2(b2[1] - b1[1], b2[0] - b1[0]))) % 180
    return F.when(turn > 90, 180 - turn).otherwise(turn)


def dynamic_angle(a1: Point, a2: Point, b1: Point, b2: Point, spacing: tuple[float, float] = (1, 1)) -> Column:
    """struct<acute, reflex> of two lines after spacing; null where one has no length."""
    (ax, ay), (bx, by) = ((q[0] - p[0], q[1] - p[1]) for p, q in ((_scaled(a1, spacing), _scaled(a2, spacing)), (_scaled(b1, spacing), _scaled(b2, spacing))))
    lengths = _hypot(ax, ay) * _hypot(bx, by)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, lengths)))))
    acute = F.least(angle, 180 - angle)
    return F.when((lengths > 0) & F.lit(_valid(spacing)), F.struct(acute.alias("acute"), (360 - acute).alias("reflex")))


def deviation_mm(a: Point, b: Point, point: Point, spacing: tuple[float, float] = (1, 1)) -> Column:
    """Distance of a point from the line through a and b."""
    (ax, ay), (bx, by), (px, py) = (_scaled(p, spacing) for p in (a, b, point))
    return _measured(spacing, F.try_divide(F.abs((px - ax) * (by - ay) - (py - ay) * (bx - ax)), F.nullif(_hypot(bx - ax, by - ay), F.lit(0.0))))


def projected_on_line(point: Point, a: Point, b: Point) -> Column:
    """struct<x, y>: foot of the point on the line through a and b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    at = F.try_divide((point[0] - a[0]) * dx + (point[1] - a[1]) * dy, F.nullif((dx * dx + dy * dy).cast("double"), F.lit(0.0)))
    return F.when(at.isNotNull(), F.struct((a[0] + at * dx).alias("x"), (a[1] + at * dy).alias("y")))


def rectangle_area(a: Point, b: Point, spacing: tuple[float, float] = (1, 1)) -> Column:
    return _measured(spacing, F.abs(a[0] - b[0]) * F.abs(a[1] - b[1]) * F.lit(float(spacing[0] * spacing[1])))


def ellipse_area(a: Point, b: Point, spacing: tuple[float, float] = (1, 1)) -> Column:
    """Of the ellipse in the rectangle of two corners."""
    return rectangle_area(a, b, spacing) * F.pi() / 4


def polyline_length(points: Column, spacing: tuple[float, float] = (1, 1)) -> Column:
    """Length of an open line through an array of points."""
    legs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda p, q: length_mm((p["x"], p["y"]), (q["x"], q["y"]), spacing))
    return _measured(spacing, F.when(F.size(points) >= 2, F.aggregate(legs, F.lit(0.0), lambda s, v: s + v)))


def polygon_area(points: Column, spacing: tuple[float, float] = (1, 1)) -> Column:
    """Area within a closed line through an array of points."""
    following = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    return _measured(spacing, F.when(F.size(points) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2 * F.lit(float(spacing[0] * spacing[1]))))


def polygon_contains(points: Column, x: Column, y: Column) -> Column:
    """Is (x, y) inside a closed line, by the even-odd rule?"""
    following = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    crossed = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide((y - p["y"]).cast("double"), (q["y"] - p["y"]).cast("double")) + p["x"])
    hits = F.aggregate(F.zip_with(points, following, lambda p, q: F.coalesce(crossed(p, q), F.lit(False)).cast("int")), F.lit(0), lambda s, v: s + v)
    return (F.size(points) >= 3) & (hits % 2 == 1)


def _edges(points: Column, closed: bool) -> Column:
    following = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    following = F.concat(following, F.slice(points, 1, 1)) if closed else following
    return F.zip_with(F.slice(points, 1, F.size(following)), following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def polyline_meets(points: Column, low: Point, high: Point, closed: bool = False) -> Column:
    """Does a line of points touch the rectangle from low to high, its border included? One point alone may.

    A segment misses a rectangle if their extents are apart, or if all corners lie strictly on one side of it.
    """
    (x0, y0), (x1, y1) = low, high

    def touches(e: Column) -> Column:
        px, py, qx, qy = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        side = [(qx - px) * (y - py) - (qy - py) * (x - px) for x in (x0, x1) for y in (y0, y1)]
        near = (F.greatest(px, qx) >= x0) & (F.least(px, qx) <= x1) & (F.greatest(py, qy) >= y0) & (F.least(py, qy) <= y1)
        return near & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    return F.exists(points, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)) | F.exists(_edges(points, closed), touches)


def polygon_meets(points: Column, low: Point, high: Point) -> Column:
    """Do a closed line and a rectangle touch, cross, or hold one another?"""
    return (F.size(points) >= 3) & (polyline_meets(points, low, high, True) | polygon_contains(points, low[0], low[1]))


def sphere_slice_radius(radius: Column, offset: Column) -> Column:
    """Radius of the circle in which a plane at an offset cuts a sphere."""
    return F.when((radius >= 0) & (F.abs(offset) <= radius), F.sqrt(radius * radius - offset * offset))


def repulsed(points: Column, x: float, y: float, radius: float, strength: float) -> Column:
    """Points within the radius of (x, y) pushed away from it, less the farther they are; one at (x, y) itself goes to the right."""
    def moved(p: Column) -> Column:
        dx, dy = p["x"] - F.lit(float(x)), p["y"] - F.lit(float(y))
        far = _hypot(dx, dy)
        push = F.lit(float(strength)) * (1 - far / F.lit(float(radius)))
        step = lambda d, alone: F.when(far == 0, F.lit(alone) * push).otherwise(F.try_divide(d, far) * push)
        return F.when(far < radius, F.struct((p["x"] + step(dx, 1.0)).alias("x"), (p["y"] + step(dy, 0.0)).alias("y"))).otherwise(F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))

    return F.transform(points, moved)


def world_distance(a: Column, b: Column) -> Column:
    return F.sqrt(reduce(lambda s, v: s + v, ((a[k] - b[k]) * (a[k] - b[k]) for k in "xyz")))


def world_angle(a: Column, vertex: Column, b: Column, acute: bool = False) -> Column:
    """Angle at the vertex in space; null where an arm has no length."""
    dot = reduce(lambda s, v: s + v, ((a[k] - vertex[k]) * (b[k] - vertex[k]) for k in "xyz"))
    lengths = world_distance(a, vertex) * world_distance(b, vertex)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, F.nullif(lengths, F.lit(0.0)))))))
    return F.least(angle, 180 - angle) if acute else angle


def affine(x: Column, y: Column, z: Column, matrix: list[float]) -> Column:
    """struct<x, y, z> of a point under a matrix of 4 x 4 numbers, row by row."""
    row = lambda k: x * F.lit(float(matrix[4 * k])) + y * F.lit(float(matrix[4 * k + 1])) + z * F.lit(float(matrix[4 * k + 2])) + F.lit(float(matrix[4 * k + 3]))
    return F.struct(*(row(k).alias(name) for k, name in enumerate("xyz")))


def inverse_affine(matrix: list[float]) -> list[float]:
    """The matrix that takes points back."""
    import numpy as np

    m = np.array(matrix, float).reshape(4, 4)
    if abs(np.linalg.det(m)) < 1e-12:
        raise ValueError("the matrix has no inverse")
    return np.linalg.inv(m).ravel().tolist()


def corrected_alpha(alpha: Column, scale: Column, distance: Column, unit: Column) -> Column:
    """Opacity of a sample at another distance than the one it is given for."""
    one = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha * F.when(scale > 0, scale).otherwise(0.0)))
    steps = F.when((distance > 0) & (unit > 0), distance / unit).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow(1 - one, steps)))


Frame = tuple[tuple[float, float, float], tuple[float, ...], tuple[float, float]]
"""Origin, directions of a row and of a column (six numbers, or all 0 for the axes) and spacing along both."""


def _directions(orientation: tuple[float, ...]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    row, column = orientation[:3], orientation[3:]
    return (row, column) if any(row) and any(column) else ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))


def slide_point(x: Column, y: Column, frame: Frame, z: float = 0.0) -> Column:
    """The struct (x, y, z) of a pixel in the coordinates of the slide, or null without a positive spacing."""
    origin, orientation, spacing = frame
    row, column = _directions(orientation)
    at = [x * (spacing[0] * r) + y * (spacing[1] * c) + o for r, c, o in zip(row, column, (*origin[:2], origin[2] + z), strict=True)]
    return F.when(F.lit(_valid(spacing)), F.struct(*(v.alias(n) for v, n in zip(at, "xyz", strict=True))))


def slide_pixel(point: Column, frame: Frame) -> Column:
    """The struct (x, y) of the pixel, with fractions, of a point of the slide, or null without a positive spacing."""
    origin, orientation, spacing = frame
    d = [point[n] - o for n, o in zip("xyz", origin, strict=True)]
    along = [(d[0] * v[0] + d[1] * v[1] + d[2] * v[2]) / F.nullif(F.lit(float(s)), F.lit(0.0)) for v, s in zip(_directions(orientation), spacing, strict=True)]
    return F.when(F.lit(_valid(spacing)), F.struct(along[0].alias("x"), along[1].alias("y")))
