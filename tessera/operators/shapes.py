"""Shapes of masks: signed distances, shapes across a gap between slices, and simplified outlines."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checkpoints import checkpointed


def _envelope(heights: np.ndarray) -> np.ndarray:
    """min over q of (p - q)**2 + heights[q] for each place p: the lower envelope of parabolas, in one pass."""
    finite = np.flatnonzero(np.isfinite(heights))
    if not len(finite):
        return np.full(len(heights), np.inf)
    held, starts = [int(finite[0])], [-np.inf]
    for q in finite[1:].tolist():
        while True:
            p = held[-1]
            meet = (heights[q] - heights[p] + q * q - p * p) / (2 * (q - p))
            if meet > starts[-1]:
                break
            held.pop()
            starts.pop()
        held.append(q)
        starts.append(meet)
    at = np.arange(len(heights))
    best = np.array(held)[np.searchsorted(np.array(starts), at, "left") - 1]
    return (at - best) ** 2.0 + heights[best]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _squared(columns: pd.Series) -> pd.Series:
    """Squared distances along an array of squared distances across it, nulls being infinite."""
    return pd.Series([_envelope(np.array([np.inf if v is None else v for v in c], float)) for c in columns])


def signed_distances(mask: DataFrame, by: list[str], rows: int, columns: int, box: list[Column] | None = None) -> DataFrame:
    """(by, y, x, distance) of the pixels of a box: inside the mask how far the nearest pixel outside is, outside minus how far the nearest one inside is.

    mask has (by, y, x), and pixels beyond the image of `rows` x `columns` are no pixels. Without any such pixel the distance
    is the image's diagonal. The box (y0, x0, y1, x1, columns of the mask that are the same for all pixels of a group) is
    that of the mask without one; it must hold the mask.

    One pass goes along each row, by windows, and one along each column, by the lower envelope of parabolas, so a task
    holds a row or a column and no image.
    """
    near = F.array("y0", "x0", "y1", "x1") if box is None else F.array(*box)
    there = mask.where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns))
    boxed = there if box is not None else there.join(there.groupBy(*by).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1")), by)
    area = boxed.select(*by, near.alias("b")).distinct()
    # one pixel more on each side: the nearest pixel outside is never farther out than that
    low, high = (lambda k: F.greatest(F.lit(0), F.get("b", F.lit(k)) - 1)), (lambda k, n: F.least(F.lit(n - 1), F.get("b", F.lit(k)) + 1))
    dense = area.withColumn("y", F.explode(F.sequence(low(0), high(2, rows)))).withColumn("x", F.explode(F.sequence(low(1), high(3, columns))))
    flagged = dense.join(there.select(*by, "y", "x", F.lit(True).alias("in")).distinct(), [*by, "y", "x"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    w = Window.partitionBy(*by, "y")

    def along(flag: Column) -> Column:
        """Squared distance to the nearest pixel of the row that is flagged."""
        last = lambda order: F.last(F.when(flag, F.col("x")), ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        d = F.least(F.col("x") - last(F.col("x")), last(F.desc("x")) - F.col("x")).cast("double")
        return d * d

    across = flagged.select(*by, "b", "y", "x", "in", along(F.col("in")).alias("to_in"), along(~F.col("in")).alias("to_out"))
    each = across.groupBy(*by, "b", "x").agg(F.array_sort(F.collect_list(F.struct("y", "in", "to_in", "to_out"))).alias("c"))
    solved = each.select(*by, "b", "x", "c", _squared(F.col("c.to_in")).alias("i"), _squared(F.col("c.to_out")).alias("o"))
    pixels = solved.select(*by, "b", "x", F.explode(F.arrays_zip("c", "i", "o")).alias("p"))
    most = F.lit(float(np.hypot(columns, rows)))
    distance = F.when(F.col("p.c.in"), F.least(F.sqrt("p.o"), most)).otherwise(-F.least(F.sqrt("p.i"), most))
    inside = F.col("p.c.y").between(F.get("b", F.lit(0)), F.get("b", F.lit(2))) & F.col("x").between(F.get("b", F.lit(1)), F.get("b", F.lit(3)))
    return pixels.where(inside).select(*by, F.col("p.c.y").alias("y"), "x", distance.alias("distance"))


def _rounded(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.round(x, 0).cast("int")


def interpolated(mask: DataFrame, rows: int, columns: int) -> DataFrame:
    """(seg, z, y, x): the masks of the slices strictly between each two neighbouring slices (seg, z, y, x) of a segment.

    Both ends are stretched to the box between theirs, and a pixel is in where their signed distances, weighted by how near
    each end is, sum to zero or more. Slices that come out empty have no rows. All gaps of all segments are one plan.
    """
    pixels = mask.where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns)).select("seg", "z", "y", "x").distinct()
    boxes = pixels.groupBy("seg", "z").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    corners = ("y0", "x0", "y1", "x1")
    w = Window.partitionBy("seg").orderBy("z")
    gaps = boxes.withColumn("z_", F.lead("z").over(w)).withColumn("far", F.lead(F.struct(*corners)).over(w)).where("z_ - z >= 2")
    between = gaps.withColumn("at", F.explode(F.sequence(F.col("z") + 1, F.col("z_") - 1))).withColumn("t", (F.col("at") - F.col("z")) / (F.col("z_") - F.col("z")))
    target = between.select("seg", "at", "t", "z", "z_", *(_rounded(F.col(c) + (F.col(f"far.{c}") - F.col(c)) * F.col("t")).alias(f"to_{c}") for c in corners))
    ends = target.withColumn("end", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("z").alias("of")), F.struct(F.lit(1).alias("k"), F.col("z_").alias("of")))))
    ends = ends.select("seg", "at", "t", F.col("end.k").alias("k"), F.col("end.of").alias("z"), *(f"to_{c}" for c in corners)).join(boxes, ["seg", "z"])

    def moved(v: Column, c: str) -> Column:
        low, high, to, end = (F.col(n) for n in (f"{c}0", f"{c}1", f"to_{c}0", f"to_{c}1"))
        return F.when(low == high, _rounded((to + end) / 2)).otherwise(_rounded(to + (end - to) * ((v - low) / (high - low))))

    # runs are moved, not pixels, so that they have no gaps
    island = F.col("x") - F.row_number().over(Window.partitionBy("seg", "z", "y").orderBy("x"))
    runs = pixels.withColumn("i", island).groupBy("seg", "z", "y", "i").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    stretched = ends.join(runs, ["seg", "z"]).select("seg", "at", "t", "k", *(f"to_{c}" for c in corners), moved(F.col("y"), "y").alias("y"), F.explode(F.sequence(moved(F.col("a"), "x"), moved(F.col("b"), "x"))).alias("x"))
    by = ["seg", "at", "t", "k"]
    fields = signed_distances(stretched, by, rows, columns, [F.col(f"to_{c}") for c in corners])
    share = F.when(F.col("k") == 0, 1 - F.col("t")).otherwise(F.col("t"))
    sums = fields.groupBy("seg", "at", "y", "x").agg(F.sum(F.when(F.col("k") == 0, share * F.col("distance")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("k") == 1, share * F.col("distance")).otherwise(0.0)).alias("b"))
    return sums.where(F.col("a") + F.col("b") >= 0).select("seg", F.col("at").alias("z"), "y", "x")


def _turning(points: DataFrame, by: list[str]) -> DataFrame:
    """points (by, place, x, y) of closed outlines without those that lie straight between their neighbours, as long as more than three are left."""
    points = points.select(*by, "place", "x", "y")
    while True:
        w = Window.partitionBy(*by)
        first, last = (F.first(F.struct("x", "y")).over(w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.col("place"), F.desc("place")))
        near = points.withColumn("p", F.coalesce(F.lag(F.struct("x", "y")).over(w.orderBy("place")), last)).withColumn("q", F.coalesce(F.lead(F.struct("x", "y")).over(w.orderBy("place")), first)).withColumn("n", F.count("*").over(w))
        ax, ay, bx, by_ = F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y"), F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")
        straight = (F.col("n") > 3) & (ax * by_ - ay * bx == 0) & (ax * bx + ay * by_ >= 0)
        marked = checkpointed(near.select(*by, "place", "x", "y", straight.alias("out")))
        points = marked.where("NOT out").drop("out")
        if marked.where("out").isEmpty():
            return points


def _far_pair(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, second, n): the places of the two extreme points (leftmost, rightmost, top, bottom, the first of each) that are farthest apart."""
    point = F.struct("place", "x", "y")
    of = points.groupBy(*by).agg(F.count("*").alias("n"), *(F.min_by(point, F.struct(k, F.col("place"))).alias(f"e{i}") for i, k in enumerate((F.col("x"), -F.col("x"), F.col("y"), -F.col("y")))))
    apart = lambda a, b: (F.col(f"e{b}.x") - F.col(f"e{a}.x")) ** 2 + (F.col(f"e{b}.y") - F.col(f"e{a}.y")) ** 2
    pairs = [F.struct(F.when(F.col(f"e{a}.place") == F.col(f"e{b}.place"), -1.0).otherwise(apart(a, b)).alias("d"), F.lit(-k).alias("k"), F.col(f"e{a}.place").alias("first"), F.col(f"e{b}.place").alias("second")) for k, (a, b) in enumerate((a, b) for a in range(4) for b in range(4) if a != b)]
    return of.withColumn("f", F.greatest(*pairs)).select(*by, "n", F.col("f.first").alias("first"), F.when(F.col("f.d") > 0, F.col("f.second")).alias("second"))


def _from_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the segment between two points."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(square > 0, square)))
    off_x, off_y = x - (a["x"] + F.coalesce(t, F.lit(0.0)) * dx), y - (a["y"] + F.coalesce(t, F.lit(0.0)) * dy)
    return F.sqrt(off_x * off_x + off_y * off_y)


def simplified(points: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(by, place, x, y): closed outlines (by, place, x, y) with the fewer points that a polyline split at its farthest points keeps.

    An outline is cut at its two extreme points that are farthest apart. Level by level, all pieces of all outlines are
    split at the point farthest from the line between their ends (the first of several), as long as that is beyond the
    tolerance; pieces that aren't split leave the rounds, which are as many as the deepest split. Points that lie straight between their
    neighbours go first and last. With a tolerance of zero or less only these go. At least three points are kept; place is
    numbered from 1, from the cut on. Points without a place or coordinates are left out.
    """
    kept = checkpointed(_turning(points.dropna(subset=["place", "x", "y"]), by))
    number = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    if not tolerance > 0 or np.isinf(tolerance):
        return number(kept, F.col("place")).select(*by, "place", "x", "y")
    pair = checkpointed(_far_pair(kept, by))
    cut = kept.join(pair.where("n >= 4 AND second IS NOT NULL"), by).withColumn("_was", F.col("place"))
    # places from the first cut on; the first point comes again at the end, to close the outline
    dense = number(cut.withColumn("o", F.when(F.col("place") >= F.col("first"), 0).otherwise(1)), F.struct("o", "place"))
    again = dense.where("place = 1").withColumn("place", (F.col("n") + 1).cast("int"))
    middle = dense.where("_was = second").select(*by, F.col("place").alias("_m"))
    all_ = checkpointed(dense.union(again).join(middle, by).select(*by, "place", "x", "y", "_m", (F.col("n") + 1).cast("int").alias("_n")))
    corners = [all_.where("place = 1 OR place = _m").select(*by, "place", "x", "y")]
    own = all_.where("place < _m").select(*by, "place", "x", "y", F.lit(1).alias("low"), F.col("_m").alias("high")).union(all_.where("place > _m").select(*by, "place", "x", "y", F.col("_m").alias("low"), F.col("_n").alias("high")))
    inner = own.where("place > low AND place < high")
    ends = all_.select(*by, "place", F.struct("x", "y").alias("p"))
    end = lambda name: ends.select(*by, F.col("place").alias(name), F.col("p").alias(f"_{name}"))
    pieces = inner.select(*by, "low", "high").distinct().join(end("low"), [*by, "low"]).join(end("high"), [*by, "high"])
    inner = checkpointed(inner.join(pieces, [*by, "low", "high"]))
    while not inner.isEmpty():
        far = inner.withColumn("d", _from_segment(F.col("x"), F.col("y"), F.col("_low"), F.col("_high")))
        split = far.groupBy(*by, "low", "high").agg(F.max_by(F.struct("place", F.struct("x", "y").alias("p"), "d"), F.struct("d", -F.col("place"))).alias("s")).where(F.col("s.d") > tolerance)
        split = checkpointed(split)
        corners.append(split.select(*by, F.col("s.place").alias("place"), F.col("s.p.x").alias("x"), F.col("s.p.y").alias("y")))
        left = F.col("place") < F.col("s.place")
        inner = checkpointed(inner.join(split, [*by, "low", "high"]).where("place <> s.place").select(
            *by, "place", "x", "y", F.when(left, F.col("low")).otherwise(F.col("s.place")).alias("low"), F.when(left, F.col("s.place")).otherwise(F.col("high")).alias("high"),
            F.when(left, F.col("_low")).otherwise(F.col("s.p")).alias("_low"), F.when(left, F.col("s.p")).otherwise(F.col("_high")).alias("_high"),
        ))
    short = _turning(reduce(DataFrame.union, corners), by)
    enough = short.groupBy(*by).agg(F.count("*").alias("_k")).where("_k >= 3").select(*by)
    rest = kept.join(enough, by, "left_anti").select(*by, "place", "x", "y")
    return number(short.join(enough, by, "left_semi").union(rest), F.col("place")).select(*by, "place", "x", "y")
