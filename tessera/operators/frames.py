"""Frames that belong together: levels and tiles of pyramids, masks of contrast frames. All by joins, arithmetic and windows of one object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_for_scale(levels: DataFrame, by: list[str], width: str, scale: Column) -> DataFrame:
    """One row for each pyramid: the level whose reduction is nearest, in powers of two, to `scale` (pixels of the widest level for one on the screen).

    Of two as near the less reduced one is taken, and for a scale that is null, not finite or not positive the widest level.
    Levels without a positive width are left out. `scale` is the same in all rows of a pyramid.
    """
    rows = levels.where(F.col(width) > 0).withColumn("_scale", scale.cast("double"))
    base = rows.groupBy(*by).agg(F.max(width).alias("_base"))
    ratio = F.col("_base") / F.col(width)
    good = F.col("_scale").isNotNull() & (F.col("_scale") > 0) & (F.col("_scale") < float("inf"))
    apart = F.when(good, F.round(F.abs(F.log2(ratio / F.col("_scale"))), 9)).otherwise(ratio)
    best = F.min(F.struct(apart.alias("apart"), ratio.alias("ratio"), F.col(width).alias("width")))
    return rows.join(base, by).groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.width").alias(width), F.col("_b.ratio").alias("ratio"))


def _size(low: str, high: str) -> Column:
    return F.greatest(F.lit(0), F.col(high) - F.col(low))


def tiles_in_view(levels: DataFrame, tile: tuple[int, int], planes: int = 1, paths: int = 1) -> DataFrame:
    """levels with (plane, path, tile_row, tile_column, frame): the tiles of a grid that fills the matrix which overlap the view.

    levels: width, height, n_frames and the view x0 <= x < x1, y0 <= y < y1, in pixels of the level. Frames count from 1,
    by plane, path, row and column; those beyond n_frames aren't there. The tiles come from the view's own bounds, none of
    the others is made.
    """
    w, h = tile
    across, down = F.ceil(F.col("width") / w), F.ceil(F.col("height") / h)
    cut = levels.withColumn("_x0", F.greatest(F.lit(0), "x0")).withColumn("_x1", F.least("width", "x1")).withColumn("_y0", F.greatest(F.lit(0), "y0")).withColumn("_y1", F.least("height", "y1"))
    seen = cut.where((_size("_x0", "_x1") > 0) & (_size("_y0", "_y1") > 0))
    span = lambda low, high, size: F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))
    each = seen.withColumn("tile_row", F.explode(span("_y0", "_y1", h))).withColumn("tile_column", F.explode(span("_x0", "_x1", w)))
    each = each.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(planes - 1)))).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    frame = ((F.col("plane") * paths + F.col("path")) * down + F.col("tile_row")) * across + F.col("tile_column") + 1
    return each.withColumn("frame", frame).where("frame <= n_frames").drop("_x0", "_x1", "_y0", "_y1")


def nearest_tiles(tiles: DataFrame, by: list[str], x: Column, y: Column, tile: tuple[int, int], limit: int) -> DataFrame:
    """The `limit` tiles of each view whose centres are nearest to a point, with their place from 1; ties go to the smaller frame."""
    w, h = tile
    dx, dy = F.col("tile_column") * w + w // 2 - x, F.col("tile_row") * h + h // 2 - y
    order = Window.partitionBy(*by).orderBy(dx * dx + dy * dy, "frame")
    return tiles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def mask_frames(frames: DataFrame, items: DataFrame, by: list[str], frame: str) -> DataFrame:
    """(by, item, frame, mask): for each item the frames it applies to, with the mask frame to take from them.

    items: by, item, ranges (array of structs first, last; empty or null for all frames) and masks (array of frame numbers).
    One mask serves all frames; several are dealt to the frames in order. Frames for which none is left have no mask.
    """
    within = F.coalesce(F.size("ranges"), F.lit(0)).isin(0, -1) | F.exists("ranges", lambda r: F.col(frame).between(r["first"], r["last"]))
    met = frames.select(*by, frame).distinct().join(items.select(*by, "item", "ranges", "masks"), by).where(within)
    place = F.row_number().over(Window.partitionBy(*by, "item").orderBy(frame)) - 1
    return met.withColumn("_k", place).select(*by, "item", frame, F.when(F.size("masks") == 1, F.get("masks", F.lit(0))).otherwise(F.get("masks", F.col("_k"))).alias("mask"))


def calibrated(points: DataFrame, regions: DataFrame, by: list[str], id_: str) -> DataFrame:
    """points (by, id, x, y) with region, physical x and y: by the region of least number that holds the point, null where none does.

    regions: by, region, its corners x0, y0, x1, y1 (inside it), reference pixel rx, ry from its first corner, the values
    vx, vy there, and the steps dx, dy of a pixel. Regions of a frame are few, so points meet those of their frame only.
    """
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    px = F.col("vx") + (F.col("x") - F.col("x0") - F.col("rx")) * F.col("dx")
    py = F.col("vy") + (F.col("y") - F.col("y0") - F.col("ry")) * F.col("dy")
    first = points.join(regions, by).where(inside).groupBy(*by, id_).agg(F.min(F.struct("region", px.alias("px"), py.alias("py"))).alias("_f"))
    return points.join(first, [*by, id_], "left").select(*points.columns, F.col("_f.region").alias("region"), F.col("_f.px").alias("px"), F.col("_f.py").alias("py"))


def with_shared(frames: DataFrame, shared: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """frames, each column taken from what all frames of an object share (by, columns) where the frame itself has none."""
    common = shared.select(*by, *(F.col(c).alias(f"_{c}") for c in columns))
    filled = {c: F.coalesce(c, f"_{c}") for c in columns}
    return frames.join(common, by, "left").withColumns(filled).select(*frames.columns)


def region_lengths(points: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, region, length) of lines of points (by, shape, place, x, y), in centimetres, for those of two points and more.

    regions (by, region, corners x0, y0, x1, y1, steps dx, dy, units ux, uy) must hold all points of a line. The first that
    does gives the steps; region and length are null where none does, or several do by different steps.
    """
    key = [*by, "shape"]
    w = Window.partitionBy(*key).orderBy("place")
    steps = points.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).withColumn("_px", F.lag("x").over(w)).withColumn("_py", F.lag("y").over(w)).where("_n > 1")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")) & (F.col("ux") == "cm") & (F.col("uy") == "cm")
    long = F.sqrt(F.pow((F.col("x") - F.col("_px")) * F.col("dx"), 2) + F.pow((F.col("y") - F.col("_py")) * F.col("dy"), 2))
    held = steps.join(regions, by).where(inside).groupBy(*key, "region", "dx", "dy").agg(F.count("*").alias("_in"), F.first("_n").alias("_n"), F.sum(long).alias("length")).where("_in = _n")
    one = held.groupBy(*key).agg(F.min(F.struct("region", "length")).alias("_r"), (F.min(F.struct("dx", "dy")) == F.max(F.struct("dx", "dy"))).alias("_same")).where("_same")
    return steps.select(*key).distinct().join(one, key, "left").select(*key, F.col("_r.region").alias("region"), F.col("_r.length").alias("length"))
