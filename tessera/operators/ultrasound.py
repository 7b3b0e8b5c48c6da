"""Measurements within calibrated regions of frames: areas, circumferences, times and velocities, and named ones.

points are rows (by, shape, place, x, y), regions rows (by, region, corners x0, y0, x1, y1 (inside it), reference pixel rx, ry
from its first corner, the values vx, vy there, steps dx, dy, units ux, uy, format, flags). A region must hold all points
of a shape and have the units asked for; the one of least number counts if all such regions scale alike. Findings:
calibration (its steps aren't), ambiguous (several scale otherwise), units (other units where a point lies), cross_region
(points in different regions), uncalibrated (a point in none), points (too few).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Named measurements: their code (LOINC), its meaning, and whether they go around (fixed values).
BIOMETRY = (("biparietal-diameter", "11820-8", "Biparietal Diameter", False), ("head-circumference", "11984-2", "Head Circumference", True), ("abdominal-circumference", "11979-2", "Abdominal Circumference", True), ("femur-length", "11963-6", "Femur Length", False))
#: Formats of regions over time, and the flag of a frequency scale (fixed values).
OVER_TIME, FREQUENCY = (3, 4), 4


def placed(points: DataFrame, regions: DataFrame, by: list[str], ux: str, uy: str, absolute: bool = False) -> DataFrame:
    """(by, shape, n, region (struct of its row, null where there is a finding), finding): where each shape is measured.

    With `absolute` regions scale alike only if a pixel has the same value in them.
    """
    key = [*by, "shape"]
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    shapes = points.groupBy(*key).agg(F.count("*").alias("n"))
    own = ("region", "x0", "y0", "rx", "ry", "vx", "vy", "dx", "dy", "ux", "uy", "format", "flags")
    held = points.join(regions, by).where(inside).groupBy(*key, *own).agg(F.count("*").alias("_in"))
    right = (F.col("ux") == ux) & (F.col("uy") == uy)
    scale = F.struct("dx", "dy", *([F.col("vx"), F.col("vy"), (F.col("x0") + F.col("rx")).alias("ax"), (F.col("y0") + F.col("ry")).alias("ay")] if absolute else []))
    found = held.join(shapes, key).groupBy(*key).agg(
        F.min(F.when(right & (F.col("_in") == F.col("n")), F.struct(*own))).alias("_r"), F.min(F.when(right & (F.col("_in") == F.col("n")), scale)).alias("_a"), F.max(F.when(right & (F.col("_in") == F.col("n")), scale)).alias("_b"),
        F.bool_or(~right).alias("_other"), F.count("*").alias("_regions"), F.max("_in").alias("_most"),
    )
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | (F.col(c) == 0)
    wrong = F.lit(False)
    for c in ("dx", "dy"):
        wrong = wrong | bad(f"_r.{c}")
    finding = F.when(F.col("_r").isNotNull(), F.when(wrong, "calibration").when(F.col("_a") != F.col("_b"), "ambiguous")).when(F.coalesce("_other", F.lit(False)), "units").when((F.col("_regions") > 1) & (F.col("_most") < F.col("n")), "cross_region").otherwise("uncalibrated")
    return shapes.join(found, key, "left").withColumn("finding", finding).select(*key, "n", F.when(F.col("finding").isNull(), F.col("_r")).alias("region"), "finding")


def _physical(axis: str) -> Column:
    return F.col(f"region.v{axis}") + (F.col(axis) - F.col(f"region.{axis}0") - F.col(f"region.r{axis}")) * F.col(f"region.d{axis}")


def _around(points: DataFrame, where: DataFrame, key: list[str]) -> DataFrame:
    """points with their physical place px, py and that of the next point, the first after the last."""
    w = Window.partitionBy(*key)
    first = F.first(F.struct("px", "py")).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = points.join(where.where("finding IS NULL").select(*key, "n", "region"), key).withColumn("px", _physical("x")).withColumn("py", _physical("y"))
    return rows.withColumn("next", F.coalesce(F.lead(F.struct("px", "py")).over(w.orderBy("place")), first))


def _result(where: DataFrame, measured: DataFrame, key: list[str], least: int | Column) -> DataFrame:
    finding = F.when(F.col("n") < least, "points").otherwise(F.col("finding"))
    return where.join(measured, key, "left").withColumn("finding", finding).select(*key, F.when(F.col("finding").isNull(), F.col("region.region")).alias("region"), F.when(F.col("finding").isNull(), F.col("value")).alias("value"), "finding")


def polygon_areas(points: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, region, value in square centimetres, finding) of polygons of three points and more."""
    key = [*by, "shape"]
    where = placed(points, regions, by, "cm", "cm")
    cross = F.col("px") * F.col("next.py") - F.col("next.px") * F.col("py")
    return _result(where, _around(points, where, key).groupBy(*key).agg((F.abs(F.sum(cross)) / 2).alias("value")), key, 3)


def biometry(points: DataFrame, regions: DataFrame, kinds: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, kind, code, meaning, region, value in centimetres, finding): named measurements (by, shape, kind) of their shapes.

    Those that go around are the length of the closed line, of three points and more; others are the distance of the first
    two points. An unknown kind is the finding kind.
    """
    key = [*by, "shape"]
    where = placed(points, regions, by, "cm", "cm").join(kinds.select(*key, "kind").join(_named(points.sparkSession), "kind", "left"), key)
    step = F.sqrt(F.pow(F.col("next.px") - F.col("px"), 2) + F.pow(F.col("next.py") - F.col("py"), 2))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    steps = _around(points, where, key).withColumn("step", step).withColumn("_n", place).groupBy(*key).agg(F.sum("step").alias("_all"), F.max(F.when(F.col("_n") == 1, F.col("step"))).alias("_first"))
    least = F.when(F.col("around"), 3).otherwise(2)
    measured = steps.join(where.select(*key, "around"), key).select(*key, F.when(F.col("around"), F.col("_all")).otherwise(F.col("_first")).alias("value"))
    found = _result(where.withColumn("finding", F.when(F.col("code").isNull(), "kind").otherwise(F.col("finding"))), measured, key, least)
    return found.join(where.select(*key, "kind", "code", "meaning"), key).select(*key, "kind", "code", "meaning", "region", "value", "finding")


def _named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BIOMETRY, "kind string, code string, meaning string, around boolean")


def doppler(points: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, region, seconds, velocity, finding) of single points, in seconds and centimetres a second; frequency scales, and regions that aren't over time, are the finding units."""
    key = [*by, "shape"]
    where = placed(points, regions, by, "s", "cm/s", absolute=True)
    timed = F.col("region.format").isin(*OVER_TIME) & (F.col("region.flags").bitwiseAND(FREQUENCY) == 0)
    where = where.withColumn("finding", F.when(F.col("n") != 1, "points").when(F.col("region").isNotNull() & ~timed, "units").otherwise(F.col("finding")))
    at = points.join(where, key)
    ok = F.col("finding").isNull()
    return at.select(*key, F.when(ok, F.col("region.region")).alias("region"), F.when(ok, _physical("x")).alias("seconds"), F.when(ok, _physical("y")).alias("velocity"), "finding")
