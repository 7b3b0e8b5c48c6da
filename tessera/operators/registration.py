"""Points of a registered image in the image that it was registered from: a matrix, a sampled displacement, a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

#: How far beyond the outermost cells, in cells, a point still counts as on them (a fixed value).
TOLERANCE = 1e-9


def _moved(matrix: Column, p: list[Column]) -> list[Column]:
    m = lambda k: F.get(matrix, F.lit(k))
    return [m(4 * k) * p[0] + m(4 * k + 1) * p[1] + m(4 * k + 2) * p[2] + m(4 * k + 3) for k in range(3)]


def _finite(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def to_source(points: DataFrame, registrations: DataFrame, vectors: DataFrame) -> DataFrame:
    """points with `source` (struct x, y, z) and `error` (null, invalid, outside or undefined); one of the two is null.

    points have (reg, x, y, z, and others of one's own), registrations one row for each reg: pre and post (16 numbers, row
    by row), and, where there is a displacement field, origin, row, col, normal, spacing and cells (three numbers each; null
    where there is none). vectors are the field's cells (reg, i, j, k, dx, dy, dz) along row, col and normal.

    The displacement is trilinear between the cells around the point as it was given, before the first matrix. A
    point off the grid is outside; one whose sample needs a cell that is missing, or not a finite vector, is undefined. A
    point or a result that isn't finite, or a point without a registration, is invalid. Cells of no weight aren't asked for,
    and each point meets its cells by a join.
    """
    asked = checkpointed(points.join(registrations.dropDuplicates(["reg"]), "reg", "left").withColumn("_id", F.monotonically_increasing_id()))
    at = lambda name, k: F.get(F.col(name), F.lit(k))
    p = [F.col(c).cast("double") for c in "xyz"]
    gridded = F.col("cells").isNotNull()
    whole = F.col("pre").isNotNull() & (F.size("pre") == 16) & (F.size("post") == 16) & _finite(p)
    along = lambda axis, k: sum(((p[n] - at("origin", n)) * at(axis, n) for n in range(1, 3)), (p[0] - at("origin", 0)) * at(axis, 0)) / at("spacing", k)
    placed = asked.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumn("_c", F.when(gridded & F.col("_whole"), F.array(*(along(a, k) for k, a in enumerate(("row", "col", "normal"))))))
    most = lambda k: at("cells", k) - 1
    inside = F.lit(True)
    for k in range(3):
        inside = inside & at("_c", k).between(-TOLERANCE, most(k) + TOLERANCE)
    placed = placed.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_c", F.array(*(F.greatest(F.lit(0.0), F.least(most(k).cast("double"), at("_c", k))) for k in range(3))))
    low = [F.floor(at("_c", k)).cast("long") for k in range(3)]
    part = [at("_c", k) - low[k] for k in range(3)]
    corners = F.array(*(F.struct(*((F.least(low[k] + d, most(k).cast("long")) if d else low[k]).alias(n) for k, (d, n) in enumerate(zip(ds, "ijk", strict=True))), (_share(part[0], ds[0]) * _share(part[1], ds[1]) * _share(part[2], ds[2])).alias("w")) for ds in ((a, b, c) for c in (0, 1) for b in (0, 1) for a in (0, 1))))
    needed = placed.where(gridded & F.col("_whole") & F.col("_in")).select("_id", "reg", F.explode(corners).alias("c")).select("_id", "reg", "c.*").where("w <> 0")
    cells = vectors.where(_finite([F.col(c).cast("double") for c in ("dx", "dy", "dz")])).select("reg", *(F.col(c).cast("long").alias(c) for c in "ijk"), *(F.col(c).cast("double").alias(c) for c in ("dx", "dy", "dz"))).dropDuplicates(["reg", "i", "j", "k"])
    met = needed.join(cells, ["reg", "i", "j", "k"], "left").groupBy("_id").agg(F.array(*(F.sum(F.col("w") * F.col(c)) for c in ("dx", "dy", "dz"))).alias("_d"), (F.count("dx") == F.count("*")).alias("_all"))
    moved = placed.join(met, "_id", "left")
    before = _moved(F.col("pre"), p)
    between = [b + F.when(gridded, at("_d", k)).otherwise(0.0) for k, b in enumerate(before)]
    after = _moved(F.col("post"), between)
    error = F.when(~F.col("_whole"), "invalid").when(gridded & ~F.col("_in"), "outside").when(gridded & ~F.coalesce("_all", F.lit(False)), "undefined").when(~_finite(after), "invalid")
    return moved.withColumn("error", error).select(*points.columns, F.when(F.col("error").isNull(), F.struct(*(a.alias(n) for a, n in zip(after, "xyz", strict=True)))).alias("source"), "error")


def _share(part: Column, upper: int) -> Column:
    return part if upper else 1 - part
