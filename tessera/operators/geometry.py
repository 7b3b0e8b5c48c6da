"""Stacks of slices and time lines of frames as window queries; nearest offsets and resampling as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed


def position_along(origin: dict[str, Column], row: dict[str, Column], column: dict[str, Column]) -> Column:
    """Position of a slice along its normal, the cross product of its directions."""
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    terms = [origin[k] * (row[a] * column[b] - row[b] * column[a]) for k, (a, b) in cross.items()]
    return terms[0] + terms[1] + terms[2]


def volume_geometry(slices: DataFrame, by: list[str], position: str, index: str, same: float = 1e-3, tolerance: float = 1e-2) -> DataFrame:
    """One row for each volume: its slices in order of position, how they are spaced and what is wrong with them.

    n_slices, first, last, mean_spacing, reordered (input isn't in order of position), reversed (it is in falling order),
    duplicates (steps of at most `same`), kind (single, regular, missing: all steps are multiples of the least, irregular).
    Rows without a position are left out. Ties in position are in order of index.
    """
    w = Window.partitionBy(*by).orderBy(position, index)
    at = slices.where(F.col(position).isNotNull()).select(*by, F.col(position).alias("_p"), (F.col(position) - F.lag(position).over(w)).alias("_s"), (F.col(index) - F.lag(index).over(w)).alias("_i"))
    ends = at.groupBy(*by).agg(
        F.count("*").alias("n_slices"), F.min("_p").alias("first"), F.max("_p").alias("last"), F.coalesce(F.bool_or(F.col("_i") < 0), F.lit(False)).alias("reordered"),
        (F.coalesce(F.bool_and(F.col("_i") < 0), F.lit(False)) & (F.count("*") > 1)).alias("reversed"), F.count_if(F.col("_s") <= same).alias("duplicates"), F.min(F.when(F.col("_s") > same, F.col("_s"))).alias("_least"), F.max("_s").alias("_most"),
    )
    steps = at.where(F.col("_s") > same).join(ends.select(*by, "_least"), by)
    multiples = steps.groupBy(*by).agg(F.bool_and(F.abs(F.col("_s") - F.round(F.col("_s") / F.col("_least")) * F.col("_least")) <= tolerance).alias("_multiples"))
    ends = ends.join(multiples, by, "left")
    kind = F.when(F.col("n_slices") == 1, "single").when(F.col("duplicates") > 0, "irregular").when(F.col("_most") - F.col("_least") <= tolerance, "regular").when(F.col("_multiples"), "missing").otherwise("irregular")
    return ends.select(*by, "n_slices", "first", "last", F.try_divide(F.col("last") - F.col("first"), F.col("n_slices") - 1).alias("mean_spacing"), "reordered", "reversed", "duplicates", kind.alias("kind"))


def spatial_key(stack: Column, z: Column, in_stack: Column, frame: Column) -> Column:
    """What places a frame in space: its position in thousandths, else its place in the stack, else its number."""
    s = F.trim(F.coalesce(stack, F.lit("")))
    place = F.when(z.isNotNull(), F.concat(F.lit(":z:"), F.round(z * 1000).cast("long").cast("string"))).when(in_stack.isNotNull(), F.concat(F.lit(":i:"), in_stack.cast("string"))).otherwise(F.concat(F.lit(":frame:"), frame.cast("string")))
    return F.concat(s, place)


def time_points(frames: DataFrame, by: list[str], key: Column, frame: str, position: str, offset: str, duration: str) -> DataFrame:
    """frames with `point`, the number of their time point in its series, and the point's offset and duration.

    A frame with a temporal position belongs to that point; of others the n-th of each spatial key belongs to point n. A
    point has the least offset and the longest duration of its frames. Points are numbered by position, then offset, those
    without one last. Ties are in order of the frame's number.
    """
    nth = F.row_number().over(Window.partitionBy(*by, "_key", F.col(position).isNull()).orderBy(frame))
    rows = frames.withColumn("_key", key).withColumn("_at", F.when(F.col(position).isNull(), nth))
    points = rows.groupBy(*by, position, "_at").agg(F.min(offset).alias("point_offset"), F.max(duration).alias("point_duration"), F.count("*").alias("point_frames"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(position).asc_nulls_last(), F.col("point_offset").asc_nulls_last(), F.col("_at").asc_nulls_last()))
    points = points.withColumn("point", number).select(*(F.col(c).alias(f"_r{k}") for k, c in enumerate([*by, position, "_at"])), "point", "point_offset", "point_duration", "point_frames")
    same = F.lit(True)
    for k, c in enumerate([*by, position, "_at"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{k}"))
    return rows.join(points, same).select(*frames.columns, "point", "point_offset", "point_duration", "point_frames")


def stack_order(frames: DataFrame, by: list[str], stack: str, in_stack: str, z: str, frame: str) -> DataFrame:
    """frames with `stack_id` (default where there is none) and `place`, from 1: by the place in the stack, then position, then number."""
    id_ = F.coalesce(F.nullif(F.trim(F.col(stack)), F.lit("")), F.lit("default"))
    w = Window.partitionBy(*by, "stack_id").orderBy(F.col(in_stack).asc_nulls_last(), F.col(z).asc_nulls_last(), frame)
    return frames.withColumn("stack_id", id_).withColumn("place", F.row_number().over(w))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """left with `found` and `apart`: the value of right nearest in `at` within the group, the lesser value where two are as near.

    Null where left has no offset or its group has none in right. The different offsets of all groups are dealt out in
    order, in ranges of about as many each, so a group may lie in any number of ranges and no task sorts one whole. Within a
    range one pass each way finds the last mark before and the first after an offset; a summary of one row for each group and
    range carries marks into ranges that have none.
    """
    none = F.lit(None).cast(right.schema[value].dataType)
    own = left.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), F.lit(False).alias("_mark"), none.alias("_v"))
    marks = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), F.lit(True).alias("_mark"), F.col(value).alias("_v"))
    offsets = own.union(marks).groupBy(*by, "_at").agg(F.max("_mark").alias("_mark"), F.min("_v").alias("_v"))
    dealt = checkpointed(offsets.repartitionByRange(*by, "_at").withColumn("_range", F.spark_partition_id()))

    mark = F.when(F.col("_mark"), F.struct("_at", "_v"))
    w = Window.partitionBy("_range", *by)
    last = lambda order: F.last(mark, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy(*by, "_range").agg(F.min(mark).alias("_first"), F.max(mark).alias("_last"))
    ranges = Window.partitionBy(*by)
    before = F.last("_last", ignorenulls=True).over(ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", ignorenulls=True).over(ranges.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate([*by, "_range"])), before.alias("_before"), after.alias("_after"))
    each = dealt.withColumn("_b", last(F.col("_at"))).withColumn("_a", last(F.desc("_at")))
    each = each.join(carried, _same([*by, "_range"], "_c")).withColumn("_b", F.coalesce("_b", "_before")).withColumn("_a", F.coalesce("_a", "_after"))
    below, above = F.col("_at") - F.col("_b._at"), F.col("_a._at") - F.col("_at")
    first = F.col("_b").isNotNull() & (F.col("_a").isNull() | (below < above) | ((below == above) & (F.col("_b._v") <= F.col("_a._v"))))
    apart, found = F.when(first, below).otherwise(above), F.when(first, F.col("_b._v")).otherwise(F.col("_a._v"))
    near = F.lit(True) if tolerance is None else apart <= tolerance
    answers = each.select(*(F.col(c).alias(f"_o{k}") for k, c in enumerate([*by, "_at"])), F.when(near, found).alias("found"), F.when(near, apart).alias("apart"))
    return left.join(answers, _same([*by, at], "_o"), "left").select(*left.columns, "found", "apart")


def _same(columns: list[str], prefix: str) -> Column:
    """Do the columns equal those named by prefix and place, nulls among themselves included?"""
    out = F.lit(True)
    for k, c in enumerate(columns):
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def sampled(points: DataFrame, voxels: DataFrame, by: list[str], value: str) -> DataFrame:
    """points (x, y, z in voxels, with fractions) with `sample`, trilinear between the voxels (x, y, z whole) around them; null where one is missing.

    Each point asks for its eight corners, which are joined by place; corners of no weight aren't needed.
    """
    low = {c: F.floor(c).cast("long") for c in "xyz"}
    corners = F.array(*(F.struct(*((low[c] + d).alias(f"_{c}") for c, d in zip("xyz", ds, strict=True)), _product(*(F.col(c) - low[c] if d else 1 - (F.col(c) - low[c]) for c, d in zip("xyz", ds, strict=True))).alias("_w")) for ds in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))))
    asked = checkpointed(points.withColumn("_id", F.monotonically_increasing_id()))  # kept, so that both uses see the same numbers
    each = asked.select("_id", *by, F.explode(corners).alias("c")).select("_id", *by, "c.*").where("_w > 0")
    there = voxels.select(*by, *(F.col(c).cast("long").alias(f"_{c}") for c in "xyz"), F.col(value).cast("double").alias("_v"))
    got = each.join(there, [*by, "_x", "_y", "_z"], "left").groupBy("_id").agg(F.when(F.count("_v") == F.count("*"), F.sum(F.col("_v") * F.col("_w"))).alias("sample"))
    return asked.join(got, "_id", "left").drop("_id")


def _product(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out
