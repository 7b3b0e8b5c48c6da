"""Statistics of values in regions: moments, histograms, cumulative dose-volume curves, projections, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def summary(voxels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, sum, extremes, mean and population variance of the finite values."""
    v = F.col(value)
    return voxels.where(finite(v)).groupBy(*by).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"))


def full(voxels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Also the exact median, population skewness and excess kurtosis, which are 0 where all values are one.

    The median comes from the counts of different values, summed in blocks of values, so no task holds a group.
    """
    v = F.col(value)
    rows = voxels.where(finite(v))
    moments = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.skewness(v), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis(v), F.lit(0.0)).alias("kurtosis"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    return moments.join(_medians(rows, by, value, moments), by).select(*by, "n", "median", "skewness", "kurtosis")


def _medians(rows: DataFrame, by: list[str], value: str, ends: DataFrame, blocks: int = 4096) -> DataFrame:
    """(by, median): the block that holds the middle ranks is found from block counts; only that block's values are put in order."""
    width = F.col("_high") - F.col("_low")
    at = F.when(width > 0, F.least(F.lit(blocks - 1), F.floor((F.col(value) - F.col("_low")) / width * F.lit(blocks)))).otherwise(0).cast("int")
    counted = rows.join(ends.select(*by, "n", "_low", "_high"), by).groupBy(*by, "n", at.alias("_block"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    sizes = counted.groupBy(*by, "n", "_block").agg(F.sum("_c").alias("_size"))
    sums = sizes.withColumn("_below", F.sum("_size").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    held = sums.where((F.col("_below") < high) & (F.col("_below") + F.col("_size") >= low)).select(*by, "_block", "_below")
    order = Window.partitionBy(*by, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(held, [*by, "_block"]).withColumn("_to", F.col("_below") + F.sum("_c").over(order))
    middle = lambda rank: F.min(F.when(F.col("_to") >= rank, F.col("_v")))
    return ranked.groupBy(*by).agg(((middle(low) + middle(high)) / 2).alias("median"))


def volume(voxels: DataFrame, by: list[str], value: str, area: Column, thickness: Column) -> DataFrame:
    """Count, extremes, mean, population variance, area and volume of the voxels of a segment that have a value, each by the area and thickness of its own slice.

    NaN and infinities are values: they count, and NaN makes mean and variance NaN, but is no extreme. A segment of NaN
    alone has the extremes infinity and minus infinity.
    """
    v, inf = F.col(value).cast("double"), F.lit(float("inf"))
    number = F.when(~F.isnan(v), v)
    rows = voxels.where(v.isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.min(number), inf).alias("low"), F.coalesce(F.max(number), -inf).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.sum(area).alias("area_mm2"), F.sum(area * thickness).alias("volume_mm3"))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    width = (high - low) / F.lit(bins)
    at = F.when(width > 0, F.floor((value - low) / width)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")


def histogram(voxels: DataFrame, by: list[str], value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(by, bin, n) of the finite values; over their own range, or over a given one whose outer bins take what is beyond it."""
    rows = voxels.where(finite(F.col(value))).select(*by, F.col(value).alias("_v"))
    if low is None or high is None:
        ends = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        rows = rows.join(ends, by)
        at = _bin(F.col("_v"), F.col("_low"), F.col("_high"), bins)
    else:
        at = _bin(F.col("_v"), F.lit(float(low)), F.lit(float(high)), bins)
    return rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def dose_volume(voxels: DataFrame, by: list[str], dose: str, volume: str, bins: int) -> DataFrame:
    """(by, bin, volume at and above it, per cent): voxels are binned by dose over the largest dose of all, then summed from above.

    The sums run over at most `bins` rows for each group. Doses that are no finite numbers are left out.
    """
    voxels = voxels.where(finite(F.col(dose)))
    top = voxels.agg(F.max(dose).alias("_top"))
    at = F.when(F.col("_top") > 0, F.floor(F.col(dose) / F.col("_top") * F.lit(bins - 1))).otherwise(0).cast("int")
    each = voxels.crossJoin(F.broadcast(top)).groupBy(*by, at.alias("bin")).agg(F.sum(volume).alias("_w"))  # the one row of the top
    order = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("_w").over(Window.partitionBy(*by))
    return each.select(*by, "bin", F.sum("_w").over(order).alias("volume"), (F.sum("_w").over(order) * 100 / whole).alias("percent"))


def dose_at_volume(curve: DataFrame, by: list[str], percents: list[float]) -> DataFrame:
    """For each per cent the last bin that at least that much volume reaches."""
    return curve.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("percent") + 1e-9 >= p, F.col("bin"))), F.lit(0)).alias(f"d{p:g}") for p in percents))


def dose_summary(voxels: DataFrame, by: list[str], dose: str, volume: str) -> DataFrame:
    """Voxels, volume, least, largest and mean dose, the mean weighted by volume. Doses that are no finite numbers are left out."""
    d, v = F.col(dose), F.col(volume)
    return voxels.where(finite(d)).groupBy(*by).agg(F.count("*").alias("n"), F.sum(v).alias("volume"), F.min(d).alias("low"), F.max(d).alias("high"), F.when(F.sum(v) > 0, F.sum(d * v) / F.sum(v)).alias("mean"))


def projection(voxels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest, least and mean value along a slab for each place; without samples no value."""
    return voxels.groupBy(*by).agg(F.max(value).alias("mip"), F.min(value).alias("minip"), F.avg(value).alias("average"))


def auto_window(voxels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Center and width of the window that shows all values."""
    v = F.col(value)
    return voxels.where(finite(v)).groupBy(*by).agg(((F.min(v) + F.max(v)) / 2).alias("center"), (F.max(v) - F.min(v)).alias("width"))


def envelope(samples: DataFrame, channel: str, position: str, value: str, low: int, high: int, width: int) -> DataFrame:
    """(channel, bucket, least, most, n): at most `width` buckets of the positions low <= p < high."""
    at = F.floor((F.col(position) - F.lit(low)) * F.lit(width) / F.lit(high - low)).cast("int")
    return samples.where((F.col(position) >= low) & (F.col(position) < high) & F.col(value).isNotNull()).groupBy(channel, at.alias("bucket")).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def amplitude_scale(buckets: DataFrame, by: list[str]) -> DataFrame:
    """(by, low, high, center, half_span, valid) of an envelope's buckets; a flat channel spans its own height or 1, one without finite values is -1 to 1."""
    of = lambda f, c: f(F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")))
    ends = buckets.groupBy(*by).agg(F.least(of(F.min, "least"), of(F.min, "most")).alias("low"), F.greatest(of(F.max, "least"), of(F.max, "most")).alias("high"))
    valid = F.col("low").isNotNull()
    center, half = F.col("low") / 2 + F.col("high") / 2, F.col("high") / 2 - F.col("low") / 2
    return ends.select(*by, F.coalesce("low", F.lit(-1.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"), F.when(valid, center).otherwise(0.0).alias("center"), F.when(~valid, 1.0).when(half > 0, half).otherwise(F.greatest(F.abs(center), F.lit(1.0))).alias("half_span"), valid.alias("valid"))


def sequence_gaps(rows: DataFrame, by: list[str], order: list[str], at: str) -> DataFrame:
    """rows with `step` (to the row before) and `change` (of the step)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("step", F.col(at) - F.lag(at).over(w)).withColumn("change", F.col("step") - F.lag("step").over(w))


def irregular(rows: DataFrame, by: list[str], order: list[str], at: str, tolerance: float) -> DataFrame:
    """For each group of at least 3 points, is a step not positive, or changes one by more than the tolerance?"""
    odd = F.coalesce(F.col("step") <= 0, F.lit(False)) | F.coalesce(F.abs("change") > tolerance, F.lit(False))
    return sequence_gaps(rows, by, order, at).groupBy(*by).agg(F.count("*").alias("n_points"), ((F.count("*") >= 3) & F.bool_or(odd)).alias("irregular"))


def spacing(rows: DataFrame, by: list[str], order: list[str], at: str, tolerance: float) -> DataFrame:
    """For each group the least positive spacing, whether all are that one, and whether some are multiples of it (missing slices)."""
    step = F.col("step")
    steps = sequence_gaps(rows, by, order, at).where(step.isNotNull())
    base = steps.groupBy(*by).agg(F.min(F.when(step > 0, step)).alias("base"))
    ratio = step / F.col("base")
    near = F.abs(step - F.round(ratio) * F.col("base")) <= tolerance
    return steps.join(base, by).groupBy(*by).agg(
        F.max("base").alias("base"), F.coalesce(F.bool_and(F.abs(step - F.col("base")) <= tolerance), F.lit(False)).alias("regular"),
        F.coalesce(F.bool_and(near & (F.round(ratio) >= 1)) & (F.max(F.round(ratio)) >= 2), F.lit(False)).alias("missing"),
    )


def sample_index(at: Column, rate: Column, delay: Column, count: Column) -> Column:
    """The sample nearest to `at` seconds of a channel that starts `delay` late; null before its start or past its samples."""
    n = F.floor((at - delay) * rate + 0.5)
    return F.when((at >= delay) & (n < count), n)
