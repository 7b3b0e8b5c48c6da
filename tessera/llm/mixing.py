r"""Mixing sources to target weights by Pareto order sampling.

Size is the number of words. A source's target is its weight's share of a multiple of all sizes, at most `most` times
its own size; what that cuts off is shared again by weight, which is water-filling: with the sources in order of
size / weight, the first ones are filled up and all later ones get the same number of words for each unit of weight.

Each document is taken floor(target / source size) times for certain. The rest of the target is a sample of fixed size,
in words: a document has the inclusion odds p / (1 - p), p in proportion to the square root of its size (long documents
are somewhat likelier to be taken once more), and a fixed random number u from its id; documents are taken in order of
u / (1 - u) over p / (1 - p) until the next one would exceed the target. Last comes the one document left out whose size
is nearest to what is missing, if it brings the sum nearer. No document is taken more than `most` times.

The order is cut by counting words in 4,096 classes of the order's key for each source; only the class in which a source
reaches its target is sorted, so no task sorts a source.

Nulls: a null text has size 0; a null source is a source, the last one. Documents of size 0 are taken 0 words. Repeated
rows have the same random number, and the last choice falls on all rows of its id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, SHARE, MOST, CLASSES = (5, 2, 1), 1.5, 2, 4096
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(key: Column) -> Column:
    """A number strictly between 0 and 1, fixed by the key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: its size, `spread` (of size * sqrt(size)) and target. sizes has columns source and size."""
    spread = F.floor(F.col("size") * F.sqrt(F.col("size").cast("double")) * 16).cast("long")
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(spread).alias("spread"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    left = F.sum("source_size").over(all_) * F.lit(share) - (F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    each = each.withColumn("level", left / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(all_)
    return each.withColumn("all", level).select("source", "source_size", "spread", F.when(F.col("all").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("all"))).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target (its source's), copies and taken (words)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")), "sizes")
    goals = written(targets(sized, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    u, p = _uniform(F.col("key")), F.least(F.col("rest") * F.sqrt(F.col("size").cast("double")) * 16 / F.greatest("spread", F.lit(1)), F.lit(1 - 1e-9))
    rank = (u / (1 - u)) / (p / (1 - p))
    able = (F.col("size") > 0) & (F.col("rest") > 0)
    each = sized.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.withColumn("rank", F.when(able, rank)).withColumn("class", F.floor(F.col("rank") / (1 + F.col("rank")) * CLASSES))

    # the class in which each source reaches what is left of its target
    by_class = each.where("rank IS NOT NULL").groupBy("source", "class").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("class"))
    cuts = by_class.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min_by(F.struct("class", (F.col("upto") - F.col("words")).alias("before")), "class").alias("cut"))
    cuts = written(cuts.select(F.col("source").alias("s"), F.col("cut.class").alias("cut"), F.col("cut.before").alias("before")), "cuts")

    each = each.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    there = F.col("class") == F.col("cut")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, 0))
    edge = each.where(there).withColumn("upto", F.col("before") + upto).withColumn("more", F.col("upto") <= F.col("rest")).drop("upto")
    sure = each.where(~F.coalesce(there, F.lit(False))).withColumn("more", F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("class") < F.col("cut"))))
    chosen = written(edge.union(sure), "chosen")

    # one document more, where it brings a source nearer to its target
    missing = chosen.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("missing"))
    out = chosen.where("NOT more AND rank IS NOT NULL").join(missing.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    off = F.abs(F.col("missing") - F.col("size"))
    last = out.where(off < F.col("missing")).groupBy("s").agg(F.min(F.struct(off.alias("off"), "rank", "key")).alias("best")).select("s", F.col("best.key").alias("last"))
    final = chosen.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    # a copy more is for those chosen or last
    copies = F.col("whole") + (F.col("more") | F.coalesce((F.col("key").eqNullSafe(F.col("last"))) & F.col("last").isNotNull() & F.col("rank").isNotNull(), F.lit(False))).cast("long")
    return final.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
