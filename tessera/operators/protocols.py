"""Image sets of display protocols: rows of selectors that images must all satisfy, many protocols against all images in one plan.

elements are rows (image, tag, values; values an array of texts, `path` the tags of the sequences above, empty at the top),
selectors rows (protocol, number (of the image set), tag, path, usage, value_number, values). A selector holds for an
image if one of its values is the image's value of that number, or any of its values for number 0; where the image lacks
the element, it holds if its usage is MATCH and not if it is NO_MATCH. Values compare without spaces around.

A set that has a NO_MATCH selector is only tried on images that have one of its values, found by a join; other sets may
hold for images that have none of what they ask for, and meet every image: at most `most_open` of them are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

SET = ["protocol", "number"]


def checked(selectors: DataFrame, most: int = 256) -> DataFrame:
    """(protocol, number, place, finding) of selectors that aren't any: usage, tag, value_number, and of sets with more than `most` selectors (too many)."""
    tag = r"^[0-9A-Fa-f]{8}$"
    findings = F.array_compact(F.array(F.when(~F.coalesce(F.upper(F.trim("usage")).isin("MATCH", "NO_MATCH"), F.lit(False)), "usage"), F.when(~F.coalesce(F.col("tag").rlike(tag), F.lit(False)), "tag"), F.when(F.coalesce("value_number", F.lit(0)) < 0, "value_number"), F.when(F.exists("path", lambda t: ~t.rlike(tag)), "path")))
    each = selectors.select(*SET, "place", F.explode(findings).alias("finding"))
    many = selectors.groupBy(*SET).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*SET, F.lit(None).cast(selectors.schema["place"].dataType).alias("place"), F.lit("too many").alias("finding"))
    return each.union(many)


def _name(tag: str, path: str) -> Column:
    return F.upper(F.concat_ws(".", F.coalesce(F.col(path), F.array().cast("array<string>")), F.col(tag)))


def _trimmed(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v))


def _holds(selector: Column, image: Column) -> Column:
    """Does a selector (struct) hold for an image's map of values?"""
    own = F.try_element_at(image, selector["name"])
    taken = F.when(selector["value_number"] == 0, own).when(F.size(own) >= selector["value_number"], F.slice(own, F.greatest(selector["value_number"], F.lit(1)), 1)).otherwise(F.array().cast("array<string>"))
    return F.when(own.isNull(), selector["usage"] == "MATCH").otherwise(F.arrays_overlap(taken, selector["values"]))


def image_sets(elements: DataFrame, selectors: DataFrame, most_open: int = 1000) -> DataFrame:
    """(image, protocol, number): the image sets that each image belongs to; ValueError if more than `most_open` sets must meet every image.

    Of an element that an image has twice one stays. An image without elements isn't there, and a set without selectors
    is none.
    """
    asked = selectors.select(*SET, _name("tag", "path").alias("name"), F.upper(F.trim("usage")).alias("usage"), F.coalesce(F.col("value_number"), F.lit(0)).cast("int").alias("value_number"), _trimmed(F.col("values")).alias("values"))
    sets = checkpointed(asked.groupBy(*SET).agg(F.collect_list(F.struct("name", "usage", "value_number", "values")).alias("selectors")))
    rows = elements.select("image", _name("tag", "path").alias("name"), _trimmed(F.col("values")).alias("values"))
    known = rows.join(asked.select("name").distinct(), "name", "left_semi").groupBy("image", "name").agg(F.max("values").alias("values"))
    images = checkpointed(elements.select("image").distinct().join(known.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("has")), "image", "left").withColumn("has", F.coalesce("has", F.create_map().cast("map<string,array<string>>"))))

    # the selector of a set that must be there, the one of the fewest values: images that have one of these are tried
    must = F.array_min(F.transform(F.filter("selectors", lambda s: s["usage"] == "NO_MATCH"), lambda s: F.struct(F.size(s["values"]).alias("n"), s["name"].alias("name"), s["values"].alias("values"))))
    keyed = sets.withColumn("must", must)
    wanted = keyed.where("must IS NOT NULL").select(*SET, F.col("must.name").alias("name"), F.explode(F.array_distinct("must.values")).alias("value"))
    has = known.select("image", "name", F.explode(F.array_distinct("values")).alias("value"))
    tried = has.join(wanted, ["name", "value"]).select("image", *SET).distinct()
    holds = F.forall("selectors", lambda s: _holds(s, F.col("has")))
    found = tried.join(sets, SET).join(images, "image").where(holds).select("image", *SET)

    open_ = keyed.where("must IS NULL").select(*SET, "selectors")
    n = open_.count()
    if n > most_open:
        raise ValueError(f"{n} image sets have no selector that must be there; at most {most_open} are allowed")
    if not n:
        return found
    every = images.join(F.broadcast(open_), holds).select("image", *SET)  # of a checked size
    return found.union(every)
