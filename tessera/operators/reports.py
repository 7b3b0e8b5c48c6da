"""Content items of reports, annotations and presentation states as rows.

Items are rows (doc, item, parent, value_type, concept, text, number, unit, ref): item numbers a document's items in order,
and parent is the item above, null at the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_images(items: DataFrame) -> DataFrame:
    """(doc, item, ref) of the images at the top of key object selections."""
    return items.where("parent IS NULL AND value_type = 'IMAGE'").select("doc", "item", "ref")


def key_findings(items: DataFrame) -> DataFrame:
    """(doc, ref, finding): the first text, if not empty, below each image; where a document lists an image again, the last such listing holds."""
    texts = items.where("value_type = 'TEXT' AND text <> ''").groupBy("doc", F.col("parent").alias("item")).agg(F.min_by("text", "item").alias("finding"))
    named = key_images(items).where("ref <> ''").join(texts, ["doc", "item"])
    return named.groupBy("doc", "ref").agg(F.max_by("finding", "item").alias("finding"))


def measurements(items: DataFrame, group: str, identifier: str, uid: str) -> DataFrame:
    """(doc, item, identifier, uid, concept, number, unit) of the numbers in each measurement group; group, identifier and uid are the concepts that mark the container and what it tracks."""
    groups = items.where((F.col("value_type") == "CONTAINER") & (F.col("concept") == group)).select("doc", F.col("item").alias("parent"))
    below = items.where("value_type IN ('TEXT', 'UIDREF', 'NUM')").join(groups, ["doc", "parent"], "left_semi")
    of = lambda kind, code: F.min_by(F.when((F.col("value_type") == kind) & (F.col("concept") == code), F.col("text")), F.when((F.col("value_type") == kind) & (F.col("concept") == code), F.col("item")))
    tracked = below.where("value_type <> 'NUM'").groupBy("doc", "parent").agg(of("TEXT", identifier).alias("identifier"), of("UIDREF", uid).alias("uid"))
    return below.where("value_type = 'NUM'").join(tracked, ["doc", "parent"], "left").select("doc", "item", "identifier", "uid", "concept", "number", "unit")


def primitives(kind: Column, points: Column, starts: Column, number: Column) -> Column:
    """The points of each annotation of a group; null where points and number disagree.

    starts are places in the points, from 1, at which an annotation begins. Without them a POINT has one point, RECTANGLE
    and ELLIPSE have four, and all points are one annotation of any other kind.
    """
    n = F.size(points)
    each = F.when(kind == "POINT", 1).when(kind.isin("RECTANGLE", "ELLIPSE"), 4).otherwise(n)
    begins = F.when(F.size(starts) > 0, starts.cast("array<int>")).when((n > 0) & (each * number == n), F.transform(F.sequence(F.lit(1), number.cast("int")), lambda i: (i - 1) * each + 1))
    ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.array(n + 1))
    right = (F.size(begins) == number) & F.forall(F.zip_with(begins, ends, lambda b, e: (b >= 1) & (e > b) & (e <= n + 1)), lambda ok: ok)
    return F.when(right, F.zip_with(begins, ends, lambda b, e: F.slice(points, b, e - b)))


def applied(images: DataFrame, settings: DataFrame, by: list[str], ref: str, place: str, payload: list[str]) -> DataFrame:
    """images with the payload of the setting of their state (by): the first by place that names the image, else the first that names none, else nulls."""
    first = F.min_by(F.struct(*payload), place)
    named = settings.where(F.col(ref).isNotNull()).groupBy(*by, ref).agg(first.alias("_named"))
    default = settings.where(F.col(ref).isNull()).groupBy(*by).agg(first.alias("_default"))
    chosen = images.join(named, [*by, ref], "left").join(default, by, "left").withColumn("_s", F.coalesce("_named", "_default"))
    return chosen.select(*images.columns, *(F.col("_s")[c].alias(c) for c in payload))


def definition(elements: DataFrame, entries: DataFrame) -> DataFrame:
    """elements (tag, creator, ...) with vr and keyword of the first dictionary that knows them.

    entries are rows (place, tag, creator, vr, keyword): dictionaries in order of place; without a creator the tag is met as
    it is, with one the group and the last byte of a private tag from 0x1000 on (8 hexadecimal digits) are. No match gives nulls.
    """
    first = F.min_by(F.struct("place", "vr", "keyword"), "place")
    key = F.concat(F.substring("tag", 1, 4), F.substring("tag", 7, 2))
    whole = entries.where("creator IS NULL").groupBy("tag").agg(first.alias("_whole"))
    own = entries.where("creator IS NOT NULL").groupBy(F.trim("creator").alias("_creator"), key.alias("_key")).agg(first.alias("_own"))
    data = (F.conv(F.substring("tag", 4, 1), 16, 10).cast("int") % 2 == 1) & (F.substring("tag", 5, 4) >= "1000")
    known = elements.withColumn("_key", F.when(data, key)).withColumn("_creator", F.trim("creator")).join(whole, "tag", "left").join(own, ["_creator", "_key"], "left")
    best = F.when(F.col("_own.place") < F.col("_whole.place"), F.col("_own")).otherwise(F.coalesce("_whole", "_own"))
    return known.withColumn("_d", best).select(*elements.columns, F.col("_d.vr").alias("vr"), F.col("_d.keyword").alias("keyword"))


def template_findings(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, item, concept, finding, n) of the containers that a template's rules don't hold for.

    rules are rows (container, concept, value_type, least, most): what may lie directly below a container of a concept, and
    how often (most null: any number). Findings: missing, too many, wrong type, unexpected (a concept without a rule).
    """
    ruled = rules.select(F.col("container").alias("concept")).distinct()
    holders = items.where("value_type = 'CONTAINER'").join(ruled, "concept", "left_semi").select("doc", "item", F.col("concept").alias("container"))
    below = items.where("parent IS NOT NULL").select("doc", F.col("parent").alias("item"), "concept", F.col("value_type").alias("_type"))
    given = holders.join(below, ["doc", "item"]).groupBy("doc", "item", "container", "concept", "_type").agg(F.count("*").alias("_n"))
    met = given.join(rules, ["container", "concept"], "left")
    counted = met.where("_type = value_type").select("doc", "item", "concept", F.col("_n").alias("n"), "most").where("n > most").select("doc", "item", "concept", F.lit("too many").alias("finding"), "n")
    other = met.where("value_type IS NULL OR _type <> value_type").groupBy("doc", "item", "concept", F.when(F.col("value_type").isNull(), "unexpected").otherwise("wrong type").alias("finding")).agg(F.sum("_n").alias("n"))
    needed = holders.join(rules.where("least > 0"), "container").join(given.select("doc", "item", "concept", F.col("_type").alias("value_type"), "_n"), ["doc", "item", "concept", "value_type"], "left")
    missing = needed.withColumn("n", F.coalesce("_n", F.lit(0))).where("n < least").select("doc", "item", "concept", F.lit("missing").alias("finding"), "n")
    return missing.unionByName(counted).unionByName(other)


def measurement_items(rows: DataFrame, group: str, identifier: str, uid: str) -> DataFrame:
    """The content items of measurements (doc, group, identifier, uid, concept, number, unit), as `measurements` reads them: each group a container of what it tracks and its numbers.

    A document's items are numbered in one task, as they make one report.
    """
    none = F.lit(None).cast("string")
    of = lambda place, kind, concept, text, number=F.lit(None).cast("double"), unit=none: (F.lit(place).alias("_place"), F.lit(kind).alias("value_type"), concept.alias("concept"), text.alias("text"), number.alias("number"), unit.alias("unit"))
    groups = rows.groupBy("doc", "group").agg(F.min("identifier").alias("identifier"), F.min("uid").alias("uid"))
    heads = (groups.select("doc", "group", *of(*h)) for h in ((0, "CONTAINER", F.lit(group), none), (1, "TEXT", F.lit(identifier), F.col("identifier")), (2, "UIDREF", F.lit(uid), F.col("uid"))))
    items = rows.select("doc", "group", *of(3, "NUM", F.col("concept"), none, F.col("number"), F.col("unit")))
    for head in heads:
        items = items.unionByName(head.where("_place = 0 OR text IS NOT NULL"))
    numbered = items.withColumn("item", F.row_number().over(Window.partitionBy("doc").orderBy("group", "_place", "concept", "number", "unit")))
    top = F.min("item").over(Window.partitionBy("doc", "group"))
    return numbered.withColumn("parent", F.when(F.col("_place") > 0, top)).select("doc", "item", "parent", "value_type", "concept", "text", "number", "unit", none.alias("ref"))


def contour_points(text: Column) -> Column:
    """The points (x, y, z) of contour data, numbers parted by backslashes; null unless they are numbers, three to a point."""
    parts = F.transform(F.split(text, r"\\"), lambda v: F.trim(v).try_cast("double"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 3).cast("int") - 1), lambda i: F.struct(*(F.get(parts, i * 3 + k).alias(n) for k, n in enumerate("xyz"))))
    return F.when((F.size(parts) % 3 == 0) & ~F.exists(parts, F.isnull), points)


def contour_text(points: Column) -> Column:
    """Contour data of points, whole numbers without a fraction."""
    one = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    return F.array_join(F.transform(points, lambda p: F.concat_ws("\\", one(p["x"]), one(p["y"]), one(p["z"]))), "\\")
