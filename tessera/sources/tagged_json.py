"""Tagged JSON documents ({"00100010": {"vr": "PN", "Value": [...]}}) to rows of elements and back, by JVM functions.

An element is a row (key, tag, vr, values, uri, binary): values are texts, those of names and sequences the JSON of their
items; binary is the base64 text of a value in bytes.
Null or malformed documents have no elements. An element without Value has an empty list; null items stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

#: Value representations whose values are JSON numbers (fixed values); decimal and integer strings stay strings.
NUMBERS = ("FD", "FL", "OV", "SL", "SS", "SV", "UL", "US", "UV")
#: Those whose values are JSON objects.
OBJECTS = ("PN", "SQ")
ELEMENT = "map<string, struct<vr: string, Value: array<string>, BulkDataURI: string, InlineBinary: string>>"


def elements(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, tag, vr, values, uri, binary), one row for each element of each document's top level."""
    each = docs.select(key, F.explode(F.from_json(json, ELEMENT)).alias("tag", "e"))
    return each.select(key, F.upper("tag").alias("tag"), F.col("e.vr").alias("vr"), F.coalesce("e.Value", F.array().cast("array<string>")).alias("values"), F.col("e.BulkDataURI").alias("uri"), F.col("e.InlineBinary").alias("binary"))


def items(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, item, tag, vr, values, uri, binary) of the items of the sequence `tag`; item counts from 0."""
    each = rows.where((F.col("tag") == tag) & (F.col("vr") == "SQ")).select(key, F.posexplode("values").alias("item", "json"))
    return elements(each.withColumn("_at", F.struct(key, "item")), "_at", "json").select("_at.*", "tag", "vr", "values", "uri", "binary")


def texts(values: Column, vr: Column) -> Column:
    """The values that aren't empty, trimmed; of a name the first of its alphabetic, ideographic and phonetic forms; whole numbers without a fraction."""
    name = lambda v: F.coalesce(*(F.nullif(F.get_json_object(v, f"$.{form}"), F.lit("")) for form in ("Alphabetic", "Ideographic", "Phonetic")))
    number = lambda v: F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1")
    each = F.transform(values, lambda v: F.trim(F.when(vr == "PN", name(v)).when(vr.isin(*NUMBERS), number(v)).otherwise(v)))
    return F.filter(each, lambda v: v.isNotNull() & (v != ""))


def text(values: Column, vr: Column) -> Column:
    """The first value that isn't empty; null if there is none."""
    return F.get(texts(values, vr), F.lit(0))


def documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, json) of rows of elements: tags in order, no group lengths (xxxx0000), numbers that JSON can't hold as strings. Rows may come without `binary`.

    A document's elements meet in one task, as they must to be one JSON text; of a tag given twice one element stays.
    """
    quoted = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"^\[(.*)\]$", 1)
    plain = lambda v: F.col("vr").isin(*OBJECTS) | (F.col("vr").isin(*NUMBERS) & v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    body = F.array_join(F.transform("values", lambda v: F.when(v.isNull(), "null").when(plain(v), v).otherwise(quoted(v))), ",")
    empty = (F.size("values") == 0) | ((F.size("values") == 1) & (F.coalesce(F.get("values", F.lit(0)), F.lit("")) == ""))
    rows = rows if "binary" in rows.columns else rows.withColumn("binary", F.lit(None).cast("string"))
    value = F.when(F.col("uri").isNotNull(), F.concat(F.lit(',"BulkDataURI":'), quoted(F.col("uri")))).when(F.col("binary").isNotNull(), F.concat(F.lit(',"InlineBinary":'), quoted(F.col("binary")))).when(empty, "").otherwise(F.concat(F.lit(',"Value":['), body, F.lit("]")))
    one = F.concat(F.lit('"'), "tag", F.lit('":{"vr":"'), "vr", F.lit('"'), value, F.lit("}"))
    kept = rows.where(~F.col("tag").endswith("0000")).select(key, "tag", one.alias("one"))
    unique = kept.groupBy(key, "tag").agg(F.min("one").alias("one"))
    sorted_ = F.array_sort(F.collect_list(F.struct("tag", "one")))
    return unique.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.transform(sorted_, lambda e: e["one"]), ","), F.lit("}")).alias("json"))


def walked(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, tag, vr, values) of all elements, also those in items of sequences at any depth; path is 00400275[0].00400007 (items from 0).

    Each round opens the sequences of one depth, for all documents at once.
    """
    level = checkpointed(elements(docs, key, json).withColumn("path", F.col("tag")))
    found = level
    while True:
        opened = level.where("vr = 'SQ'").select(key, "path", F.posexplode("values").alias("i", "json"))
        inner = elements(opened.withColumn("_at", F.struct(key, F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("].")).alias("path"))), "_at", "json")
        level = checkpointed(inner.select(F.col(f"_at.{key}").alias(key), "tag", "vr", "values", "uri", "binary", F.concat("_at.path", "tag").alias("path")))
        if level.isEmpty():
            return found.select(key, "path", "tag", "vr", "values")
        found = found.unionByName(level)


def integers(values: Column) -> Column:
    """The values as whole numbers; null if one isn't."""
    each = F.transform(values, lambda v: F.trim(v).try_cast("long"))
    return F.when(~F.exists(each, F.isnull) & ~F.exists(values, lambda v: ~F.trim(v).rlike(r"^[+-]?\d+$")), each)


def decimals(values: Column) -> Column:
    """The values as doubles; null if one isn't a number."""
    each = F.transform(values, lambda v: F.trim(v).try_cast("double"))
    return F.when(~F.exists(each, F.isnull), each)


def records(rows: DataFrame, key: str, tags: dict[str, str]) -> DataFrame:
    """One row for each document: the first text of each tag, under the name given, and `kept`, the elements it is taken from that hold a value."""
    named = F.col("tag").isin(*tags.values())
    of = lambda tag: F.max(F.when(F.col("tag") == tag, text(F.col("values"), F.col("vr"))))
    return rows.groupBy(key).agg(*(of(t).alias(n) for n, t in tags.items()), F.count(F.when(named & text(F.col("values"), F.col("vr")).isNotNull(), 1)).alias("kept"))


def put(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with the elements of `new` in place of those of the same document and tag."""
    return rows.join(new.select(key, "tag"), [key, "tag"], "left_anti").unionByName(new)


def store_result(rows: DataFrame, key: str) -> DataFrame:
    """(key, outcome, instance, reason) of the answers to a store: instances that are stored, stored with a warning, or failed."""
    # fixed values: the sequences, and in their items the instance and the reasons
    listed, failed, instance, warned, reason = "00081199", "00081198", "00081155", "00081196", "00081197"
    each = items(rows, key, listed).withColumn("_failed", F.lit(False)).union(items(rows, key, failed).withColumn("_failed", F.lit(True)))
    of = lambda tag: F.max(F.when(F.col("tag") == tag, text(F.col("values"), F.col("vr"))))
    one = each.groupBy(key, "_failed", "item").agg(of(instance).alias("instance"), of(warned).alias("_warned"), of(reason).alias("_reason"))
    outcome = F.when(F.col("_failed"), "failed").when(F.col("_warned").isNotNull(), "warning").otherwise("stored")
    return one.select(key, outcome.alias("outcome"), "instance", F.when(F.col("_failed"), F.col("_reason")).otherwise(F.col("_warned")).alias("reason"))


def query_string(values: dict[str, Column]) -> Column:
    """The search parameters name=value that aren't empty, by name, joined by & and encoded."""
    one = lambda n, v: F.when(F.trim(v) != "", F.concat(F.lit(n + "="), F.url_encode(F.trim(v))))
    return F.concat_ws("&", *(one(n, v) for n, v in sorted(values.items())))
