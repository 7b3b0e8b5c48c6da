"""Queries over objects that refer to others, and over scanned documents, each with SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import shared_dir
from tessera.functions import charsets
from tessera.operators import protocols, registration, relations, templates
from tessera.sources import native_xml, scan, tagged_json

from .queries import query, table

_P = "1.2.840.10008.5.1.4.1.1."
_CLASSES = [f"{_P}{k}" for k in ("66.4", "88.59", "481.3", "88.33", "66.1", "2")] + [""]
_UID = r"^([01]\.([0-9]|[1-3][0-9])|2\.(0|[1-9][0-9]*))(\.(0|[1-9][0-9]*))*$"


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each ten events are the references of an object; some lack identifiers or have wrong ones."""
    k, text = F.col("event_id"), lambda c: F.col(c).cast("string")
    of = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("object") % 7 + 1).cast("int"))
    events = table(spark, sf_dir, "events").withColumn("object", F.floor(k / 10))
    objects = events.groupBy("object").agg(F.min("event_id").alias("k")).select("object", of.alias("sop_class"), (F.col("object") % 9 == 0).alias("malformed"))
    candidates = events.select(
        "object", k.alias("place"), F.when(k % 3 == 0, F.concat(F.lit("1.2."), text("user_id"))).alias("study"), F.when(k % 8 == 0, "1.02").when(k % 8 < 5, F.concat(F.lit(" 1.3."), text("user_id"), F.lit("\0 "))).alias("series"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, "x.1").otherwise(f"{_P}2").alias("sop_class"), F.when(k % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("2.25."), text("user_id"))).alias("sop_instance"), F.lit(None).cast("array<int>").alias("frames"), (k % 5 == 0).alias("segment"),
    )
    return objects, candidates


EDGES = f"""c AS (SELECT event_id // 10 AS object, event_id AS place, CASE WHEN event_id % 3 = 0 THEN '1.2.' || user_id ELSE '' END AS study, CASE WHEN event_id % 8 = 0 THEN '1.02' WHEN event_id % 8 < 5 THEN '1.3.' || user_id ELSE '' END AS series,
CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'x.1' ELSE '{_P}2' END AS sop_class, CASE WHEN event_id % 17 = 0 THEN '' ELSE '2.25.' || user_id END AS sop_instance, event_id % 5 = 0 AS segment, event_id // 10 % 7 AS kind, event_id // 10 % 9 = 0 AS bad FROM events),
o AS (SELECT *, regexp_matches(sop_class, '{_UID}') AS okc, regexp_matches(sop_instance, '{_UID}') AS oki, regexp_matches(study, '{_UID}') AS okt, regexp_matches(series, '{_UID}') AS oks FROM c WHERE kind < 5),
e AS (SELECT object, place, CASE kind WHEN 0 THEN 'source_image' WHEN 1 THEN 'key_object' WHEN 2 THEN 'contour_image' WHEN 3 THEN CASE WHEN segment THEN 'segment' ELSE 'measurement_image' END ELSE 'registration_source' END AS role, study, series, sop_class, sop_instance,
concat_ws(',', CASE WHEN sop_class = '' THEN 'missing_sop_class_uid' WHEN NOT okc THEN 'invalid_sop_class_uid' END, CASE WHEN sop_instance = '' THEN 'missing_sop_instance_uid' WHEN NOT oki THEN 'invalid_sop_instance_uid' END,
CASE WHEN study = '' THEN CASE WHEN kind = 1 AND NOT bad THEN 'missing_study_instance_uid' END WHEN NOT okt THEN 'invalid_study_instance_uid' END, CASE WHEN series = '' THEN CASE WHEN kind < 2 AND NOT bad THEN 'missing_series_instance_uid' END WHEN NOT oks THEN 'invalid_series_instance_uid' END) AS findings
FROM o WHERE NOT bad OR (sop_class <> '' OR sop_instance <> '') AND NOT (okc AND oki))"""


@query(f"WITH {EDGES} SELECT object, place, role, study, series, sop_class, sop_instance, findings, findings = '' AS valid FROM e")
def references_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolved(*_objects(spark, sf_dir)).withColumn("findings", F.array_join("findings", ",")).drop("frames")


@query(f"WITH {EDGES} SELECT object, series AS uid, min(place) AS place FROM e WHERE findings = '' AND series <> '' GROUP BY object, series")
def series_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.referenced(relations.resolved(*_objects(spark, sf_dir)), "series")


@query(f"WITH {EDGES} SELECT object, place, sop_instance FROM e WHERE findings = '' AND sop_instance IN (SELECT '2.25.' || user_id FROM events WHERE value > 250)")
def references_to_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").where("value > 250").select(F.concat(F.lit("2.25."), F.col("user_id").cast("string"), F.lit("\0")).alias("uid"))
    return relations.references_to(relations.resolved(*_objects(spark, sf_dir)), wanted).select("object", "place", "sop_instance")


@query(f"""WITH o AS (SELECT object, [{", ".join(f"'{c}'" for c in _CLASSES)}][1 + object % 7] AS sop_class FROM (SELECT DISTINCT event_id // 10 AS object FROM events)), k AS (SELECT object, CASE WHEN object % 4 = 0 THEN '{_P}30' ELSE sop_class END AS sop_class FROM o)
SELECT object, sop_class, CASE sop_class WHEN '{_P}66.4' THEN 'seg' WHEN '{_P}88.59' THEN 'kos' WHEN '{_P}481.3' THEN 'rtstruct' WHEN '{_P}88.33' THEN 'sr_measurement' WHEN '{_P}66.1' THEN 'registration' WHEN '{_P}30' THEN 'parametric_map' WHEN '' THEN 'other' ELSE 'image' END AS kind, sop_class IN ('{_P}66.4', '{_P}88.59', '{_P}481.3', '{_P}88.33') AS editable FROM k""")
def objects_identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog knows the class of each fourth object better than the object itself."""
    objects, _ = _objects(spark, sf_dir)
    known = objects.select("object", F.when(F.col("object") % 4 == 0, f"{_P}30").otherwise(" ").alias("sop_class"))
    return relations.identified(objects.select("object", "sop_class"), known, ["sop_class"])


@query("SELECT event_id // 10 AS object, CASE max(CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END) WHEN 1 THEN 'RIGID' WHEN 2 THEN 'RIGID_SCALE' WHEN 3 THEN 'AFFINE' END AS type FROM events WHERE event_id % 4 = 0 GROUP BY ALL")
def registration_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("RIGID", "RIGID_SCALE", "AFFINE", "", "OTHER"))), (F.col("user_id") % 5 + 1).cast("int"))
    return relations.registration_types(table(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.floor(F.col("event_id") / 10).alias("object"), kind.alias("type")))


@query("""SELECT CASE WHEN event_id % 97 > 0 THEN '1.2.' || event_id END AS instance_uid, CASE WHEN event_id % 97 > 0 THEN event_type END AS patient_name, CASE WHEN event_id % 97 > 0 AND event_id % 5 > 0 AND event_id % 7 > 0 THEN user_id END AS frames,
CAST(CASE WHEN event_id % 97 > 0 THEN 9 + CAST(event_id % 5 = 0 AS INT) END AS INT) AS missing, CASE WHEN event_id % 97 > 0 THEN CASE WHEN event_id % 5 > 0 AND event_id % 7 = 0 THEN 'number_of_frames' ELSE '' END END AS invalid,
CASE WHEN event_id % 97 > 0 THEN '00400275[1].00400007=b' || event_id % 3 END AS step, CASE WHEN event_id % 97 = 0 THEN 'read' END AS error FROM events""")
def documents_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as documents, one a line, written as text files and scanned; each 97th is broken."""
    k, text = F.col("event_id"), lambda c: F.col(c).cast("string")
    frames = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"00280008":{"vr":"IS","Value":["'), F.when(k % 7 == 0, "x").otherwise(text("user_id")), F.lit('"]}')))
    steps = F.concat(F.lit(',"00400275":{"vr":"SQ","Value":[{"00400007":{"vr":"LO","Value":["a"]}},{"00400007":{"vr":"LO","Value":["b'), (k % 3).cast("string"), F.lit('"]}}]}}'))
    whole = F.concat(F.lit('{"00080018":{"vr":"UI","Value":["1.2.'), text("event_id"), F.lit('"]},"00100010":{"vr":"PN","Value":[{"Alphabetic":"'), F.col("event_type"), F.lit('"}]}'), frames, steps)
    path = f"{shared_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.when(k % 97 == 0, '{"broken').otherwise(whole)).write.text(path)
    rows = scan.scan(spark, path, profile=("core", "patient"), selectors=(scan.Selector("step", "00400007", ("00400275",)),), lines=True, suffixes=(".txt",), max_errors=1 << 40)
    step = F.get(F.col("selected")["step"], F.lit(0))
    return rows.select("instance_uid", "patient_name", F.col("number_of_frames").alias("frames"), F.when(F.col("error").isNull(), F.size("missing")).alias("missing"), F.array_join("invalid", ",").alias("invalid"), F.concat(step["path"], F.lit("="), F.get(step["values"], F.lit(0))).alias("step"), "error")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'plain ' || user_id WHEN 1 THEN chr(CAST(192 + user_id % 60 AS INT)) || 'x' WHEN 2 THEN chr(CAST(1040 + user_id % 60 AS INT)) || '^a' WHEN 3 THEN 'A=' || chr(CAST(12449 + user_id % 80 AS INT)) || '='
WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN chr(CAST(192 + user_id % 60 AS INT)) END WHEN 6 THEN chr(CAST(65377 + user_id % 60 AS INT)) || '¥' END AS text, CASE event_id % 8 WHEN 4 THEN CASE WHEN user_id % 2 = 1 THEN 'bytes' END WHEN 5 THEN 'unreturned' WHEN 7 THEN CASE WHEN user_id % 2 = 0 THEN 'escape' ELSE 'declaration' END END AS finding,
CAST(CASE event_id % 8 WHEN 4 THEN CASE WHEN user_id % 2 = 1 THEN 1 END WHEN 5 THEN 8 WHEN 7 THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END END AS INT) AS place FROM events""")
def texts_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in eight declared character sets, some of them in wrong bytes."""
    kind, user = F.col("event_id") % 8, F.col("user_id")
    byte = lambda low, n: F.lpad(F.hex(low + user % n), 2, "0")
    of = [F.hex(F.encode(F.concat(F.lit("plain "), user.cast("string")), "UTF-8")), F.concat(byte(0xC0, 60), F.lit("78")), F.concat(byte(0xB0, 60), F.lit("5E61")), F.concat(F.lit("413D1B244225"), byte(0x21, 80), F.lit("1B28423D")),
          F.when(user % 2 == 0, F.concat(F.lit("C3"), byte(0x80, 60))).otherwise("41FF"), F.lit("411B24422524255C"), F.concat(byte(0xA1, 60), F.lit("5C")), F.when(user % 2 == 0, "411B2D46").otherwise("41")]
    codes = ["", "ISO_IR 100", "ISO 2022 IR 144\\ISO 2022 IR 87", "\\ISO 2022 IR 87", "ISO_IR 192", "\\ISO 2022 IR 87", "ISO_IR 13"]
    data, code = of[7], F.when(user % 2 == 0, "\\ISO 2022 IR 87").otherwise("ISO_IR 999")
    for k in range(6, -1, -1):
        data, code = F.when(kind == k, of[k]).otherwise(data), F.when(kind == k, codes[k]).otherwise(code)
    vr = F.when(kind.isin(2, 3), "PN").when(kind == 6, "LT").otherwise("LO")
    found = table(spark, sf_dir, "events").withColumn("d", charsets.decoded(F.unhex(data), code, vr))
    return found.select("event_id", "d.text", "d.finding", F.col("d.offset").alias("place"))


_CORNERS = ", ".join(f"({a}, {b}, {c})" for c in (0, 1) for b in (0, 1) for a in (0, 1))


@query(f"""WITH p AS (SELECT event_id, user_id % 3 AS reg, event_id % 11 * 0.8 AS x, event_id % 7 * 0.5 AS y, event_id % 9 * 0.125 AS z FROM (SELECT CAST(event_id AS DOUBLE) AS event_id, user_id FROM events)),
v AS (SELECT user_id % 3 AS reg, event_id % 5 AS i, event_id // 5 % 4 AS j, event_id // 20 % 3 AS k, max(value) / 97 AS d FROM events WHERE NOT (event_id % 5 = 2 AND event_id // 5 % 4 = 2) AND user_id % 3 < 2 GROUP BY ALL),
c AS (SELECT *, x / 2 AS a, y / 1 AS b, z / 0.5 AS c, reg = 2 OR x / 2 BETWEEN -1e-9 AND 4 + 1e-9 AND y BETWEEN -1e-9 AND 3 + 1e-9 AND z / 0.5 BETWEEN -1e-9 AND 2 + 1e-9 AS inside FROM p),
w AS (SELECT event_id, reg, CAST(least(floor(least(a, 4)) + da, 4) AS BIGINT) AS i, CAST(least(floor(least(b, 3)) + db, 3) AS BIGINT) AS j, CAST(least(floor(least(c, 2)) + dc, 2) AS BIGINT) AS k, CASE da WHEN 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END * CASE db WHEN 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END * CASE dc WHEN 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END AS w FROM c, (VALUES {_CORNERS}) AS s(da, db, dc) WHERE reg < 2 AND inside),
m AS (SELECT event_id, count(*) = count(d) AS whole, sum(w * d) AS d FROM w LEFT JOIN v USING (reg, i, j, k) WHERE w <> 0 GROUP BY event_id),
e AS (SELECT c.*, coalesce(d, 0) AS d, CASE WHEN NOT inside THEN 'outside' WHEN reg < 2 AND NOT coalesce(whole, false) THEN 'undefined' END AS error FROM c LEFT JOIN m USING (event_id))
SELECT CAST(event_id AS BIGINT) AS event_id, round(CASE WHEN error IS NULL THEN 2 * (y + 1 + d) END, 6) AS source_x, round(CASE WHEN error IS NULL THEN 3 - (x + (reg + 1) * z - d) END, 6) AS source_y, round(CASE WHEN error IS NULL THEN z + d * 0.5 END, 6) AS source_z, error FROM e""")
def points_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of three registrations, two of them with a field of 5 x 4 x 3 cells of which some are missing."""
    k, array = F.col("event_id"), lambda *v: F.array(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v))
    events = table(spark, sf_dir, "events").withColumn("reg", F.col("user_id") % 3)
    points = events.select("event_id", "reg", (k % 11 * 0.8).alias("x"), (k % 7 * 0.5).alias("y"), (k % 9 * 0.125).alias("z"))
    grid = lambda *v: F.when(F.col("reg") < 2, array(*v))
    registrations = events.select("reg").distinct().select(
        "reg", array(0, 1, 0, 1, 1, 0, (F.col("reg") + 1).cast("double"), 0, 0, 0, 1, 0, 0, 0, 0, 1).alias("pre"), array(2, 0, 0, 0, 0, -1, 0, 3, 0, 0, 1, 0, 0, 0, 0, 1).alias("post"),
        grid(0, 0, 0).alias("origin"), grid(1, 0, 0).alias("row"), grid(0, 1, 0).alias("col"), grid(0, 0, 1).alias("normal"), grid(2, 1, 0.5).alias("spacing"), grid(5, 4, 3).alias("cells"),
    )
    i, j, n = k % 5, F.floor(k / 5) % 4, F.floor(k / 20) % 3
    d = F.max("value") / 97
    vectors = events.where(~((i == 2) & (j == 2)) & (F.col("reg") < 2)).groupBy("reg", i.alias("i"), j.alias("j"), n.alias("k")).agg(d.alias("dx"), (-d).alias("dy"), (d * 0.5).alias("dz"))
    found = registration.to_source(points, registrations, vectors)
    return found.select("event_id", *(F.round(f"source.{c}", 6).alias(f"source_{c}") for c in "xyz"), "error")


@query("""WITH i AS (SELECT o_orderkey AS image, o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority FROM orders),
s AS (SELECT n_nationkey AS protocol, ['F', 'O', 'P'][1 + n_nationkey % 3] AS status, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + n_nationkey % 5] AS priority FROM nation)
SELECT image, protocol, 1 AS number FROM i JOIN s ON i.status = s.status AND (i.priority IS NULL OR i.priority = s.priority) UNION ALL SELECT image, protocol, 2 FROM i JOIN s ON i.priority IS NULL OR i.priority = s.priority WHERE protocol < 3""")
def image_sets_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image sets of one protocol for each nation, against all orders as images; the second sets need nothing to be there."""
    orders, of = table(spark, sf_dir, "orders"), lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("n_nationkey") % n + 1).cast("int"))
    none = F.array().cast("array<string>")
    elements = orders.select(F.col("o_orderkey").alias("image"), F.lit("00080060").alias("tag"), none.alias("path"), F.array("o_orderstatus").alias("values")).union(
        orders.where("o_orderkey % 5 > 0").select("o_orderkey", F.lit("00081030"), F.array(F.lit("00400275")), F.array(F.lit("other"), F.concat(F.lit(" "), "o_orderpriority"))))
    nation = table(spark, sf_dir, "nation").withColumn("p", of(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), 5)).withColumn("s", of("FOP", 3))
    rule = lambda number, tag, path, usage, n, value: F.struct(F.lit(number).alias("number"), F.lit(tag).alias("tag"), path.alias("path"), F.lit(usage).alias("usage"), F.lit(n).alias("value_number"), F.array(F.lit("X"), value).alias("values"))
    status, priority = rule(1, "00080060", none, "NO_MATCH", 1, F.col("s")), [rule(n, "00081030", F.array(F.lit("00400275")), "MATCH", 2, F.col("p")) for n in (1, 2)]
    selectors = nation.select(F.col("n_nationkey").alias("protocol"), F.explode(F.when(F.col("n_nationkey") < 3, F.array(status, *priority)).otherwise(F.array(status, priority[0]))).alias("r")).select("protocol", "r.*")
    return protocols.image_sets(elements, selectors)


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 13 > 0)
SELECT c_custkey, '00100010' AS tag, 'PN' AS vr, c_name || '^' || replace(c_mktsegment, 'A', '&') AS text FROM c UNION ALL SELECT c_custkey, '00280010', 'US', CAST(c_nationkey AS VARCHAR) FROM c UNION ALL SELECT c_custkey, '00400275/00400007', 'LO', 'a<b ' || c_nationkey FROM c
UNION ALL SELECT c_custkey, 'fault', '', 'xml' FROM customer WHERE c_custkey % 13 = 0""")
def xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as XML documents: names, numbers and an item's text; each thirteenth is cut off."""
    escaped = F.replace(F.col("c_mktsegment"), F.lit("A"), F.lit("&amp;"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><NativeDicomModel xmlns="http://dicom.nema.org/PS3.19/models/NativeDICOM"><DicomAttribute tag="00100010" vr="PN" keyword="PatientName"><PersonName number="1"><Alphabetic><FamilyName>'), "c_name", F.lit("</FamilyName><GivenName>"), escaped,
        F.lit('</GivenName></Alphabetic></PersonName></DicomAttribute><DicomAttribute tag="00280010" vr="US"><Value number="1">'), F.col("c_nationkey").cast("string"), F.lit('</Value></DicomAttribute><DicomAttribute tag="00400275" vr="SQ"><Item number="1"><DicomAttribute tag="00400007" vr="LO"><Value number="1">a&lt;b '),
        F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 13 == 0, "</Value>").otherwise("</Value></DicomAttribute></Item></DicomAttribute></NativeDicomModel>"),
    )
    docs = table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml"))
    rows = native_xml.elements(docs, "c_custkey", "xml")
    text = tagged_json.text(F.col("values"), F.col("vr")).alias("text")
    inner = tagged_json.items(rows, "c_custkey", "00400275").select("c_custkey", F.concat(F.lit("00400275/"), "tag").alias("tag"), "vr", text)
    return rows.where("vr <> 'SQ'").select("c_custkey", "tag", "vr", text).union(inner).union(native_xml.faults(docs, "c_custkey", "xml").select("c_custkey", F.lit("fault"), F.lit(""), "fault"))


@query("""WITH e AS (SELECT event_id // 40 AS doc, event_id % 40 AS item, CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 8 = 1 THEN 0 ELSE 1 + 8 * ((event_id % 40 - 1) // 8) END AS parent, CASE WHEN event_id % 40 = 0 OR event_id % 8 = 1 THEN 'CONTAINER' ELSE ['NUM', 'TEXT', 'CODE'][1 + user_id % 3] END AS kind,
CASE WHEN event_id % 8 = 1 THEN 'group' WHEN event_id % 40 = 0 THEN 'report' ELSE ['size', 'note', 'flag', 'unit', 'x'][1 + CAST(floor(value) AS INT) % 5] END AS concept, CASE WHEN value > 150 THEN 'odd' ELSE '' END AS text FROM events),
l AS (SELECT *, CASE WHEN concept = 'size' AND kind = 'NUM' OR concept = 'note' AND kind = 'TEXT' OR concept = 'unit' AND kind = 'CODE' THEN 'g/' || concept END AS met FROM e WHERE parent > 0),
g AS (SELECT doc, parent AS item, count(CASE WHEN met = 'g/size' THEN 1 END) AS sizes, count(CASE WHEN met = 'g/note' THEN 1 END) AS notes, count(CASE WHEN met = 'g/unit' THEN 1 END) AS units, bool_or(concept = 'flag') AS flagged FROM l GROUP BY ALL), d AS (SELECT doc, NOT bool_or(concept = 'x' AND text = 'odd') AS plain FROM e GROUP BY doc)
SELECT doc, item, CASE WHEN concept IN ('size', 'note', 'unit') THEN 'g/' || concept END AS rule, CASE WHEN concept IN ('size', 'note', 'unit') THEN 'type' ELSE 'unknown' END AS finding FROM l WHERE met IS NULL
UNION ALL SELECT doc, item, 'g/size', CASE WHEN sizes < 1 THEN 'missing' ELSE 'too many' END FROM g WHERE sizes < 1 OR sizes > 2 UNION ALL SELECT doc, item, 'g/note', CASE WHEN flagged THEN 'missing' ELSE 'not allowed' END FROM g WHERE flagged AND notes < 1 OR NOT flagged AND notes > 0
UNION ALL SELECT doc, item, 'g/unit', CASE WHEN plain THEN 'too many' ELSE 'not allowed' END FROM g JOIN d USING (doc) WHERE NOT plain AND units > 0 OR units > 1""")
def template_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of forty items in five groups, against a template that includes another, with conditions in a group and in the document."""
    k = F.col("event_id")
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    top, group = k % 40 == 0, k % 8 == 1
    items = table(spark, sf_dir, "events").select(
        F.floor(k / 40).alias("doc"), (k % 40).alias("item"), F.when(group & ~top, 0).when(~top, 1 + 8 * F.floor((k % 40 - 1) / 8)).alias("parent"), F.lit("CONTAINS").alias("relationship"), F.when(top | group, "CONTAINER").otherwise(pick(("NUM", "TEXT", "CODE"), F.col("user_id") % 3)).alias("value_type"),
        F.when(group, "group").when(top, "report").otherwise(pick(("size", "note", "flag", "unit", "x"), F.floor("value") % 5)).alias("concept"), F.when(F.col("value") > 150, "odd").otherwise("").alias("text"),
    )
    rules = spark.createDataFrame(
        [("T", "group", None, 1, "CONTAINS", "CONTAINER", "group", 5, 5, "M", None, None), ("T", "g", "group", 1, *[None] * 7, "G"), ("G", "size", None, 1, None, "NUM", "size", 1, 2, "M", None, None), ("G", "note", None, 2, None, "TEXT", "note", 1, None, "MC", "flagged", None), ("G", "unit", None, 3, None, "CODE", "unit", 0, 1, "UC", "plain", None)],
        "template string, rule string, under string, place int, relationship string, value_type string, concept string, least int, most int, requirement string, condition string, include string",
    )
    conditions = spark.createDataFrame([("flagged", "container", "flag", None, False), ("plain", "document", "x", "odd", True)], "condition string, scope string, concept string, text string, absent boolean")
    roots = items.where("item = 0").select("doc", "item", F.lit("T").alias("template"))
    return templates.findings(items, rules, conditions, roots).select("doc", "item", "rule", "finding")
