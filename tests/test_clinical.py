"""Registrations, display protocols, XML documents and references, on small rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import protocols, registration, relations
from tessera.sources import native_xml, tagged_json


def test_points_of_a_registration(spark):
    rng = np.random.default_rng(2)
    cells = np.array([4, 3, 2])
    field = rng.normal(size=(*cells, 3))
    axes, origin, spacing = np.array([[0, 1, 0], [0, 0, 1], [1, 0, 0]], float), np.array([1.0, -2, 3]), np.array([2.0, 0.5, 1.5])
    pre, post = (np.vstack((rng.normal(size=(3, 4)), [0, 0, 0, 1])) for _ in "ab")
    inside = rng.uniform(0, 1, size=(40, 3)) * (cells - 1)
    inside[0] = 0, 0, 0
    inside[1] = cells - 1
    points = np.vstack((origin + (inside * spacing) @ axes, origin + (np.array([[-0.1, 0, 0], [3.01, 0, 0], [1.5, 1, 1]]) * spacing) @ axes))
    rows = [("r", k, *map(float, p)) for k, p in enumerate(points)] + [("r", 90, float("nan"), 0.0, 0.0), ("plain", 91, 1.0, 2.0, 3.0), ("no", 92, 1.0, 2.0, 3.0), (None, 93, 1.0, None, 3.0)]
    lists = lambda *a: [list(map(float, np.ravel(x))) for x in a]
    regs = [("r", *lists(pre, post, origin, *axes, spacing, cells)), ("plain", *lists(pre, post), *[None] * 6)]
    schema = "reg string, " + ", ".join(f"{c} array<double>" for c in ("pre", "post", "origin", "row", "col", "normal", "spacing", "cells"))
    undefined = (1, 1, 1)
    vectors = [("r", *at, *map(float, field[at])) for at in np.ndindex(*cells) if at != undefined] + [("r", *undefined, float("nan"), 0.0, 0.0)]
    found = {r.id: r for r in registration.to_source(spark.createDataFrame(rows, "reg string, id int, x double, y double, z double"), spark.createDataFrame(regs, schema), spark.createDataFrame(vectors, "reg string, i int, j int, k int, dx double, dy double, dz double")).collect()}

    def want(p, c):
        low = np.minimum(np.floor(c).astype(int), cells - 1)
        d = np.zeros(3)
        for up in np.ndindex(2, 2, 2):
            w = np.prod(np.where(up, c - low, 1 - (c - low)))
            at = tuple(np.minimum(low + up, cells - 1))
            if w and at == undefined:
                return "undefined"
            d += w * field[at] if w else 0
        return (post @ [*((pre @ [*p, 1])[:3] + d), 1])[:3]

    seen = set()
    for k, (p, c) in enumerate(zip(points[:40], inside, strict=True)):
        w = want(p, c)
        seen.add(w if isinstance(w, str) else "source")
        assert found[k].error == w if isinstance(w, str) else found[k].error is None and np.allclose(found[k].source, w)
    assert seen == {"undefined", "source"}
    assert [found[k].error for k in (40, 41, 42, 90, 92, 93)] == ["outside", "outside", "undefined", "invalid", "invalid", "invalid"] and found[90].source is None
    assert np.allclose(found[91].source, (post @ [*(pre @ [1, 2, 3, 1])[:3], 1])[:3])


def test_image_sets(spark):
    e = [("a", "00080060", [], ["CT"]), ("a", "00081030", [], ["x", "chest "]), ("b", "00080060", [], ["MR"]), ("b", "00080060", ["00400275"], ["CT"]), ("c", "00100010", [], ["n"]), ("d", "00080060", [], None)]
    elements = spark.createDataFrame(e, "image string, tag string, path array<string>, values array<string>")
    s = [
        (1, 1, 0, "00080060", [], "NO_MATCH", 1, ["CT", "MR"]), (1, 1, 1, "00081030", [], "MATCH", 2, ["chest"]), (1, 2, 0, "00080060", ["00400275"], "no_match", 0, ["CT"]),
        (2, 1, 0, "00081030", None, "MATCH", 1, ["x"]), (2, 2, 0, "00081030", [], "NO_MATCH", 3, ["x"]), (2, 3, 0, "00080060", [], "MATCH", None, []), (3, 1, 0, "00080060", [], "NO_MATCH", 1, None),
    ]
    selectors = spark.createDataFrame(s, "protocol int, number int, place int, tag string, path array<string>, usage string, value_number int, values array<string>")
    found = {tuple(r) for r in protocols.image_sets(elements, selectors).collect()}
    assert found == {("a", 1, 1), ("b", 1, 1), ("b", 1, 2), *((i, 2, 1) for i in "abcd"), ("c", 2, 3)}
    with pytest.raises(ValueError):
        protocols.image_sets(elements, selectors, most_open=1)
    bad = spark.createDataFrame([(1, 1, 0, "x", ["y"], "MAYBE", -1, ["a"]), (1, 1, 1, "00080060", [], "MATCH", 0, ["a"])], selectors.schema)
    assert {(r.place, r.finding) for r in protocols.checked(bad, 1).collect()} == {(0, "usage"), (0, "tag"), (0, "value_number"), (0, "path"), (None, "too many")}
    assert protocols.checked(selectors).count() == 0


DOC = {
    "00080005": {"vr": "CS", "Value": [None, "ISO 2022 IR 87"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "A^B", "Ideographic": "山田^太郎"}]}, "00104000": {"vr": "LT", "Value": ["<a> & \"b\""]}, "00181130": {"vr": "DS", "Value": ["1.50"]}, "00280010": {"vr": "US", "Value": [512, 7]}, "00281052": {"vr": "FD", "Value": [0.5]},
    "00400275": {"vr": "SQ", "Value": [{"00400007": {"vr": "LO", "Value": ["s"]}, "0040A730": {"vr": "SQ", "Value": [{"00080100": {"vr": "SH", "Value": ["deep"]}}, {}]}}]}, "00420011": {"vr": "OB", "InlineBinary": "AQID/w=="}, "00700006": {"vr": "ST"}, "7FE00010": {"vr": "OW", "BulkDataURI": "bulk/1?a=1&b=\"2\""},
}


def test_xml_comes_back_at_any_depth(spark):
    docs = spark.createDataFrame([(1, json.dumps(DOC)), (2, "{}"), (3, None)], "id long, text string")
    rows = tagged_json.elements(docs, "id", "text")
    xml = native_xml.documents(rows, "id")
    again = native_xml.elements(xml, "id", "xml")
    plain = lambda df: sorted((r.tag, r.vr, [json.loads(v) if v and v[0] == "{" else v for v in r["values"]], r.uri, r.binary) for r in df.collect())
    assert plain(again) == plain(rows) and native_xml.faults(xml, "id", "xml").count() == 0
    assert json.loads(native_xml.to_json(native_xml.to_xml(json.dumps(DOC)))[0]) == DOC
    assert tagged_json.walked(xml.select("id", F.lit(native_xml.to_json(native_xml.to_xml(json.dumps(DOC)))[0]).alias("t")), "id", "t").where("path = '00400275[0].0040A730[0].00080100'").first()["values"] == ["deep"]


@pytest.mark.parametrize(
    "xml,fault",
    [
        ("", "xml"), ("<a>", "xml"), ("<a/>", "root"), ('<!DOCTYPE x [<!ENTITY e "v">]><NativeDicomModel/>', "document type"), ('<NativeDicomModel><DicomAttribute tag="1" vr="LO"/></NativeDicomModel>', "attribute"), ("<NativeDicomModel><Other/></NativeDicomModel>", "attribute"),
        ('<NativeDicomModel><DicomAttribute tag="00100020" vr="LO"><Value number="0">a</Value></DicomAttribute></NativeDicomModel>', "number"), ('<NativeDicomModel><DicomAttribute tag="00100020" vr="LO"><Value>a</Value></DicomAttribute></NativeDicomModel>', "number"), ('<NativeDicomModel><DicomAttribute tag="00100020" vr="LO"><Value number="1">a</Value><Value number="1">a</Value></DicomAttribute></NativeDicomModel>', "number"),
        ('<NativeDicomModel><DicomAttribute tag="00100010" vr="PN"><PersonName number="1"><Other/></PersonName></DicomAttribute></NativeDicomModel>', "name"), ('<NativeDicomModel><DicomAttribute tag="00100020" vr="LO"/><DicomAttribute tag="00100020" vr="LO"/></NativeDicomModel>', "attribute"),
    ],
)
def test_what_is_no_such_xml(xml, fault):
    assert native_xml.to_json(xml) == (None, fault)


def test_faults_and_nulls(spark):
    docs = spark.createDataFrame([(1, "<a>"), (2, None), (3, "<NativeDicomModel/>")], "id long, xml string")
    assert [tuple(r) for r in native_xml.faults(docs, "id", "xml").collect()] == [(1, "xml")] and native_xml.elements(docs, "id", "xml").count() == 0


def test_references_of_malformed_and_unknown_objects(spark):
    p = "1.2.840.10008.5.1.4.1.1."
    objects = spark.createDataFrame([("s", f"{p}66.4\0", True), ("m", f" {p}88.33 ", None), ("i", f"{p}2", False), (None, f"{p}66.4", False)], "object string, sop_class string, malformed boolean")
    c = [
        ("s", 0, None, None, f"{p}2", "1.2.3", None, False), ("s", 1, None, None, f"{p}2", "", None, False), ("s", 2, None, None, None, None, None, False), ("m", 0, None, "1.2", f"{p}66.4", "1.2.3", [1], True), ("m", 1, "x", "y", f"{p}2", "1.02", None, None),
        ("i", 0, None, None, f"{p}2", "1.2.3", None, False), ("gone", 0, None, None, f"{p}2", "1.2.3", None, False), (None, 0, None, None, None, None, None, None),
    ]
    candidates = spark.createDataFrame(c, "object string, place int, study string, series string, sop_class string, sop_instance string, frames array<int>, segment boolean")
    found = {(r.object, r.place): (r.role, r.findings, r.valid) for r in relations.resolved(objects, candidates).collect()}
    assert found == {("s", 1): ("source_image", ["missing_sop_instance_uid"], False), ("m", 0): ("segment", [], True), ("m", 1): ("measurement_image", ["invalid_sop_instance_uid", "invalid_study_instance_uid", "invalid_series_instance_uid"], False)}
    kinds = objects.select("object", relations.object_kind(F.col("sop_class")).alias("k"), relations.is_editable(F.col("sop_class")).alias("e")).collect()
    assert {r.object: (r.k, r.e) for r in kinds} == {"s": ("seg", True), "m": ("sr_measurement", True), "i": ("image", False), None: ("seg", True)}
