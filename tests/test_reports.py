"""Outlines, reports, annotations, definitions and store answers on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import measures, temporal
from tessera.operators import catalog, masks, reports, workflow
from tessera.sources import tagged_json

ITEMS = "doc int, item int, parent int, value_type string, concept string, text string, number double, unit string, ref string"


def corners(spark, pixels):
    found = masks.contours(spark.createDataFrame([("s", y, x) for y, x in pixels], "seg string, y int, x int")).orderBy("contour", "place").collect()
    out = {}
    for r in found:
        out.setdefault(tuple(r.contour), []).append((r.x, r.y))
    return list(out.values())


def test_outline_of_one_pixel(spark):
    assert corners(spark, [(2, 3)]) == [[(3, 2), (4, 2), (4, 3), (3, 3)]]


def test_outline_of_a_hole_runs_the_other_way(spark):
    outer, hole = corners(spark, [(y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)])
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    assert area(outer) == 9 and area(hole) == -1


def test_pixels_that_touch_by_a_corner_have_outlines_of_their_own(spark):
    assert [len(c) for c in corners(spark, [(0, 0), (1, 1)])] == [4, 4]


def test_long_outline(spark):
    assert [len(c) for c in corners(spark, [(0, x) for x in range(100)])] == [4]


def test_no_mask_no_outline(spark):
    assert corners(spark, []) == []


def test_rectangle_inside_polygon(spark):
    shape = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    at = lambda v: (F.lit(v), F.lit(v))
    row = spark.range(1).select(measures.polygon_meets(shape, at(4.0), at(5.0)), measures.polyline_meets(shape, at(4.0), at(5.0), True), measures.polyline_meets(shape, at(10.0), at(12.0)), measures.polygon_meets(shape, at(11.0), at(12.0))).first()
    assert tuple(row) == (True, False, True, False)


def test_key_findings_take_the_last_listing(spark):
    rows = [(1, 1, None, "IMAGE", None, None, None, None, "a"), (1, 2, 1, "TEXT", None, "", None, None, None), (1, 3, 1, "TEXT", None, "first", None, None, None), (1, 4, None, "IMAGE", None, None, None, None, "a"), (1, 5, 4, "TEXT", None, "last", None, None, None), (1, 6, None, "IMAGE", None, None, None, None, "b")]
    items = spark.createDataFrame(rows, ITEMS)
    assert [tuple(r) for r in reports.key_findings(items).collect()] == [(1, "a", "last")]
    assert reports.key_images(items).count() == 3


def test_measurements_without_tracking(spark):
    items = spark.createDataFrame([(1, 1, None, "CONTAINER", "g", None, None, None, None), (1, 2, 1, "NUM", "length", None, 2.5, "mm", None), (1, 3, None, "NUM", "length", None, 9.0, "mm", None)], ITEMS)
    assert [tuple(r) for r in reports.measurements(items, "g", "i", "u").collect()] == [(1, 2, None, None, "length", 2.5, "mm")]


@pytest.mark.parametrize("kind, n, starts, number, sizes", [("POINT", 2, None, 2, [1, 1]), ("POINT", 3, None, 2, None), ("ELLIPSE", 8, None, 2, [4, 4]), ("POLYGON", 5, None, 1, [5]), ("POLYGON", 5, None, 2, None), ("POLYGON", 5, [1, 4], 2, [3, 2]), ("POLYGON", 5, [1, 1], 2, None), ("POLYGON", 5, [0, 2], 2, None), ("POLYGON", 5, [1, 7], 2, None), ("POLYGON", 0, None, 1, None)])
def test_primitives(spark, kind, n, starts, number, sizes):
    row = spark.createDataFrame([(kind, list(range(n)), starts, number)], "k string, p array<int>, s array<int>, n int")
    found = row.select(reports.primitives(F.col("k"), F.col("p"), F.col("s"), F.col("n"))).first()[0]
    assert (found and [len(p) for p in found]) == sizes


def test_definition_prefers_the_earlier_dictionary(spark):
    elements = spark.createDataFrame([("00091001", "A "), ("00091001", "B"), ("00090010", "A"), ("00100010", None)], "tag string, creator string")
    entries = spark.createDataFrame([(2, "00090001", "A", "DS", "own"), (3, "00091001", None, "UN", "whole"), (1, "00100010", None, "PN", "name")], "place int, tag string, creator string, vr string, keyword string")
    assert {(r.tag, r.creator): r.vr for r in reports.definition(elements, entries).collect()} == {("00091001", "A "): "DS", ("00091001", "B"): "UN", ("00090010", "A"): None, ("00100010", None): "PN"}


def test_template_limits(spark):
    items = spark.createDataFrame([(1, 1, None, "CONTAINER", "g", None, None, None, None), *((1, k, 1, "NUM", "a", None, 1.0, None, None) for k in (2, 3)), (1, 4, 1, "TEXT", "b", None, None, None, None)], ITEMS)
    rules = spark.createDataFrame([("g", "a", "NUM", 1, 1), ("g", "c", "TEXT", 1, None), ("g", "d", "TEXT", 0, None)], "container string, concept string, value_type string, least int, most int")
    assert {(r.concept, r.finding, r.n) for r in reports.template_findings(items, rules).collect()} == {("a", "too many", 2), ("b", "unexpected", 1), ("c", "missing", 0)}


def test_private_tags(spark):
    elements = spark.createDataFrame([("00090010", "A"), ("00091001", "A "), ("00091002", "A"), ("00091001", "B"), ("00100010", None), ("00110010", "C")], "tag string, creator string")
    allowed = spark.createDataFrame([("00091001", "A")], "tag string, creator string")
    assert sorted((r.tag, r.creator or "") for r in workflow.private_kept(elements, allowed, []).collect()) == [("00090010", "A"), ("00091001", "A "), ("00100010", "")]


def test_walk_of_nothing(spark):
    assert tagged_json.walked(spark.createDataFrame([(1, None), (2, "no json")], "id int, json string"), "id", "json").count() == 0


@pytest.mark.parametrize("date, time, dates, times, inside", [("20250102", "10", "20250102", "10", True), ("20250102", "1000", "20250102", "10", True), ("20250102", "1001", "20250102", "10", False), ("20250102", "2359", "-20250102", "", True), ("20250103", "0900", "20250102-20250103", "0930-0900", True), ("20250102", "0900", "20250102-", "0930-", False), (None, "10", "20250102", "10", None)])
def test_combined_times(spark, date, time, dates, times, inside):
    row = spark.createDataFrame([(date, time)], "d string, t string")
    assert row.select(temporal.combined_between(F.col("d"), F.col("t"), dates, times)).first()[0] is inside


def test_combined_times_refuse_malformed_keys(spark):
    with pytest.raises(ValueError):
        temporal.combined_between(F.lit("20250102"), F.lit("10"), "2025", "10")


def test_paths_stay_below_the_root(spark):
    row = spark.createDataFrame([(["A", ".."], ["A/B"], ["A\\B", " "])], "a array<string>, b array<string>, c array<string>")
    assert tuple(row.select(*(catalog.resolved_path("/m", F.col(c)) for c in "abc")).first()) == (None, None, "/m/A/B")
