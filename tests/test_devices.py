"""Calibrated regions, de-identification plans and scheduled steps, on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import deid_plan, ultrasound
from tessera.operators.match import InvalidQuery, Key, with_scheduled_step

REGIONS = "frame int, region int, x0 int, y0 int, x1 int, y1 int, rx int, ry int, vx double, vy double, dx double, dy double, ux string, uy string, format int, flags int"


def regions(spark, *rows):
    return spark.createDataFrame(list(rows), REGIONS)


def points(spark, shapes, frame=1):
    return spark.createDataFrame([(frame, s, k, *p) for s, ps in shapes.items() for k, p in enumerate(ps)], "frame int, shape string, place int, x int, y int")


CM = (1, 1, 0, 0, 100, 100, 10, 20, 1.0, 2.0, 0.1, 0.2, "cm", "cm", 1, 0)


def test_areas_and_findings(spark):
    r = regions(spark, CM, (1, 2, 200, 0, 300, 100, 0, 0, 0.0, 0.0, 0.5, 0.5, "cm", "cm", 1, 0), (1, 3, 50, 0, 100, 100, 0, 0, 0.0, 0.0, 0.3, 0.2, "cm", "cm", 1, 0), (1, 4, 0, 200, 100, 300, 0, 0, 0.0, 0.0, 1.0, 1.0, "s", "cm/s", 3, 0), (1, 5, 200, 200, 300, 300, 0, 0, 0.0, 0.0, 0.0, 1.0, "cm", "cm", 1, 0))
    shapes = {
        "square": [(0, 0), (10, 0), (10, 10), (0, 10)], "two": [(0, 0), (1, 1)], "ambiguous": [(60, 1), (70, 1), (70, 9)], "across": [(1, 1), (250, 1), (250, 9)], "units": [(1, 210), (9, 210), (9, 220)], "outside": [(900, 900), (910, 900), (910, 910)], "steps": [(210, 210), (220, 210), (220, 220)],
    }
    found = {x.shape: (x.region, x.value and round(x.value, 9), x.finding) for x in ultrasound.polygon_areas(points(spark, shapes), r, ["frame"]).collect()}
    assert found == {"square": (1, 2.0, None), "two": (None, None, "points"), "ambiguous": (None, None, "ambiguous"), "across": (None, None, "cross_region"), "units": (None, None, "units"), "outside": (None, None, "uncalibrated"), "steps": (None, None, "calibration")}


def test_named_measurements(spark):
    shapes = {"head": [(0, 0), (30, 0), (30, 20)], "femur": [(0, 0), (30, 20), (90, 90)], "one": [(0, 0)], "flat": [(0, 0), (9, 9)], "what": [(0, 0), (1, 1)]}
    kinds = spark.createDataFrame([(1, "head", "head-circumference"), (1, "femur", "femur-length"), (1, "one", "femur-length"), (1, "flat", "abdominal-circumference"), (1, "what", "nose")], "frame int, shape string, kind string")
    found = {x.shape: (x.code, x.value and round(x.value, 9), x.finding) for x in ultrasound.biometry(points(spark, shapes), regions(spark, CM), kinds, ["frame"]).collect()}
    assert found == {"head": ("11984-2", 12.0, None) if math.hypot(3, 4) == 5 else None, "femur": ("11963-6", 5.0, None), "one": ("11963-6", None, "points"), "flat": ("11979-2", None, "points"), "what": (None, None, "kind")}


def test_times_and_velocities(spark):
    wave = (1, 1, 0, 0, 100, 100, 10, 50, 0.5, 0.0, 0.01, -2.0, "s", "cm/s", 3, 0)
    shapes = {"a": [(20, 40)], "f": [(220, 40)], "t": [(320, 40)], "two": [(1, 1), (2, 2)], "cm": [(420, 40)], "none": [(999, 0)]}
    r = regions(spark, wave, (1, 2, 200, 0, 300, 100, 0, 0, 0.0, 0.0, 1.0, 1.0, "s", "cm/s", 3, 4), (1, 3, 310, 0, 400, 100, 0, 0, 0.0, 0.0, 1.0, 1.0, "s", "cm/s", 1, 0), (1, 4, 410, 0, 500, 100, 0, 0, 0.0, 0.0, 1.0, 1.0, "cm", "cm", 1, 0))
    found = {x.shape: (x.seconds, x.velocity, x.finding) for x in ultrasound.doppler(points(spark, shapes), r, ["frame"]).collect()}
    assert found.pop("a") == (pytest.approx(0.6), 20.0, None)
    assert found == {"f": (None, None, "units"), "t": (None, None, "units"), "two": (None, None, "points"), "cm": (None, None, "units"), "none": (None, None, "uncalibrated")}


ELEMENTS = "doc int, tag string, vr string, requirement int, values array<string>"


def test_a_plan_holds_for_what_it_was_made_of(spark):
    rows = [(1, "00100010", "PN", 2, ["A^B"]), (1, "00080018", "UI", 1, ["1.2.3"]), (1, "00100030", "DA", 1, ["20200101"]), (1, "00110001", "LO", 3, ["p"]), (1, "00080060", "CS", 1, ["CT"]), (2, "00080018", "UI", 1, ["1.2.3"]), (2, "00104000", "LT", 3, ["note"]), (3, "00080060", "CS", 1, None), (3, "00080060", "CS", 1, ["MR"])]
    profile = spark.createDataFrame([("00100010", "Z"), ("00080018", "U"), ("00100030", "X/Z/D"), ("00104000", "C")], "tag string, code string")
    df = spark.createDataFrame(rows, ELEMENTS)
    plans = deid_plan.planned(df, profile, "s")
    assert {p.doc: [tuple(f) for f in p.findings] for p in plans.collect()} == {1: [], 2: [("00104000", "clean")], 3: [("00080060", "repeated")]}
    assert {o.doc: tuple(o)[1:] for o in deid_plan.outcomes(df, plans).collect()} == {1: ("applied", 3, 1), 2: ("findings", 0, 0), 3: ("findings", 0, 0)}
    after = deid_plan.applied(df, plans)
    one = {r.tag: r["values"] for r in after.where("doc = 1").collect()}
    assert one.pop("00080018")[0].startswith("2.25.") and one == {"00100010": [], "00100030": ["19000101"], "00080060": ["CT"]}
    assert after.where("doc > 1").count() == 4 and after.columns == df.columns
    # once only, and not for a document that has changed
    assert {o.doc: o.outcome for o in deid_plan.outcomes(after, plans).collect()}[1] == "stale"
    moved = df.withColumn("values", F.when(F.col("tag") == "00080060", F.array(F.lit("XA"))).otherwise(F.col("values")))
    assert {o.doc: o.outcome for o in deid_plan.outcomes(moved, plans).collect()} == {1: "stale", 2: "findings", 3: "stale"}
    assert sorted(map(str, deid_plan.applied(moved, plans).collect())) == sorted(map(str, moved.collect()))
    cleaned = deid_plan.planned(df, profile, "s", F.array(F.lit("clean")))
    assert [r["values"] for r in deid_plan.applied(df, cleaned).where("tag = '00104000'").collect()] == [["clean"]]
    assert {o.outcome for o in deid_plan.outcomes(df, plans.limit(0)).collect()} == {"no plan"} and deid_plan.applied(df.limit(0), plans).count() == 0


def test_scheduled_steps(spark):
    steps = spark.createDataFrame([(1, "20240101", "0830", "CT"), (1, "20240102", "1200", "MR"), (2, "20240103", "0700", "CT"), (3, "20240102", None, "CT"), (4, None, "1200", "CT")], "id int, d string, t string, modality string")
    parents = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    of = lambda keys, dates, times: {r.id for r in with_scheduled_step(parents, steps, ["id"], keys, "d", "t", dates, times).collect()}
    assert of([], "", "") == {1, 2, 3, 4}
    assert of([], "20240101-20240103", "0900-0600") == {1}  # one range from the first morning to the last
    assert of([], "20240101-20240103", "0900-0730") == {1, 2}
    assert of([Key("modality", "CS", ("CT",))], "20240101-20240102", "0900-1300") == set()
    assert of([Key("modality", "CS", ("CT",))], "20240101-20240102", "") == {1, 3} and of([], "", "1200") == {1, 4}
    with pytest.raises(InvalidQuery):
        of([], "20240101-2024010x", "0900-1000")
