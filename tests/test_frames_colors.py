"""Tiles, mask frames, colours, tags, directories and references: the cases that the queries don't meet."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import colors, measures, tags
from tessera.operators import catalog, frames, stats, workflow
from tessera.operators.match import InvalidQuery


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_colors(spark):
    lab = lambda *rgb: one(spark, colors.lab_words(*(F.lit(v).cast("int") for v in rgb)))
    assert lab(0, 0, 0)["l"] == 0 and lab(255, 255, 255)["l"] == 65535
    assert tuple(lab(300, -4, 255)) == tuple(lab(255, 0, 255))
    assert lab(None, 1, 1) is None


@pytest.mark.parametrize(("text", "number"), [("00100020", 0x100020), ("(0010,0020)", 0x100020), ("10,20", 0x100020), (" 7fe00010 ", 0x7FE00010), ("(0010,0020", None), ("0010,0020)", None), ("0010", None), ("00100G20", None), ("10000,1", None), ("", None), (None, None)])
def test_tags(spark, text, number):
    assert one(spark, tags.tag_number(F.lit(text).cast("string"))) == number


def test_tags_sort_and_are_private(spark):
    assert one(spark, tags.tag_text(F.lit(0x0009_0001))) == "00090001"
    assert one(spark, tags.is_private(F.lit(0x0009_0001))) and not one(spark, tags.is_private(F.lit(0x7FE0_0010)))


def test_levels(spark):
    rows = spark.createDataFrame([("a", 800), ("a", 400), ("a", 200), ("a", 0), ("b", 100)], "id string, width int")
    at = lambda scale: {r.id: r.width for r in frames.level_for_scale(rows, ["id"], "width", F.lit(scale).cast("double")).collect()}
    assert at(1.9) == {"a": 400, "b": 100} and at(float("nan")) == at(None) == at(-1) == {"a": 800, "b": 100}
    assert at(2**0.5)["a"] == 800  # between two levels the less reduced one


def test_tiles(spark):
    views = spark.createDataFrame([(1, 500, 500, 99, 0, 500, 0, 100), (2, 500, 500, 99, 600, 700, 0, 9), (3, 500, 500, 4, -9, 500, -9, 500)], "id int, width int, height int, n_frames int, x0 int, x1 int, y0 int, y1 int")
    found = sorted((r.id, r.plane, r.path, r.tile_row, r.tile_column, r.frame) for r in frames.tiles_in_view(views, (256, 256), 2, 1).collect())
    assert found == [(1, 0, 0, 0, 0, 1), (1, 0, 0, 0, 1, 2), (1, 1, 0, 0, 0, 5), (1, 1, 0, 0, 1, 6), (3, 0, 0, 0, 0, 1), (3, 0, 0, 0, 1, 2), (3, 0, 0, 1, 0, 3), (3, 0, 0, 1, 1, 4)]


def test_mask_frames(spark):
    rows = spark.createDataFrame([("s", k) for k in (1, 2, 2, 3)], "s string, frame int")
    items = spark.createDataFrame([("s", 1, None, [9]), ("s", 2, [(2, 3)], [5]), ("s", 3, [(2, 3)], [5, 6]), ("s", 4, [(1, 3)], [5, 6]), ("s", 5, [(1, 1)], [])], "s string, item int, ranges array<struct<first int, last int>>, masks array<int>")
    found = sorted((r.item, r.frame, r["mask"]) for r in frames.mask_frames(rows, items, ["s"], "frame").collect() if r["mask"])
    assert found == [(1, 1, 9), (1, 2, 9), (1, 3, 9), (2, 2, 5), (2, 3, 5), (3, 2, 5), (3, 3, 6), (4, 1, 5), (4, 2, 6)]
    assert frames.mask_frames(rows, items, ["s"], "frame").count() == 11


def test_directory(spark):
    rows = spark.createDataFrame([("p", "s", "i", "A"), ("p", "s", "j", "B"), (None, "t", "i", None)], "p string, s string, i string, a string")
    found = {(r.level, "/".join(r.path)): (r.n_records, r.n_children, r.consistent) for r in catalog.directory(rows, [("patient", "p", ["a"]), ("study", "s", []), ("image", "i", [])]).collect()}
    assert found == {("patient", "p"): (2, 1, False), ("study", "p/s"): (2, 2, True), ("image", "p/s/i"): (1, 0, True), ("image", "p/s/j"): (1, 0, True), ("patient", ""): (1, 1, True), ("study", "/t"): (1, 1, True), ("image", "/t/i"): (1, 0, True)}
    assert [tuple(r) for r in catalog.several_roles(rows.withColumn("i", F.lit("s")), ["p", "s", "i"]).collect()] == [("s", ["i", "s"])]


def test_reference_kinds(spark):
    nodes = spark.createDataFrame([("1",), ("1.1",), ("1.1.2",), ("1.10",)], "node string")
    asked = [("1.1.2", "1.1.2"), ("1.1.2", "1.1"), ("1.10", "1.1"), ("1.1", "1.7"), ("1.1", "1..2"), ("1.1", None), ("1.1", "0")]
    found = catalog.reference_kinds(spark.createDataFrame(asked, "source string, target string"), nodes, "source", "target", "node")
    assert sorted((r.source, r.target or "", r.kind) for r in found.collect()) == [("1.1", "", "invalid"), ("1.1", "0", "invalid"), ("1.1", "1..2", "invalid"), ("1.1", "1.7", "missing"), ("1.1.2", "1.1", "ancestor"), ("1.1.2", "1.1.2", "self"), ("1.10", "1.1", "ok")]


def test_scales_and_summaries(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", nan, 9.0), ("b", 3.0, 3.0), ("c", None, nan)], "c string, least double, most double")
    assert {r.c: (r.low, r.high, r.center, r.half_span, r.valid) for r in stats.amplitude_scale(rows, ["c"]).collect()} == {"a": (1, 9, 5, 4, True), "b": (3, 3, 3, 3, True), "c": (-1, 1, 0, 1, False)}
    doses = spark.createDataFrame([("r", 1.0, 3.0), ("r", 5.0, 1.0), ("r", nan, 7.0)], "r string, d double, v double")
    assert tuple(stats.dose_summary(doses, ["r"], "d", "v").first()) == ("r", 2, 4.0, 1.0, 5.0, 2.0)


def test_lists_need_a_limit(spark):
    with pytest.raises(InvalidQuery):
        workflow.listed(spark.range(3), "id", 0)
    assert [r.id for r in workflow.listed(spark.range(9), "id", 2, after=3, id=[1, 4, 5, 8]).collect()] == [4, 5]


def test_slide_coordinates(spark):
    at = lambda spacing: measures.slide_point(F.lit(2), F.lit(4), ((10, 20, 30), (0,) * 6, spacing), 1)
    assert tuple(one(spark, at((0.5, 0.25)))) == (11, 21, 31) and one(spark, at((0, 1))) is None
    assert tuple(one(spark, measures.slide_pixel(at((0.5, 0.25)), ((10, 20, 30), (0,) * 6, (0.5, 0.25))))) == (2, 4)
    assert one(spark, measures.slide_pixel(at((0.5, 0.25)), ((10, 20, 30), (0,) * 6, (0, 1)))) is None


def test_calibrated(spark):
    points = spark.createDataFrame([("f", 1, 5, 5), ("f", 2, 9, 9), ("g", 3, 5, 5)], "f string, id int, x int, y int")
    regions = spark.createDataFrame([("f", 2, 0, 0, 5, 5, 0, 0, 7.0, 7.0, 1.0, 1.0), ("f", 1, 5, 5, 8, 8, 1, 0, 1.0, 2.0, 0.5, 0.5)], "f string, region int, x0 int, y0 int, x1 int, y1 int, rx int, ry int, vx double, vy double, dx double, dy double")
    found = {r.id: (r.region, r.px, r.py) for r in frames.calibrated(points, regions, ["f"], "id").collect()}
    assert found == {1: (1, 0.5, 2.0), 2: (None, None, None), 3: (None, None, None)}


def test_kept_subscriptions(spark):
    rows = [("a", None, True, 1), ("a", 1, False, 5), ("a", 2, False, 6), ("a", 9, False, 7), ("b", 1, False, 8), ("b", 2, True, 1), ("c", None, False, 9)]
    subs = spark.createDataFrame(rows, "recipient string, step long, active boolean, updated int")
    steps = spark.createDataFrame([(1,), (2,)], "step long")
    kept = lambda most: sorted((r.recipient, r.step or 0, r.active) for r in workflow.kept_subscriptions(subs, steps, most).collect())
    assert kept(9) == [("a", 0, True), ("a", 1, False), ("a", 2, False), ("b", 2, True)]
    assert kept(1) == [("a", 0, True), ("a", 2, False), ("b", 2, True)]


def test_priors(spark):
    ask = lambda a, r: one(spark, catalog.prior_wanted(F.array(*map(F.lit, a)).cast("array<int>"), F.array(*map(F.lit, r)).cast("array<int>")))
    assert [ask([0, -3, 2], [9]), ask([0], [0, 5]), ask([], [0]), ask([], [])] == [1, 0, None, None]
    rows = spark.createDataFrame([("p", 1, 3), ("p", 2, 1), ("q", 3, 2)], "p string, k int, at int")
    assert {r.k: r.prior for r in catalog.priors(rows, ["p"], ["at"], "k").collect()} == {1: 2, 2: None, 3: None}


def test_report(spark):
    rows = spark.createDataFrame([(1, "x", "error"), (1, "x", "error"), (1, "a", "warning")], "k int, code string, severity string")
    assert [tuple(r) for r in workflow.report(rows, "k").collect()] == [(1, 2, 1, ["a", "x"])]
