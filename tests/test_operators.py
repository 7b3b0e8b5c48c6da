import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import measures
from tessera.functions.scalars import is_uid, name_display, name_text, person_name, trimmed_text, values_of, windowed
from tessera.functions.temporal import date_display, key_window, precision, shifted_text, time_display, time_window, window
from tessera.operators import geometry, graph, masks, stats, workflow
from tessera.operators.match import WORKLIST, InvalidQuery, Key, Search, TooManyMatches, glob, matches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("pattern", "text", "ok"), [("A*", "A.b", True), ("A?", "A", False), ("*", "*A", True), ("a.c", "abc", False), ("*\\E*", "x\\Ey", True), ("A*", "A\nb", True), ("", "", True), ("a b*", "a bc", True)])
def test_glob(spark, pattern, text, ok):
    assert one(spark, F.lit(text).rlike(glob(pattern))) is ok


@pytest.mark.parametrize(("text", "lo", "hi"), [
    ("2024", "2024-01-01T00:00:00", "2024-12-31T23:59:59.999999"), ("202402", "2024-02-01T00:00:00", "2024-02-29T23:59:59.999999"), ("2024.02.03", "2024-02-03T00:00:00", "2024-02-03T23:59:59.999999"),
    ("20240203101112.5", "2024-02-03T10:11:12.500000", "2024-02-03T10:11:12.500000"), ("20240231", None, None), ("x", None, None), ("", None, None), (None, None, None),
])
def test_window(spark, text, lo, hi):
    w = one(spark, window(F.lit(text).cast("string")))
    assert (w and (w["lo"], w["hi"])) == (lo and (dt.datetime.fromisoformat(lo), dt.datetime.fromisoformat(hi)))


def test_time_window(spark):
    assert tuple(one(spark, time_window(F.lit("10:15")))) == (36_900_000_000, 36_959_999_999)
    assert one(spark, time_window(F.lit("25"))) is None
    assert one(spark, precision(F.lit("202402030405"))) == "minute"


def test_names_and_uids(spark):
    name = one(spark, person_name(F.lit("Doe^Jane^^Dr=X^Y")))
    assert (name["alphabetic"]["family"], name["alphabetic"]["prefix"], name["ideographic"]["given"], name["phonetic"]["family"]) == ("Doe", "Dr", "Y", "")
    assert one(spark, person_name(F.lit("a=b=c=d"))) is None
    for text, ok in (("1.2.840", True), ("1.40.1", False), ("2.999", True), ("1.02", False), ("1", False), ("3.1", False), ("1." + "1" * 70, False)):
        assert one(spark, is_uid(F.lit(text))) is ok


def test_linear_window(spark):
    assert [one(spark, windowed(F.lit(v), 50, 100)) for v in (-1.0, 200.0)] == [0, 255]
    with pytest.raises(ValueError, match="wide"):
        windowed(F.lit(1.0), 0, 0.5)


def test_matching_of_nulls_and_bad_queries(spark):
    df = spark.createDataFrame([("A", "20240101"), (None, "2024"), ("b", None), ("B", "x")], "name string, day string")
    names = lambda keys: [r[0] for r in matches(df, keys)[0].collect()]
    assert names([Key("name", "PN", ("",))]) == ["A", None, "b", "B"]
    assert names([Key("name", "PN", ("B",))]) == ["b", "B"]
    assert names([Key("day", "DA", ("20240630",))]) == [None]
    assert names([Key("day", "DA", ("20230101-",))]) == ["A", None]
    with pytest.raises(InvalidQuery):
        names([Key("day", "DA", ("2024*",))])
    with pytest.raises(InvalidQuery):
        names([Key("day", "DA", ("2023-2024-2025",))])
    assert matches(df, [], WORKLIST)[0].collect() == []
    assert matches(df, [Key("none", "LO", ("x",))])[1] == ["none"]
    with pytest.raises(TooManyMatches):
        Search([], ["name"], most=3).run(df)


@pytest.mark.parametrize(("vr", "value"), [("DA", "2024XX"), ("DA", "notadate"), ("DA", "20250101-20240101"), ("DA", "-"), ("DA", "20240230"), ("DT", "20240101."), ("TM", "25"), ("TM", "1015-0900"), ("TM", "10*"), ("DA", "2024010110")])
def test_bad_keys_are_errors(spark, vr, value):
    with pytest.raises(InvalidQuery):
        matches(spark.createDataFrame([("x",)], "t string"), [Key("t", vr, (value,))])


def test_times_offsets_and_several_values(spark):
    df = spark.createDataFrame([("101530", r"A\B ", "20240101010000+0100", ["1.2", "1.3"]), ("1016", "B", "20240101", None), (None, None, None, []), ("1015", "C", "2024", ["1.4"])], "t string, s string, d string, u array<string>")
    found = lambda *keys: [r[0] for r in matches(df, list(keys))[0].collect()]
    assert found(Key("t", "TM", ("101530",))) == ["101530", "1015"]
    assert found(Key("t", "TM", ("10:15",))) == ["101530", "1015"]
    assert found(Key("t", "TM", ("1016-",))) == ["1016"]
    assert found(Key("s", "CS", ("B",), several=True)) == ["101530", "1016"]
    assert found(Key("d", "DT", ("2024010100",))) == ["101530", "1016", "1015"]
    assert found(Key("d", "DT", ("2024010101+0100-2024010101+0100",))) == ["101530", "1016", "1015"]
    assert found(Key("u", "UI", ("1.3", "1.9"))) == ["101530"]
    assert found(Key("00080052", "CS", ("STUDY",)), Key("t", "TM", ("1016",))) == ["1016"]


@pytest.mark.parametrize(("vr", "text"), [("DA", "2024"), ("DA", "202402"), ("DT", "20240203101112.5"), ("DT", "2024020310-0330"), ("DA", "2024.02.03"), ("TM", "101112.25"), ("TM", "10"), ("TM", "24"), ("DA", "20240231")])
def test_windows_of_keys_are_those_of_columns(spark, vr, text):
    w = one(spark, time_window(F.lit(text)) if vr == "TM" else window(F.lit(text)))
    assert key_window(vr, text) == (w and (w["lo"], w["hi"]))


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found, _ = matches(orders, [Key("o_orderdate", "DA", ("1995-1996",)), Key("o_orderstatus", "CS", ("F", "P")), Key("o_orderkey", "UI", ("1", "7")), Key("o_orderpriority", "LO", ("1-*",))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate", "StringStartsWith(o_orderstatus", "In(o_orderkey", "StringStartsWith(o_orderpriority"):
        assert pushed in plan


def test_one_item_satisfies_all(spark):
    df = spark.createDataFrame([(1, [("x", "p"), ("y", "q")]), (2, [("x", "q")]), (3, None)], "id int, s array<struct<a:string,b:string>>")
    key = Key("s", "SQ", items=((Key("a", "CS", ("x",)), Key("b", "CS", ("q",))),))
    assert [r[0] for r in matches(df, [key])[0].collect()] == [2]


def test_statistics_of_odd_values(spark):
    df = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("n", float("nan")), ("n", 1.0), ("n", None), ("n", float("inf")), ("n", 3.0)], "seg string, v double")
    full = {r["seg"]: r for r in stats.full(df, ["seg"], "v").collect()}
    assert (full["c"]["skewness"], full["c"]["kurtosis"], full["n"]["n"], full["n"]["median"]) == (0, 0, 2, 2)
    assert {tuple(r) for r in stats.histogram(df, ["seg"], "v", 4).collect()} == {("c", 0, 2), ("n", 0, 1), ("n", 3, 1)}
    assert stats.histogram(df.limit(0), ["seg"], "v", 4).collect() == []


def test_masks(spark):
    df = spark.createDataFrame([("s", 1, x) for x in (0, 1, 2, 5)] * 2, "seg string, y int, x int")
    assert {tuple(r) for r in masks.runs(df).collect()} == {("s", 1, 0, 3), ("s", 1, 5, 6)}
    # 0 is at the image's border, 3, 4 and 6 have no neighbours above
    assert {r["x"] for r in masks.erode(masks.dilate(df, 9, 9)).collect()} == {1, 2, 5}
    assert masks.xor(df, df).collect() == []


def test_delivery_states(spark):
    state = workflow.after_completion(F.col("n"), F.col("ok"), 3)
    df = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "n int, ok boolean").select(state)
    assert [r[0] for r in df.collect()] == ["delivered", "failed", "exhausted", "exhausted"]
    with pytest.raises(InvalidQuery):
        workflow.deidentified(df, {"x": "Q"}, "s")


def test_actions_by_requirement(spark):
    assert [workflow.action("X/Z", k) for k in (1, 2, 3)] == ["empty", "empty", "remove"]
    assert [workflow.action("X/Z/U*", k) for k in (1, 2, 3)] == ["remap", "empty", "remove"]
    assert [workflow.action("Z/D", k) for k in (1, 2, 3)] == ["dummy", "empty", "empty"]
    with pytest.raises(InvalidQuery):
        workflow.action("X", 4)
    df = spark.createDataFrame([("a", 1, None)], "x string, n int, d date")
    assert tuple(workflow.deidentified(df, {"x": "C", "n": "D", "d": "D"}, "s", clean={"x": F.upper("x")}).first()) == ("A", 0, dt.date(1900, 1, 1))
    with pytest.raises(InvalidQuery):
        workflow.deidentified(df, {"x": "C"}, "s")


def test_texts(spark):
    assert [one(spark, name_display(F.lit(t))) for t in ("Doe^Jane^^Dr", "^^=山田^太郎", " a=b=c=d ", "")] == ["Doe Jane Dr", "山田 太郎", "a b c d", ""]
    assert one(spark, name_text(person_name(F.lit("Doe^Jane^^^=X")))) == "Doe^Jane=X"
    assert [one(spark, date_display(F.lit(t))) for t in ("20240203", "2024.02.03", "202402", "x ")] == ["2024-02-03", "2024-02-03", "2024-02", "x"]
    assert [one(spark, time_display(F.lit(t))) for t in ("101112.5", "10", "25")] == ["10:11:12.5", "10", "25"]
    assert [one(spark, shifted_text(F.lit(t), F.lit(-3))) for t in ("20240301", "2024", "20240301101112.50", "x")] == ["20240227", "2023", "20240227101112.50", None]
    assert one(spark, shifted_text(F.lit("2024"), F.lit(3))) is None  # its precision can't show the move
    assert one(spark, values_of(F.lit("a\\b"), "LO")) == ["a", "b"] and one(spark, values_of(F.lit("a\\b"), "LT")) == ["a\\b"]
    assert one(spark, trimmed_text(F.lit("1.2\0 "), "UI")) == "1.2"


def test_measures_without_a_value(spark):
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert one(spark, measures.length_mm(p(0, 0), p(3, 4), (0, 1))) is None
    assert one(spark, measures.deviation_mm(p(1, 1), p(1, 1), p(2, 2))) is None
    assert one(spark, measures.dynamic_angle(p(0, 0), p(1, 0), p(0, 0), p(-1, 1))["acute"]) == pytest.approx(45)
    assert one(spark, measures.sphere_slice_radius(F.lit(5.0), F.lit(3.0))) == 4 and one(spark, measures.sphere_slice_radius(F.lit(5.0), F.lit(6.0))) is None
    moved = one(spark, measures.repulsed(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in (p(0, 0), p(1, 0), p(9, 0)))), 0, 0, 2, 1))
    assert [(q["x"], q["y"]) for q in moved] == [(1, 0), (1.5, 0), (9, 0)]
    there = [2, 0, 0, 5, 0, 3, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]
    back = one(spark, measures.affine(F.lit(7.0), F.lit(9.0), F.lit(7.0), measures.inverse_affine(there)))
    assert [back[k] for k in "xyz"] == pytest.approx([1, 1, 0])
    with pytest.raises(ValueError, match="inverse"):
        measures.inverse_affine([0.0] * 16)


def test_components_of_odd_masks(spark):
    df = spark.createDataFrame([("s", y, x) for y, x in ((0, 0), (1, 1), (1, 2), (2, 2), (5, 5))], "seg string, y int, x int")
    size = lambda diagonal: sorted((r["label"], r["pixels"]) for r in masks.component_sizes(df, diagonal).collect())
    assert (size(False), size(True)) == ([(1, 1), (2, 3), (3, 1)], [(1, 4), (2, 1)])
    assert masks.component_sizes(df.limit(0)).collect() == []
    assert {tuple(r)[2:] for r in masks.flood(df, df.where("y = 2")).collect()} == {(1, 1, 3), (2, 2, 3)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(90, 80)], "a long, b long")
    assert {(r["node"], r["label"]) for r in graph.components(chain).collect()} == {*((k, 0) for k in range(51)), (80, 80), (90, 80)}


def test_volumes_and_nearest(spark):
    rows = [("one", 0, 1.0), ("even", 0, 0.0), ("even", 1, 2.0), ("even", 2, 4.0), ("gap", 0, 0.0), ("gap", 1, 1.0), ("gap", 2, 3.0), ("odd", 1, 0.0), ("odd", 0, 1.0), ("odd", 2, 2.4), ("twice", 0, 1.0), ("twice", 1, 1.0), ("back", 1, 0.0), ("back", 0, 1.0), ("none", 0, None)]
    found = {r["s"]: r for r in geometry.volume_geometry(spark.createDataFrame(rows, "s string, i int, z double"), ["s"], "z", "i").collect()}
    assert {k: r["kind"] for k, r in found.items()} == {"one": "single", "even": "regular", "gap": "missing", "odd": "irregular", "twice": "irregular", "back": "regular"}
    assert found["back"]["reversed"] and found["odd"]["reordered"] and not found["odd"]["reversed"] and not found["even"]["reordered"]
    left = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, None), ("h", 4, 1)], "g string, id int, t long")
    right = spark.createDataFrame([("g", 4, 10), ("g", 6, 11), ("g", 6, 7), ("g", 20, 1)], "g string, t long, v long")
    assert {(r["id"], r["found"], r["apart"]) for r in geometry.nearest(left, right, ["g"], "t", "v").collect() if r["t"] is not None} == {(1, 7, 1), (2, 7, 3), (4, None, None)}


def test_store_changes(spark):
    rows = spark.createDataFrame([("a", "completed", 1), ("b", "pending", 1), ("c", "failed", 9), ("d", None, None)], "id string, state string, finished int")
    assert [r["id"] for r in workflow.purged(rows, F.lit(5)).collect()] == ["b", "c", "d"]
    elements = spark.createDataFrame([(1, "00100040", "CS", "m"), (1, "00080020", "DA", "2024"), (1, "00100010", "LO", "x" * 65), (1, "00200013", "IS", " 7 "), (1, "00080018", "UI", "")], "id int, tag string, vr string, value string")
    assert {(r["tag"], r["code"]) for r in workflow.vr_findings(elements, "id").collect()} == {("00100040", "format"), ("00080020", "format"), ("00100010", "length")}


def test_nearest_over_many_ranges(spark):
    import random

    r = random.Random(3)
    left = [(r.choice("gh") if r.random() < 0.95 else None, k, None if r.random() < 0.05 else r.randrange(300)) for k in range(500)]
    right = [(r.choice("ghi") if r.random() < 0.95 else None, None if r.random() < 0.05 else r.randrange(300), r.randrange(1000)) for _ in range(60)] + [("g", 10**9, 1)]

    def want(g, at, tolerance):
        best = min(((abs(t - at), v) for h, t, v in right if h == g and t is not None), default=(None, None)) if at is not None else (None, None)
        return best if best[0] is None or tolerance is None or best[0] <= tolerance else (None, None)

    df, other = spark.createDataFrame(left, "g string, id int, t long"), spark.createDataFrame(right, "g string, t long, v long")
    for tolerance in (None, 5):
        found = {x["id"]: (x["apart"], x["found"]) for x in geometry.nearest(df, other, ["g"], "t", "v", tolerance).collect()}
        assert found == {k: want(g, at, tolerance) for g, k, at in left}
    assert geometry.nearest(df, other.limit(0), ["g"], "t", "v").where("found IS NOT NULL OR apart IS NOT NULL").count() == 0
    assert geometry.nearest(df.limit(0), other, ["g"], "t", "v").count() == 0


def test_names_fold_beyond_ascii(spark):
    rows = spark.createDataFrame([("Éric^X",), ("éric^Y",), ("Eric^Z",), (None,)], "n string")
    of = lambda *v: {r["n"] for r in matches(rows, [Key("n", "PN", v)])[0].collect()}
    assert of("éric*") == of("ÉR?C^*") == {"Éric^X", "éric^Y"} and of("éric^x") == {"Éric^X"}


def test_dates_at_the_end_of_time(spark):
    rows = spark.createDataFrame([("2024-05-06",), ("9999-12-31",), (None,)], "d string").select(F.col("d").cast("date").alias("d"), F.translate("d", "-", "").alias("t"), F.col("d").cast("timestamp").alias("s"))
    of = lambda column, vr, v: {r["t"] for r in matches(rows, [Key(column, vr, (v,))])[0].collect()}
    for column in "dts":
        assert of(column, "DA", "20240506-99991231") == {"20240506", "99991231"} == of(column, "DA", "-99991231")
        assert of(column, "DA", "99991231") == of(column, "DA", "999912") == of(column, "DA", "9999") == {"99991231"}
        assert of(column, "DT", "20240507-99991231235959.999999") == {"99991231"}
    assert key_window("DT", "9999")[1] == dt.datetime.max == key_window("DT", "99991231235959-0500")[1]
    assert key_window("DT", "00010101+0500")[0] == dt.datetime.min


def test_volumes_keep_what_is_no_number(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", 1.0, 0.5, 2.0), ("a", nan, 0.25, 4.0), ("a", 3.0, 0.5, 2.0), ("a", None, 9.0, 9.0), ("b", nan, 1.0, 1.0), ("c", inf, 1.0, 1.0), ("c", 1.0, 1.0, 3.0)], "seg string, v double, area double, thick double")
    found = {r["seg"]: r for r in stats.volume(rows, ["seg"], "v", F.col("area"), F.col("thick")).collect()}
    a, b, c = found["a"], found["b"], found["c"]
    assert (a["n"], a["low"], a["high"], a["area_mm2"], a["volume_mm3"]) == (3, 1.0, 3.0, 1.25, 3.0) and a["mean"] != a["mean"]
    assert (b["n"], b["low"], b["high"]) == (1, inf, -inf) and (c["n"], c["high"], c["mean"], c["volume_mm3"]) == (2, inf, inf, 4.0)
