"""Scans of folders of documents: bad files, bounds, links, pieces of large files of lines."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera.sources import scan

DOC = {"00080018": {"vr": "UI", "Value": ["1.2.3"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "A^B"}]}, "00280008": {"vr": "IS", "Value": ["x"]}, "00280030": {"vr": "DS", "Value": ["0.5", "0.25"]}, "00280010": {"vr": "US", "Value": [512]}}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "a" / "b").mkdir(parents=True)
    (root / "one.json").write_text(json.dumps(DOC))
    (root / "a" / "broken.json").write_text("{")
    (root / "a" / "list.json").write_text("[1]")
    (root / "a" / "no_vr.json").write_text('{"00100010": {"Value": []}}')
    (root / "a" / "empty.json").write_text("")
    (root / "a" / "b" / "bytes.json").write_bytes(b"\xff\xfe\x00")
    (root / "a" / "b" / "none.json").write_text("{}")
    (root / "a" / "notes.txt").write_text("{}")
    return root


def test_one_row_a_file_with_its_error(spark, folder):
    rows = scan.scan(spark, str(folder), profile="core,patient,geometry", suffixes=".json")
    found = {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert {k: r.error for k, r in found.items()} == {"one.json": None, "none.json": None, **dict.fromkeys(("broken.json", "list.json", "no_vr.json", "empty.json", "bytes.json"), "read")}
    one = found["one.json"]
    assert (one.instance_uid, one.patient_name, one.pixel_spacing, one.rows, one.number_of_frames) == ("1.2.3", "A^B", [0.5, 0.25], 512, None)
    assert one.invalid == ["number_of_frames"] and "study_uid" in one.missing and "instance_uid" not in one.missing
    assert len(found["none.json"].missing) == 18 and found["broken.json"].missing is None
    # columns of other profiles aren't there
    narrow = scan.scan(spark, f"file://{folder}", profile=("patient",), suffixes=(".json",))
    assert narrow.columns == ["path", "offset", "error", "limit", "patient_name", "patient_id", "patient_birth_date", "patient_sex", "missing", "invalid", "selected"]
    assert scan.scan(spark, str(folder / "one.json"), profile="none").columns == ["path", "offset", "error", "limit", "missing", "invalid", "selected"]


def test_an_error_budget_passed_is_a_failure(spark, folder):
    assert scan.scan(spark, str(folder), suffixes=".json", max_errors=5).count() == 7
    with pytest.raises((scan.ScanLimit, PythonException), match="max_errors"):
        scan.scan(spark, str(folder), suffixes=".json", max_errors=4)
    with pytest.raises(scan.ScanLimit, match="max_errors"):  # no part has more than one, all together have
        scan.scan(spark, str(folder), suffixes=".json", max_errors=2, part_bytes=1)


@pytest.mark.parametrize("bound", [{"max_files": 7}, {"max_directories": 2}, {"max_depth": 1}, {"max_path_bytes": 10}])
def test_bounds_are_errors(spark, folder, bound):
    with pytest.raises(Exception, match=next(iter(bound))):
        scan.scan(spark, str(folder), **bound)
    assert scan.scan(spark, str(folder), **{k: v + (1000 if k == "max_path_bytes" else 1) for k, v in bound.items()}).count() == 8


def test_large_documents_and_missing_folders(spark, folder):
    found = {r.path.rsplit("/", 1)[1]: (r.error, r.limit) for r in scan.scan(spark, str(folder), suffixes=".json", max_file_bytes=50).collect()}
    assert found["one.json"] == ("resource_limit", "max_file_bytes") and found["none.json"] == (None, None)
    assert [r.error for r in scan.scan(spark, str(folder / "nowhere")).collect()] == ["filesystem"]
    with pytest.raises(Exception, match="path"):
        spark.read.format("tagged_json").load().collect()
    with pytest.raises(ValueError):
        scan.Options(profile=("other",))
    with pytest.raises(ValueError):
        scan.Selector("bad id", "00100010")


def test_links(spark, folder, tmp_path):
    (tmp_path / "outside.json").write_text("{}")
    (folder / "in.json").symlink_to(folder / "one.json")
    (folder / "out.json").symlink_to(tmp_path / "outside.json")
    (folder / "dir").symlink_to(folder / "a")
    of = lambda links: {r.path.rsplit("/", 1)[1]: r.error for r in scan.scan(spark, str(folder), links=links).collect()}
    assert not {"in.json", "out.json", "dir"} & set(of("ignore"))
    assert {k: v for k, v in of("reject").items() if k in ("in.json", "out.json", "dir")} == dict.fromkeys(("in.json", "out.json", "dir"), "symlink")
    assert {k: v for k, v in of("follow").items() if k in ("in.json", "out.json", "dir")} == {"in.json": None, "out.json": "symlink", "dir": "symlink"}


STEPS = {"00400275": {"vr": "SQ", "Value": [{"00400007": {"vr": "LO", "Value": [v]}, "0040A730": {"vr": "SQ", "Value": [{"00400007": {"vr": "LO", "Value": ["deep"]}}]}} for v in "abc"]}, "00400007": {"vr": "LO", "Value": ["top"]}}


def test_selectors():
    of = lambda **kw: scan.record(json.dumps(STEPS), scan.Options(("none",), (scan.Selector("s", "00400007", ("00400275",), **kw),)))
    assert [e["values"] for e in of(occurrence="all")[-1]["s"]] == [["a"], ["b"], ["c"]]
    assert of(occurrence="first")[-1]["s"][0]["path"] == "00400275[0].00400007" and of()[-1]["s"][0]["path"] == "00400275[2].00400007"
    assert of(occurrence="all", most=2)[:2] == ("resource_limit", "selector")
    two = (scan.Selector("x", "00400007", occurrence="all"), scan.Selector("y", "00400007", ("00400275", "0040a730"), "all"))
    assert {k: len(v) for k, v in scan.record(json.dumps(STEPS), scan.Options(("none",), two))[-1].items()} == {"x": 1, "y": 3}
    assert scan.record(json.dumps(STEPS), scan.Options(("none",), two, max_selected=3))[1] == "max_selected"


@pytest.mark.parametrize("part", [1, 7, 64, 1000, 1 << 20])
def test_pieces_of_lines_lose_and_repeat_none(tmp_path, part):
    from pyarrow.fs import LocalFileSystem

    lines = [json.dumps({"00080018": {"vr": "UI", "Value": [f"1.2.{k}"]}}) + " " * (k % 5) for k in range(60)]
    lines[20:20] = ["", "{", " "]
    path = tmp_path / "lines"
    path.write_text("\n".join(lines) + ("" if part == 7 else "\n"))
    options = scan.Options(lines=True, part_bytes=part)
    reader = scan._Reader(str(path), options)
    rows = [r for low in range(0, path.stat().st_size, part) for r in reader._documents(LocalFileSystem(), str(path), low, min(low + part, path.stat().st_size))]
    assert [r[1][0] for r in rows] == [None] * 20 + ["read"] + [None] * 40
    text = path.read_bytes()
    assert all(text[at : at + 2] in (b'{"', b"{\n") for at, _ in rows) and len({at for at, _ in rows}) == 61


def test_documents_read_by_spark(spark, folder):
    options = scan.Options(("core", "geometry"), (scan.Selector("rows", "00280010"),))
    texts = spark.read.text(str(folder), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("p"), "value")
    found = scan.documents(texts, "p", "value", options)
    assert found.schema == options.schema()
    by = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert by["one.json"].pixel_spacing == [0.5, 0.25] and by["one.json"].selected["rows"][0]["values"] == ["512"] and by["broken.json"].error == "read"
    assert scan.documents(spark.createDataFrame([("x", None)], "p string, value string"), "p", "value", options).first().error == "read"
