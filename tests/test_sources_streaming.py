"""Tagged JSON both ways, and streams over small folders of files."""

import json

from pyspark.sql import functions as F

from tessera.sources import tagged_json
from tessera.streaming import steps

DOC = {
    "00080000": {"vr": "UL", "Value": [8]},
    "00100010": {"vr": "PN", "Value": [{"Ideographic": "山田"}]},
    "00200013": {"vr": "IS", "Value": ["7"]},
    "00280010": {"vr": "US", "Value": [512]},
    "00081115": {"vr": "SQ", "Value": [{"0020000E": {"vr": "UI", "Value": ["1.2"]}}, {"0020000E": {"vr": "UI", "Value": ["1.3"]}}]},
    "00104000": {"vr": "LT"},
    "00200011": {"vr": "CS", "Value": ["", 'a"b']},
}


def test_tagged_json(spark):
    docs = spark.createDataFrame([(1, json.dumps(DOC)), (2, None), (3, "{"), (4, "{}")], "id long, text string")
    rows = tagged_json.elements(docs, "id", "text")
    first = {r.tag: r.t for r in rows.select("tag", tagged_json.text(F.col("values"), F.col("vr")).alias("t")).collect()}
    assert {r.id for r in rows.collect()} == {1}
    assert first["00100010"] == "山田" and first["00280010"] == "512" and first["00104000"] is None and first["00200011"] == 'a"b'
    assert [(r.item, r["values"]) for r in tagged_json.items(rows, "id", "00081115").orderBy("item").collect()] == [(0, ["1.2"]), (1, ["1.3"])]
    (back,) = tagged_json.documents(rows, "id").collect()
    assert json.loads(back.json) == {k: v for k, v in DOC.items() if k != "00080000"}
    assert list(json.loads(back.json)) == sorted(json.loads(back.json))


def test_numbers_that_json_cannot_hold(spark):
    rows = spark.createDataFrame([(1, "00189087", "FD", ["NaN", "1.5", None], None)], "id long, tag string, vr string, values array<string>, uri string")
    assert json.loads(tagged_json.documents(rows, "id").first().json) == {"00189087": {"vr": "FD", "Value": ["NaN", 1.5, None]}}
    assert tagged_json.documents(rows.limit(0), "id").count() == 0


def _run(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_change_states(spark, tmp_path):
    schema = "step string, request long, wanted string, transaction string"
    rows = [
        ("a", 1, "COMPLETED", "t"), ("a", 2, "IN PROGRESS", "t"), ("a", 3, "COMPLETED", "u"), ("a", 4, "COMPLETED", "t"), ("a", 5, "CANCELED", "t"),
        ("b", 1, "IN PROGRESS", None), ("b", 2, "LOST", "t"), (None, 9, "IN PROGRESS", "t"),
    ]
    # the requests come in two files, so in two batches
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = {(r.step, r.request): (r.state, r.result) for r in _run(spark, steps.change_states(stream), tmp_path, "states").collect()}
    assert found == {
        ("a", 1): ("SCHEDULED", "not in progress"), ("a", 2): ("IN PROGRESS", "changed"), ("a", 3): ("IN PROGRESS", "wrong transaction"), ("a", 4): ("COMPLETED", "changed"),
        ("a", 5): ("COMPLETED", "final"), ("b", 1): ("SCHEDULED", "no transaction"), ("b", 2): ("SCHEDULED", "invalid state"),
    }


def test_finished_states_expire(spark, tmp_path):
    import time

    schema = "step string, request long, wanted string, transaction string"
    batches = [[("a", 1, "IN PROGRESS", "t"), ("b", 1, "IN PROGRESS", "t")], [("a", 2, "COMPLETED", "t")], [("b", 2, "IN PROGRESS", "t")], [("a", 3, "IN PROGRESS", "u"), ("b", 3, "COMPLETED", "t")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    at = str(tmp_path / "at")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        steps.change_states(stream, 1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        time.sleep(1.5 if k == 1 else 0)
    found = {(r.step, r.request): r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("a", 1): "changed", ("b", 1): "changed", ("a", 2): "changed", ("b", 2): "already in progress", ("a", 3): "changed", ("b", 3): "changed"}


def test_awaited(spark, tmp_path):
    asked = [("x", "2024-01-01 00:00:00"), ("y", "2024-01-01 00:00:10"), ("z", "2024-01-01 09:00:00")]
    told = [("x", "2024-01-01 00:00:30"), ("y", "2024-01-01 00:05:00"), ("z", "2024-01-01 09:00:01")]
    for name, column, rows in (("asked", "asked", asked), ("told", "answered", told)):
        for row in rows:
            spark.createDataFrame([row], f"transaction string, {column} string").coalesce(1).write.mode("append").json(str(tmp_path / name))
    stream = lambda name, column: spark.readStream.schema(f"transaction string, {column} timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    found = {r.transaction: r.outcome for r in _run(spark, steps.awaited(stream("asked", "asked"), stream("told", "answered"), "60 seconds"), tmp_path, "waits").collect()}
    assert found == {"x": "answered", "y": "timed out", "z": "answered"}


def test_binary_values_come_back(spark):
    doc = {"00420011": {"vr": "OB", "InlineBinary": "AQID/w=="}, "7FE00010": {"vr": "OW", "BulkDataURI": "bulk/1"}}
    rows = tagged_json.elements(spark.createDataFrame([(1, json.dumps(doc))], "id long, text string"), "id", "text")
    assert json.loads(tagged_json.documents(rows, "id").first().json) == doc


def test_a_transaction_that_does_not_hold_the_step_learns_nothing():
    assert steps._change("COMPLETED", "t", "COMPLETED", "u")[2] == "wrong transaction"
    assert steps._change("IN PROGRESS", "t", "IN PROGRESS", "u")[2] == "wrong transaction"
    assert [steps._change("COMPLETED", "t", w, "t")[2] for w in ("COMPLETED", "CANCELED", "IN PROGRESS")] == ["already so", "final", "final"]
    assert steps._change("IN PROGRESS", "t", "IN PROGRESS", "t")[2] == "already in progress"
