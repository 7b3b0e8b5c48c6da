"""Commits to workflow steps: in a stream, over a table, and the end of finished steps."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming import commits

SCHEMA = "step string, request long, at timestamp, expected long, state string, action string, receiver string, lock boolean, events array<string>, watchers array<string>"
T0 = datetime(2024, 1, 1)


def row(step, request, expected=None, state=None, action=None, receiver=None, lock=None, events=None, watchers=None, at=None):
    return (step, request, T0 + timedelta(minutes=request if at is None else at), expected, state, action, receiver, lock, events, watchers)


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(*batches, keep=timedelta(hours=1)):
        """One batch a file; (step, request) -> (result, version, deliveries)."""
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.json(str(tmp_path / "made" / str(k)))
            (tmp_path / "in").mkdir(exist_ok=True)
            next((tmp_path / "made" / str(k)).glob("part-*.json")).rename(tmp_path / "in" / f"{k:03}.json")
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        found = commits.committed(rows, keep)
        out = str(tmp_path / "out")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return plain(spark.read.parquet(out))

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain(df):
    return {(r.step, r.request): (r.result, r.version, [tuple(d) for d in r.deliveries]) for r in df.collect()}


def test_commits_are_all_or_nothing(spark):
    rows = [
        row("a", 1, 3, "SCHEDULED"), row("a", 2), row("a", 3, 0, "SCHEDULED", watchers=["w", "v"], events=["new"]), row("a", 4, 0, "SCHEDULED"), row("a", 5, 9, "IN PROGRESS", events=["lost"]),
        row("a", 6, action="subscribe", receiver="x", lock=True), row("a", 7, 1, "IN PROGRESS", "unsubscribe", "v", events=["p", "q"]), row("a", 8, 2, "COMPLETED", "subscribe", None), row("a", 9, 2, "COMPLETED", "other", "x"),
        row("a", 10, events=["last"]), row("b", 1, action="subscribe", receiver="x"), row("b", 2, action="unsubscribe", receiver="x"), row("b", 3, events=["e"]), row(None, 1, 0, "SCHEDULED"),
        row("c", 1, 0, "SCHEDULED", "subscribe", "me", events=["new"]),
    ]
    found = plain(commits.replayed(spark.createDataFrame(rows, SCHEMA)))
    assert found == {
        ("a", 1): ("not found", None, []), ("a", 2): ("conflict", None, []), ("a", 3): ("committed", 1, [(1, "new", "v"), (1, "new", "w")]), ("a", 4): ("conflict", None, []), ("a", 5): ("stale", None, []),
        ("a", 6): ("committed", 1, [(2, "state", "x")]), ("a", 7): ("committed", 2, [(3, "p", "w"), (3, "p", "x"), (4, "q", "w"), (4, "q", "x")]), ("a", 8): ("conflict", None, []), ("a", 9): ("conflict", None, []),
        ("a", 10): ("committed", 2, [(5, "last", "w"), (5, "last", "x")]), ("b", 1): ("not found", None, []), ("b", 2): ("committed", None, []), ("b", 3): ("not found", None, []),
        ("c", 1): ("committed", 1, [(1, "new", "me"), (2, "state", "me")]),
    }
    few = plain(commits.replayed(spark.createDataFrame(rows, SCHEMA), most=1))
    assert few[("a", 3)] == ("limit", None, []) and few[("a", 4)][:2] == ("committed", 1)


def test_a_stream_agrees_with_the_table(spark, stream):
    r = random.Random(7)
    rows, versions = [], {}
    for request in range(120):
        step = r.choice("abcde")
        v = versions.get(step, 0)
        expected = r.choice([None, v, v, v + 1])
        versions[step] = v + (expected == v)
        rows.append(row(step, request, expected, r.choice(["SCHEDULED", "IN PROGRESS"]), r.choice([None, None, "subscribe", "unsubscribe"]), r.choice("xyz"), r.random() < 0.3, r.choice([None, ["e"], ["e", "f"]]), ["w"]))
    want = plain(commits.replayed(spark.createDataFrame(rows, SCHEMA)))
    assert stream(rows[:30], rows[30:31], rows[31:90], rows[90:]) == want and len({w[0] for w in want.values()}) > 3


def test_finished_steps_go_unless_locked(stream):
    hour = 60
    first = [row(s, k, 0, "IN PROGRESS") for k, s in enumerate("abc")]
    ends = [row("a", 10, 1, "COMPLETED"), row("b", 11, 1, "CANCELED", "subscribe", "x", True)]
    found = stream(
        first, ends, [row("c", 12, events=["e"], at=30)], [row("a", 13, events=["e"], at=31)], [row("c", 14, events=["e"], at=3 * hour)], [row("c", 15, events=["e"], at=3 * hour + 1)],
        [row("a", 16, events=["e"], at=3 * hour + 2), row("b", 17, action="unsubscribe", receiver="x", at=3 * hour + 2)], [row("c", 18, events=["e"], at=6 * hour)], [row("c", 19, events=["e"], at=6 * hour + 1)], [row("b", 20, events=["e"], at=6 * hour + 2), row("c", 21, 1, "IN PROGRESS", at=6 * hour + 2)],
    )
    assert found[("a", 13)][0] == "committed"  # within the hour
    assert found[("a", 16)][0] == "not found"  # gone
    assert found[("b", 17)][:2] == ("committed", 2)  # a lock held it
    assert found[("b", 20)][0] == "not found" and found[("c", 21)][:2] == ("committed", 2)  # open steps stay
