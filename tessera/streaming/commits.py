"""Commits to workflow steps, all or nothing: a step's change, a subscription and events, with a delivery for each event and receiver.

A commit is a row: step, request (their order), at (a timestamp), expected (null: no change of the step; 0: it is created;
else the version that it must have), state (the new one), action (null, subscribe or unsubscribe), receiver, lock
(whether the subscription keeps the step from going), events (the types to report, an array), watchers (who is
subscribed to all steps; a new step inherits them). Each gives one row with its result:

    committed   all of it holds; version is the step's, deliveries has (event, type, receiver) in order
    conflict    nothing is asked, a step is created that is there, or a subscription has no receiver
    not found   the step isn't there
    stale       the step has another version
    limit       an event would go to more than `most` receivers

Events are numbered from 1 in each step. Whoever subscribes is told the state by an event of their own; any other event goes
to all who are subscribed once the commit's own action is done. Of a commit that doesn't hold nothing is kept.

`committed` does this in a stream, with state in Spark's store for each step: its version and count of events, and a map of
its receivers. A step that is COMPLETED or CANCELED goes `keep` after its end by a timer on the watermark, unless a
lock holds it, and then it is looked at again each `keep`. `replayed` does the same over a table, without an end.

Commits of a step are taken in order of `request`; in a stream, within each batch. A null step is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States that end a step, and the type of the event that tells a subscriber the state (fixed values).
FINAL = ("COMPLETED", "CANCELED")
STATE_REPORT = "state"
COLUMNS = ["step", "request", "at", "expected", "state", "action", "receiver", "lock", "events", "watchers"]
_DELIVERY = T.StructType([T.StructField("event", T.LongType()), T.StructField("type", T.StringType()), T.StructField("receiver", T.StringType())])


@dataclass(frozen=True)
class Step:
    version: int
    state: str | None
    events: int
    finished: datetime | None
    receivers: dict[str, bool] = field(default_factory=dict)


def commit(held: Step | None, row: Row, most: int) -> tuple[Step | None, str, int | None, list[tuple]]:
    """(the step after it, result, version, deliveries) of one commit to a step."""
    events, action = list(row["events"] or []), row["action"]
    if row["expected"] is None and action is None and not events:
        return held, "conflict", None, []
    step = held
    if row["expected"] == 0:
        if held is not None:
            return held, "conflict", None, []
        step = Step(1, row["state"], 0, None, {w: False for w in row["watchers"] or [] if w})
    elif row["expected"] is not None:
        if held is None:
            return held, "not found", None, []
        if held.version != row["expected"]:
            return held, "stale", None, []
        step = Step(held.version + 1, row["state"], held.events, held.finished, held.receivers)
    if action is not None and (action not in ("subscribe", "unsubscribe") or not row["receiver"]):
        return held, "conflict", None, []
    if step is None:  # whoever isn't subscribed can leave
        return held, ("committed" if action == "unsubscribe" and not events else "not found"), None, []
    receivers = dict(step.receivers)
    deliveries = []
    number = step.events
    if action == "subscribe":
        receivers[row["receiver"]] = bool(row["lock"])
    elif action == "unsubscribe":
        receivers.pop(row["receiver"], None)
    for kind in events:
        number += 1
        deliveries += [(number, kind, r) for r in sorted(receivers)]
    if events and len(receivers) > most:
        return held, "limit", None, []
    if action == "subscribe":
        number += 1
        deliveries.append((number, STATE_REPORT, row["receiver"]))
    ended = step.state in FINAL
    finished = (step.finished or row["at"]) if ended else None
    return Step(step.version, step.state, number, finished, receivers), "committed", step.version, deliveries


def schema(step: T.DataType) -> T.StructType:
    return T.StructType().add("step", step).add("request", T.LongType()).add("result", T.StringType()).add("version", T.LongType()).add("deliveries", T.ArrayType(_DELIVERY))


def _rows(commits: DataFrame) -> DataFrame:
    return commits.where(F.col("step").isNotNull()).select(*COLUMNS)


class _Commits(StatefulProcessor):
    def __init__(self, keep: timedelta, most: int):
        self.keep, self.most = keep, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step = handle.getValueState("step", "version long, state string, events long, finished timestamp")
        self.receivers = handle.getMapState("receivers", "receiver string", "lock boolean")

    def _held(self) -> Step | None:
        if not self.step.exists():
            return None
        return Step(*self.step.get(), {k[0]: v[0] for k, v in self.receivers.iterator()} if self.receivers.exists() else {})

    def _timer(self, at: datetime) -> None:
        self.handle.registerTimer(int((at + self.keep).timestamp() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = held = self._held()
        for row in sorted(rows, key=lambda r: r["request"]):
            held, result, version, deliveries = commit(held, row, self.most)
            yield Row(step=key[0], request=row["request"], result=result, version=version, deliveries=[Row(event=e, type=t, receiver=r) for e, t, r in deliveries])
        if held is None or held == before:
            return
        self.step.update((held.version, held.state, held.events, held.finished))
        old = before.receivers if before else {}
        for r in old.keys() - held.receivers.keys():
            self.receivers.removeKey((r,))
        for r, lock in held.receivers.items():
            if r not in old or old[r] != lock:
                self.receivers.updateValue((r,), (lock,))
        if held.finished is not None and (before is None or before.finished is None):
            self._timer(held.finished)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if held is not None and held.finished is not None:
            if any(held.receivers.values()):
                self._timer(datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000))
            else:
                self.step.clear()
                self.receivers.clear()
        return iter(())

    def close(self) -> None:
        pass


def committed(commits: DataFrame, keep: timedelta, late: str = "0 seconds", most: int = 10_000) -> DataFrame:
    """(step, request, result, version, deliveries) for each commit of a stream; the session's state store must be RocksDB."""
    rows = _rows(commits).withWatermark("at", late)
    return rows.groupBy("step").transformWithState(_Commits(keep, most), schema(commits.schema["step"].dataType), "Append", "EventTime")


def replayed(commits: DataFrame, most: int = 10_000) -> DataFrame:
    """The same of a table, as if it came as one batch: the commits of a step pass one task in order, which holds that step's state and no more."""
    out = schema(commits.schema["step"].dataType)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, of, held = to_arrow_schema(out), None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                done = []
                for row in batch.slice(low, 1000).to_pylist():
                    if of is None or row["step"] != of[0]:
                        of, held = (row["step"],), None
                    held, result, version, deliveries = commit(held, row, most)
                    done.append((row["step"], row["request"], result, version, [dict(zip(("event", "type", "receiver"), d, strict=True)) for d in deliveries]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    return _rows(commits).repartition("step").sortWithinPartitions("step", "request").mapInArrow(run, out)
