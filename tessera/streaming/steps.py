"""Streams of workflow steps: state changes under a transaction, and waits for answers.

`change_states` keeps one small state for each step that is open, or finished less than `keep` ago, dealt by step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States that end a step, and from which states a step may come to a state (fixed values).
FINAL = ("COMPLETED", "CANCELED")
BEFORE = {"IN PROGRESS": ("SCHEDULED",), "COMPLETED": ("IN PROGRESS",), "CANCELED": ("IN PROGRESS",)}


def _change(state: str, owner: str, wanted: str, transaction: str | None) -> tuple[str, str, str]:
    """(state, owner, result) after a request for a state by a transaction."""
    if wanted not in BEFORE:
        return state, owner, "invalid state"
    if not transaction:
        return state, owner, "no transaction"
    if state == "SCHEDULED":
        return (wanted, transaction, "changed") if wanted == "IN PROGRESS" else (state, owner, "not in progress")
    if transaction != owner:  # whatever the state, only the transaction that holds a step learns more
        return state, owner, "wrong transaction"
    if state in BEFORE[wanted]:
        return wanted, owner, "changed"
    if state == "IN PROGRESS":
        return state, owner, "already in progress"
    return state, owner, "already so" if state == wanted else "final"


def change_states(requests: DataFrame, keep: int | None = None) -> DataFrame:
    """For each request of the stream (step string, request long, wanted string, transaction string): step, request, state, result.

    A step is SCHEDULED until a first change. Within a batch requests are taken in the order of `request`; a null
    transaction changes nothing. Requests without a step are left out. The state of a finished step goes `keep` milliseconds
    (of processing time) after its last request, and such a step is then SCHEDULED again; without `keep` it stays.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, owner = held.get if held.exists else ("SCHEDULED", "")
        rows = pd.concat(list(batches)).sort_values("request", kind="stable")
        out = []
        for r in rows.itertuples():
            wanted, transaction = (None if pd.isna(v) else v for v in (r.wanted, r.transaction))
            state, owner, result = _change(state, owner, wanted, transaction)
            out.append((key[0], r.request, state, result))
        held.update((state, owner))
        if keep is not None and state in FINAL:
            held.setTimeoutDuration(keep)
        yield pd.DataFrame(out, columns=["step", "request", "state", "result"])

    rows = requests.where(F.col("step").isNotNull()).select("step", "request", "wanted", "transaction")
    return rows.groupBy("step").applyInPandasWithState(run, "step string, request long, state string, result string", "state string, owner string", "append", GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout)


def awaited(requests: DataFrame, answers: DataFrame, timeout: str, late: str = "0 seconds") -> DataFrame:
    """(transaction, asked, answered, outcome) of requests (transaction, asked) and the answers (transaction, answered) to them.

    An answer counts within `timeout` after its request. Without one the request comes out as timed out, once the
    watermark (the latest times less `late`) has passed that time; until then the request is the state that is kept.
    """
    r = requests.withWatermark("asked", late).alias("r")
    a = answers.select(F.col("transaction").alias("of"), "answered").withWatermark("answered", late).alias("a")
    met = (F.col("of") == F.col("transaction")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {timeout}"))
    return r.join(a, met, "left_outer").select("transaction", "asked", "answered", F.when(F.col("answered").isNull(), "timed out").otherwise("answered").alias("outcome"))
