"""Pending changes kept up from a stream (T1, T2, T9): the state machine of cairn.operators.changes.pending, event by event.

Each path has one small state. Within a micro-batch a path's events are taken in the order of seq; across batches their
order is that of arrival, as for any watcher. State lives in Spark's checkpoint, so a restarted query goes on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def step(state: str | None, event: str) -> str:
    """What a path is after an event: unlink overwrites, add outlasts changes."""
    return "add" if event == "change" and state == "add" else event


def follow(key, batches, state):
    now = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    for event in rows["event"]:
        now = step(now, event)
    state.update((now,))
    yield pd.DataFrame({"path": [key[0]], "event": [now]})


def pending_stream(changes: DataFrame) -> DataFrame:
    """Streaming (path, event) updates from streaming changes(path, event, seq)."""
    kept = changes.filter("event in ('add', 'change', 'unlink') and path is not null and path <> ''")
    return kept.groupBy("path").applyInPandasWithState(follow, "path string, event string", "event string", "update", GroupStateTimeout.NoTimeout)
