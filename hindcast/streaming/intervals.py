"""Streaming state intervals: closed ones are emitted, the open one is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "subject_id bigint, state string, start_id bigint, end_id bigint, start_ts timestamp, end_ts timestamp"
STATE = "state string, id bigint, ts timestamp"


def _close(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """Replay the batch of one subject after the interval that is still open.

    Every event ends the open interval and opens its own.
    """
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    if held.exists:
        state, eid, ts = held.get
        rows = pd.concat([pd.DataFrame({"state": [state], "event_id": [eid], "ts": [ts]}), rows[["state", "event_id", "ts"]]], ignore_index=True)
    last = rows.iloc[-1]
    held.update((last["state"], int(last["event_id"]), last["ts"].to_pydatetime()))
    if len(rows) > 1:
        yield pd.DataFrame({
            "subject_id": key[0], "state": rows["state"].iloc[:-1].to_numpy(), "start_id": rows["event_id"].iloc[:-1].to_numpy(),
            "end_id": rows["event_id"].iloc[1:].to_numpy(), "start_ts": rows["ts"].iloc[:-1].to_numpy(), "end_ts": rows["ts"].iloc[1:].to_numpy()})


def state_intervals(events: DataFrame) -> DataFrame:
    """Closed intervals from a stream of (subject_id, state, event_id, ts).

    One trigger holds one subject's new events together, so the trigger size
    (``maxFilesPerTrigger``) bounds what a task sees.  Events must reach the
    stream in time order between triggers; inside one they are sorted.
    """
    return events.groupBy("subject_id").applyInPandasWithState(_close, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
