"""Decision memory as a stream: each identity's state across days, and imports as micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "identity long, run_sequence long, as_of date, status string, transition string"
HELD = "state string, episodes long, last_run long"


def step(state: str | None, status: str) -> tuple[str | None, str | None]:
    """(state afterwards, transition) of one run; no state is an identity not yet seen to trigger."""
    if state is None:
        return ("OPEN", "OPENED") if status == "TRIGGERED" else (None, None)
    if status == "TRIGGERED":
        return "OPEN", "OBSERVED" if state == "OPEN" else "REOPENED"
    if state == "OPEN" and status == "CLEAR":
        return "RESOLVED", "RESOLVED"
    return state, "NO_STATE_CHANGE"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, episodes, last = held.get if held.exists else (None, 0, -1)
    rows = pd.concat(list(batches)).sort_values("run_sequence")
    out = []
    for run, day, status in zip(rows["run_sequence"], rows["as_of"], rows["status"]):
        if run == last:
            continue  # the last run again changes nothing
        if run < last:
            out.append((key[0], run, day, status, "REFUSED_OUT_OF_ORDER"))
            continue
        state, transition = step(state, status)
        episodes, last = episodes + (transition in ("OPENED", "REOPENED")), int(run)
        out.append((key[0], run, day, status, transition))
    held.update((state, episodes, last))
    yield pd.DataFrame(out, columns=["identity", "run_sequence", "as_of", "status", "transition"])


def lifecycle_stream(runs: DataFrame) -> DataFrame:
    """Lifecycle steps of a stream of (identity, run_sequence, as_of, status); the last run again is a no-op.

    A run older than the last one is refused: its row says so, and the state stays.
    """
    return runs.select("identity", "run_sequence", "as_of", "status").groupBy("identity").applyInPandasWithState(
        _advance, STEP, HELD, "append", GroupStateTimeout.NoTimeout
    )


def on_each_import(files: DataFrame, checkpoint: str, refresh: Callable[[DataFrame, int], None]):
    """Run ``refresh`` on every batch of new files, once each, then stop."""
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
